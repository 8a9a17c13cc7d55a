"""Employer blocks: the exact partition inside which messages and records can meet.

Nodes are (owner, core name) and (owner, domain); a row carrying both is an edge.  A message
can only touch a record with an equal domain or a same-entity name, and same-entity names
share the core name, so connected components lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold.functions.identity import core_name, name_words
from mailfold.operators.titles import containing_titles
from mailfold.session import settle, settle_measured, together

#: Edges of an owner whose links a task follows at once; what it finds of owners with more goes through rounds.
CHUNK = 200_000
CONTRACTED = "owner STRING, u STRING, v STRING, whole BOOLEAN"


def node_keys() -> dict[str, Column]:
    return {
        "name_node": F.concat(F.lit("n:"), core_name(name_words(F.col("company")))),
        "domain_node": F.concat(F.lit("d:"), F.col("company_domain")),
    }


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges sorted by owner in; every node with the least one it is linked with out, unless it is that itself.

    State is the links among CHUNK edges of the owner being read; ``whole`` says that these
    were all edges of the owner.
    """
    leads: dict[str, str] = {}
    current, edges, cut = None, 0, False

    def lead(node: str) -> str:
        top = node
        while leads[top] != top:
            top = leads[top]
        while leads[node] != top:
            leads[node], node = top, leads[node]
        return top

    def found() -> list[tuple]:
        return [(current, node, top, not cut) for node in leads if (top := lead(node)) != node]

    for batch in batches:
        out: list[tuple] = []
        for owner, u, v in zip(batch["owner"], batch["u"], batch["v"], strict=True):
            if owner != current or edges == CHUNK:
                cut = cut or owner == current
                out += found()
                cut, current, edges = owner == current, owner, 0
                leads.clear()
            edges += 1
            a, b = lead(leads.setdefault(u, u)), lead(leads.setdefault(v, v))
            leads[max(a, b)] = min(a, b)
        yield pd.DataFrame(out, columns=["owner", "u", "v", "whole"])
    yield pd.DataFrame(found(), columns=["owner", "u", "v", "whole"])


def connected_components(edges: DataFrame, label: str = "blocks") -> DataFrame:
    """(owner, node, component) for edges (owner, u, v); component is the least node.

    Edges are dealt by owner and contracted as they stream by, which ends the components of all
    owners of at most CHUNK edges.  What is left of the others goes through alternating
    large-star and small-star steps (Kiveris et al., SoCC 2014): logarithmic rounds on long
    chains.  Every round groups with map-side minima and joins those minima back, so a hub node
    never has its neighbours collected, and is written to the shared scratch folder.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("owner", "u").agg(F.min("v").alias("m"))
        return least.withColumn("m", F.least("m", "u"))

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select("owner", F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(pairs: DataFrame) -> DataFrame:
        around = both_ways(pairs)
        least = minima(around)
        joined = around.join(least, ["owner", "u"]).filter(F.col("v") > F.col("u"))
        return joined.select("owner", F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(pairs: DataFrame) -> DataFrame:
        down = pairs.select(
            "owner", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = minima(down)
        moved = down.join(least, ["owner", "u"]).select("owner", F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("owner", "u", F.col("m").alias("v")))

    def step(pairs: DataFrame) -> DataFrame:
        starred = small_star(large_star(pairs)).filter(F.col("u") != F.col("v"))
        return starred.distinct()

    # written once: finding the edges can cost more than following them
    edges = settle(edges.select("owner", "u", "v").distinct(), label)
    nodes = edges.select("owner", F.col("u").alias("node")).unionByName(
        edges.select("owner", F.col("v").alias("node"))
    )

    rows = F.count(F.lit(1))
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = together(edges.filter(F.col("owner").isNotNull() & (F.col("u") != F.col("v"))), width, "owner")
    contracted = linked.sortWithinPartitions("owner").mapInPandas(contract, schema=CONTRACTED)
    contracted, (cut,) = settle_measured(contracted, label, n=F.count_if(~F.col("whole")))
    stars = contracted.filter("whole").drop("whole")
    if cut:
        content = F.sum(F.xxhash64("owner", "u", "v").cast("decimal(38,0)"))
        current, seen = settle_measured(contracted.filter("NOT whole").drop("whole").distinct(), label, n=rows, h=content)
        while seen[0]:
            current, now = settle_measured(step(current), label, n=rows, h=content)
            if now == seen:
                break
            seen = now
        stars = stars.unionByName(current)
    stars = stars.select("owner", F.col("u").alias("node"), F.col("v").alias("component"))
    return (
        nodes.distinct()
        .join(stars, ["owner", "node"], "left")
        .withColumn("component", F.coalesce("component", "node"))
    )


def employer_blocks(events: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(owner, node, component) over the employers of both tables.

    Only rows with a domain can link anything; names without one are their own component
    and never enter the rounds.
    """
    columns = ["owner", "company", "company_domain"]
    rows = events.select(*columns)
    if records is not None:
        rows = rows.unionByName(records.select(*columns))
    linked = (
        rows.filter(F.col("company_domain").isNotNull())
        .distinct()
        .withColumns(node_keys())
        .select("owner", F.coalesce("name_node", "domain_node").alias("u"), F.col("domain_node").alias("v"))
    )
    return connected_components(linked)


def merged_labels(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(owner, node, component) of the components that the employers of ``rows`` touch.

    ``labels`` are the known ones.  A row's name and domain link the components these have so
    far, so components are found over touched labels only, and the nodes of a component that
    is merged into another get its label.  A node without label is its own; a component is
    named after its least node, as if all rows had been labelled at once.
    """
    pairs = rows.select("owner", "company", "company_domain").distinct().withColumns(node_keys()).select(
        "owner", F.coalesce("name_node", "domain_node").alias("u"), F.coalesce("domain_node", "name_node").alias("v")
    ).filter(F.col("u").isNotNull()).distinct()
    known = labels.select(F.col("owner").alias("_owner"), F.col("node").alias("_node"), F.col("component").alias("_label"))
    for end in ("u", "v"):
        on = (F.col("owner") == F.col("_owner")) & (F.col(end) == F.col("_node"))
        pairs = pairs.join(known, on, "left").withColumn(f"{end}_label", F.coalesce("_label", end)).drop("_owner", "_node", "_label")
    pairs = settle(pairs, "touched-employers")
    joined = settle(connected_components(pairs.select("owner", F.col("u_label").alias("u"), F.col("v_label").alias("v"))), "merged-labels")
    now = joined.select("owner", F.col("node").alias("label"), F.col("component").alias("now"))
    old = labels.withColumnRenamed("component", "label").join(now, ["owner", "label"])
    new = reduce(DataFrame.unionByName, [
        pairs.select("owner", F.col(end).alias("node"), F.col(f"{end}_label").alias("label")) for end in ("u", "v")
    ]).join(now, ["owner", "label"])
    return old.select("owner", "node", "now").unionByName(new.select("owner", "node", "now")).distinct().withColumnRenamed("now", "component")


def in_blocks(records: DataFrame, labels: DataFrame) -> DataFrame:
    """The records whose employer is one of the labelled nodes."""
    nodes = labels.select(F.col("owner").alias("_owner"), F.col("node").alias("_known")).distinct()
    keyed = records.withColumns(node_keys()).withColumn("_node", F.coalesce("name_node", "domain_node"))
    on = (F.col("owner") == F.col("_owner")) & (F.col("_node") == F.col("_known"))
    return keyed.join(nodes, on, "left_semi").drop("_node", "name_node", "domain_node")


def with_blocks(table: DataFrame, components: DataFrame, own_id: str) -> DataFrame:
    """Adds ``block``: the component of the row's name or domain, else the row itself."""
    keyed = table.withColumns(node_keys()).withColumn(
        "_node", F.coalesce("name_node", "domain_node", F.concat(F.lit("r:"), F.col(own_id)))
    )
    private = components.select(
        F.col("owner").alias("_owner"), F.col("node").alias("_known"), "component"
    )
    on = (F.col("owner") == F.col("_owner")) & (F.col("_node") == F.col("_known"))
    return (
        keyed.join(private, on, "left")
        .withColumn("block", F.coalesce("component", "_node"))
        .drop("_owner", "_known", "component", "_node", "name_node", "domain_node")
    )


def block_sizes(blocked: DataFrame) -> DataFrame:
    """Rows per block, for spotting a shared host that the vocabulary misses."""
    return blocked.groupBy("owner", "block").agg(
        F.count("*").alias("n_rows"),
        F.approx_count_distinct("company").alias("n_names"),
        F.approx_count_distinct("company_domain").alias("n_domains"),
    )


def fold_units(blocked: DataFrame) -> DataFrame:
    """Adds ``unit``, the key of independent folds: the block, or part of a block of titled rows.

    If no row of a block lacks a title, a message can only reach records whose title equals,
    contains or is contained in its own, or that carry the same requisition number, so
    components over titles and numbers fold independently.  One row without a title can
    meet any record; such blocks stay whole.  Expects ``title`` (null when unknown).
    """
    keys = ["owner", "block"]
    whole_unit = F.concat_ws("\u0001", *keys)
    titled = (
        blocked.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.bool_or(F.col("title").isNull()).alias("_whole"))
        .filter((F.col("_n") > 1) & ~F.col("_whole"))
        .select(*keys)
    )
    title_node = F.concat(F.lit("t:"), F.col("title"))
    nodes = (
        blocked.join(titled, keys, "left_semi")
        .select(whole_unit.alias("owner"), "title", title_node.alias("u"), "req")
        .distinct()
    )
    by_req = nodes.filter(F.col("req").isNotNull()).select(
        "owner", "u", F.concat(F.lit("q:"), F.col("req")).alias("v")
    )
    named = [F.concat(F.lit("t:"), F.col(c)).alias(end) for c, end in (("title", "u"), ("part", "v"))]
    contained = containing_titles(nodes, ["owner"]).select("owner", *named)
    components = connected_components(by_req.unionByName(contained), "titles")
    parts = components.filter(F.col("node").startswith("t:")).select(
        F.col("owner").alias("_unit"), F.col("node").alias("_title"), F.col("component").alias("_part")
    )
    marked = blocked.withColumn("_whole_unit", whole_unit)
    on = (F.col("_whole_unit") == F.col("_unit")) & (title_node == F.col("_title"))
    return (
        marked.join(parts, on, "left")
        .withColumn("unit", F.concat_ws("\u0001", "_whole_unit", "_part"))
        .drop("_whole_unit", "_unit", "_title", "_part")
    )
