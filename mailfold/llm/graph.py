"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mailfold.session import settle, settle_measured


def components(edges: DataFrame, label: str = "llm-components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; a component is its least node.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014), so long chains
    take a logarithmic number of rounds.  Least neighbours come from map-side minima and are
    joined back through exchanges on both sides, so that a hub's edges can be split; no node's
    neighbours are ever gathered.  Each step writes one table in the shared folder.  The loop
    ends when every node is a centre or has one neighbour, a centre less than itself.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current, (left,) = settle_measured(pairs, label, n=F.count(F.lit(1)))
    # in a struct the node is dealt anew, not as the minima were
    key = F.struct("u").alias("key")
    while left:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = F.when(F.col("v") < F.col("u"), F.col("v"))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.max(lower).alias("top"), F.max(F.col("v") > F.col("u")).alias("above"))
        seen = Observation()
        near = near.observe(seen, F.count_if((F.col("top") > F.col("m")) | (F.col("top").isNotNull() & F.col("above"))).alias("open"))
        least = near.select(key, F.least("m", "u").alias("m"))
        large = both.where("v > u").select(key, "v").join(least, "key").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), label)
        left = seen.get["open"]
        if not left:
            break
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(key, "m")
        joined = large.select(key, "u", "v").join(low, "key")
        ends = F.explode(F.array(*(F.struct(F.col(end).alias("u"), F.col("m").alias("v")) for end in ("u", "v"))))
        current = settle(joined.select(ends.alias("end")).select("end.*").where("u <> v").distinct(), label)
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
