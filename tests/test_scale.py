"""What a query sends and writes, on rows built here."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from checks import queries
from mailfold.functions.identity import core_name, name_words, sender_address
from mailfold.operators import blocks, titles as title_operators
from mailfold.operators.titles import containing_titles
from mailfold.session import SETTINGS


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_pieces_are_not_broadcast(spark):
    titles = spark.range(50).select(F.col("id").alias("owner"), F.concat(F.lit("data engineer "), F.col("id")).alias("title"))
    found = containing_titles(titles.unionByName(titles.withColumn("title", F.lit("data"))), ["owner"])
    assert "BroadcastHashJoin" not in executed(found)
    assert {(r.part.split(" ")[0], r.title.split(" ")[0]) for r in found.collect()} == {("data", "data")}
    assert found.count() == 150


def test_file_sizes_are_read_as_sizes_of_rows():
    assert float(SETTINGS["spark.sql.sources.fileCompressionFactor"]) > 1


def test_hosts_are_counted_without_patterns_in_a_join(spark, tmp_path):
    lines(spark, tmp_path)
    found = queries.shared_host_messages(spark, str(tmp_path))
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n for r in found.collect()) == 12


def test_dumps_are_written_compressed(spark, tmp_path):
    lines(spark, tmp_path)
    root = queries.dumps_by_arrival(spark, str(tmp_path))
    files = [str(p) for p in pathlib.Path(root.removeprefix("file:")).rglob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.read.json(f"{root}/in").count() == 12


def lines(spark, folder):
    """Twelve lines of four orders."""
    orders = spark.range(1, 5).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE'1996-03-01' + CAST(id * 400 AS INT) AS o_orderdate")
    orders.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    orders.crossJoin(spark.range(1, 4)).selectExpr(
        "o_orderkey AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "o_orderkey * 7 + id AS l_partkey", "id AS l_suppkey"
    ).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def linked(edges):
    """{(owner, node): least node} by brute force."""
    least = {(o, n): n for o, *ends in edges for n in ends}
    for _ in least:
        for o, u, v in edges:
            least[o, u] = least[o, v] = min(least[o, u], least[o, v])
    return least


def test_components_of_ordinary_owners_need_no_rounds(spark, monkeypatch):
    written = []
    settle_measured = blocks.settle_measured
    monkeypatch.setattr(blocks, "settle_measured", lambda *a, **k: written.append(a) or settle_measured(*a, **k))
    draw = random.Random(5)
    edges = [(f"o{draw.randrange(4)}", *(f"n{draw.randrange(40):02}" for _ in "uv")) for _ in range(80)]
    found = blocks.connected_components(spark.createDataFrame(edges, "owner STRING, u STRING, v STRING"))
    assert {(r.owner, r.node): r.component for r in found.collect()} == linked(edges)
    assert len(written) == 1


def test_components_of_an_owner_with_more_edges_than_a_chunk(spark, monkeypatch):
    whole = blocks.contract

    def chunked(batches):
        from mailfold.operators import blocks

        blocks.CHUNK = 7
        yield from whole(batches)

    monkeypatch.setattr(blocks, "contract", chunked)
    draw = random.Random(6)
    edges = [("big", *(f"n{draw.randrange(90):02}" for _ in "uv")) for _ in range(70)] + [("small", "a", "b"), ("small", "b", "c")]
    found = blocks.connected_components(spark.createDataFrame(edges + [(None, "x", "y")], "owner STRING, u STRING, v STRING"))
    got = {(r.owner, r.node): r.component for r in found.collect()}
    assert got == {**linked(edges), (None, "x"): "x", (None, "y"): "y"}


def test_few_titles_of_a_group_are_compared_without_pieces(spark):
    rows = [("u", t) for t in ("qa", "qa lead", "lead", "a", "senior qa lead")] + [("v", "qa"), (None, "qa")]
    found = containing_titles(spark.createDataFrame(rows, "owner STRING, title STRING"), ["owner"])
    assert "Generate" not in executed(found)
    want = {(o, p, t) for o, p in rows for q, t in rows if o and o == q and p in t}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_many_titles_of_a_group_beside_few(spark):
    draw = random.Random(7)
    rows = list({("many", "".join(draw.choices("abc ", k=draw.randrange(1, 9)))) for _ in range(120)}) + [("few", "abca"), ("few", "bc")]
    assert len(rows) > title_operators.FEW
    found = containing_titles(spark.createDataFrame(rows, "owner STRING, title STRING"), ["owner"])
    want = {(o, p, t) for o, p in rows for q, t in rows if o == q and p in t}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_a_name_is_split_once_for_its_node(spark):
    names = spark.createDataFrame([(" Acme &  Sons\u00a0Health Group ",), ("\u3000",), ("Group",), (None,)], "company STRING")
    keyed = names.withColumn("core", core_name(name_words(F.col("company")))).withColumn("company_domain", F.lit("x"))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    got = [tuple(r) for r in keyed.withColumns(blocks.node_keys()).select("core", "name_node").collect()]
    assert got == [("acme sons", "n:acme sons"), (None, None), ("group", "n:group"), (None, None)]


@pytest.mark.parametrize("sender, address", [("Q <Jobs@Q.example> x", "jobs@q.example"), ("talent.x a@b.c\u00a0z", "a@b.c"), ("none", ""), ("a @ b", ""), (None, "")])
def test_addresses_of_senders(spark, sender, address):
    assert spark.createDataFrame([(sender,)], "s STRING").select(sender_address(F.col("s"))).first()[0] == address
