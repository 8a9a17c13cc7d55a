"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables (dealt operator 1).

A rotation is learned (Gong and Lazebnik's ITQ) that turns centred unit vectors into binary
codes with balanced bits.  A code is cut into ``TABLES`` substrings; vectors of one label
that agree in a substring are candidates, and candidates are compared by the cosine of the
original vectors in double precision.  A pair is compared in the first table in which it
meets only.  At a cosine of 0.93 a bit differs with probability 0.12, so two such vectors
share none of ten substrings of six bits with probability 0.002 (at 0.96 about 1e-4).

Equal vectors of a label are first collapsed into a class with a count.  Hash buckets are
compared in blocks of bounded size; a call gives each vector's number of links and its
least neighbour in the block's own components, so neither pairs nor links leave a task.

The rotation is fitted on ``SAMPLE`` vectors chosen by a hash of the id; every vector is
coded and compared.  Quality of the fit affects which pairs meet, never whether a pair that
meets links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without a label or an id, link with nothing (their own component; kept; a null
id has a null component).  Vectors of different lengths never link.  Rows of one id are one
node of the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold.llm.block_pairs import in_block_pairs, local_roots
from mailfold.llm.common import map_rows
from mailfold.llm.graph import components
from mailfold.session import settle

LEAST_COSINE = 0.93
TABLES = 10
TABLE_BITS = 6
SAMPLE = 20_000
ROUNDS = 40


class Rotation:
    """Centre and projections of one vector length; ``codes`` gives a substring for each table."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, seed: int = 7):
        need, rng = tables * bits, np.random.default_rng(seed)
        x = unit(sample)
        self.tables, self.bits, self.centre = tables, bits, x.mean(axis=0)
        x = x - self.centre
        _, vectors = np.linalg.eigh(x.T @ x / len(x))
        parts, have = [], 0
        while have < need:  # short vectors need several rotations for as many bits
            wide = min(x.shape[1], need - have)
            basis = vectors[:, ::-1][:, :wide]
            parts.append(basis @ itq(x @ basis, rng))
            have += wide
        self.projection = np.concatenate(parts, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((unit(vectors) - self.centre) @ self.projection > 0).reshape(len(vectors), self.tables, self.bits)
        return bits @ (1 << np.arange(self.bits))


def itq(v: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation of ``v`` whose signs are closest to it, by alternating minimisation."""
    rotation, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ rotation >= 0, 1.0, -1.0))
        rotation = left @ right
    return rotation


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; first to a largest component of one, so
    that squares neither overflow nor vanish."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector can link: finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def learn(classes: DataFrame, tables: int, bits: int, sample: int) -> dict[int, Rotation]:
    """A rotation for every vector length in a bounded sample of settled ``classes``."""
    chosen = classes.select("vector").orderBy(F.xxhash64("class_id", F.lit("itq")), "class_id").limit(sample).collect()
    by_size: dict[int, list] = {}
    for row in chosen:
        by_size.setdefault(len(row.vector), []).append(row.vector)
    return {n: Rotation(np.array(rows), tables, bits) for n, rows in by_size.items()}


_CODED = "label string, class_id bigint, n bigint, vector array<double>, size int, codes array<int>"


def coded(classes: DataFrame, rotations: dict[int, Rotation], tables: int) -> DataFrame:
    """Substrings of the binary code of every class; a length the sample has not met has one bucket."""
    def run(rows):
        sizes = np.array([len(v) for v in rows["vector"]])
        codes = np.zeros((len(sizes), tables), dtype=np.int64)
        for n in set(sizes.tolist()) & rotations.keys():
            at = np.flatnonzero(sizes == n)
            codes[at] = rotations[n].codes(np.array([rows["vector"][i] for i in at.tolist()], dtype=np.float64))
        yield rows | {"size": sizes, "codes": list(codes.astype(np.int32))}

    return map_rows(classes, _CODED, run, label="label", class_id="class_id", n="n", vector="vector")


def _compare(least: float):
    def run(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        both = a if b is None else pd.concat([a, b], ignore_index=True).sort_values("class_id", ignore_index=True)
        if b is None:
            both = both.sort_values("class_id", ignore_index=True)
        x, ids, counts = unit(np.stack(both["vector"].to_list())), both["class_id"].to_numpy(), both["n"].to_numpy()
        codes, table, own = np.stack(both["codes"].to_list()), int(both["table"].iloc[0]), both["__own"].to_numpy()
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        fresh = ~(codes[i, :table] == codes[j, :table]).any(axis=1)  # not met in an earlier table
        if b is not None:
            fresh &= own[i] != own[j]
        i, j = i[fresh], j[fresh]
        links = np.bincount(i, weights=counts[j], minlength=len(ids)) + np.bincount(j, weights=counts[i], minlength=len(ids))
        root = local_roots(len(ids), i, j)
        linked = links > 0
        return pd.DataFrame({"class_id": ids[linked], "n_links": links[linked].astype(np.int64), "root": ids[root[linked]]})

    return run


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least: float = LEAST_COSINE, tables: int = TABLES, bits: int = TABLE_BITS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                             F.col(vector_col).cast("array<double>").alias("vector"))
    can_link = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    content = F.when(can_link, F.sha2(F.concat_ws("|", F.col("label"), F.col("vector").cast("string")), 256))
    keyed = rows.withColumn("content", content)
    classes = settle(
        keyed.where(F.col("content").isNotNull()).groupBy("content").agg(
            F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.min("label").alias("label"),
            F.min("vector").alias("vector")), "llm-vectors")
    with_codes = settle(coded(classes, learn(classes, tables, bits, sample), tables), "llm-codes")
    probes = with_codes.select("*", F.posexplode("codes").alias("table", "code"))
    found = settle(
        in_block_pairs(probes, ["label", "size", "table", "code"], "class_id", _compare(least),
                       "class_id bigint, n_links bigint, root bigint"), "llm-vector-links")
    degree = found.groupBy("class_id").agg(F.sum("n_links").alias("linked"))
    parts = components(found.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    known = classes.select("content", "class_id", "n").join(degree, "class_id", "left").join(
        parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = settle(known.select("content", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                                F.coalesce("component", "class_id").alias("component_id")), "llm-vector-classes")
    joined = keyed.select("vec_id", "content").join(known, "content", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def oracle_sql(least: float = LEAST_COSINE) -> str:
    """Every pair of a label compared, components by repeated least labels."""
    return f"""
WITH RECURSIVE ok AS (
    SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
     AND list_cosine_similarity(a.v, b.v) >= {least}),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings
          UNION SELECT r.node, l.w FROM reach r JOIN links l ON l.u = r.seen),
parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id"""
