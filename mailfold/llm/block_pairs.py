"""Pairwise work inside buckets of any size, without emitting pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfold.session import settle

#: Rows of a block; a task holds two blocks at a time.
BLOCK_ROWS = 512


def in_block_pairs(rows: DataFrame, bucket: Sequence[str], row_id: str, fn: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame],
                   schema: str, block_rows: int = BLOCK_ROWS, size: str | None = None) -> DataFrame:
    """Apply ``fn`` to the blocks of every bucket of two or more ``rows``.

    A bucket of n rows is dealt into ceil(n / block_rows) blocks by a hash of ``row_id``;
    ``fn(a, None)`` sees the rows of one block, ``fn(a, b)`` those of two, so that every two
    rows of a bucket meet in exactly one call and no call grows with the bucket.  Bucket
    sizes come from counts that are written first and joined back, so that a hot bucket's
    exchange can be split; a caller who knows them names their column, ``size``.
    """
    if size is None:
        sizes = settle(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "llm-bucket-sizes")
        counted = rows.join(sizes, list(bucket))
    else:
        counted = rows.withColumnRenamed(size, "__n").where("__n > 1")
    placed = counted.withColumn("__blocks", F.ceil(F.col("__n") / block_rows).cast("int"))
    placed = placed.withColumn("__own", F.pmod(F.xxhash64(row_id, F.lit("block")), F.col("__blocks")).cast("int"))
    spread = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    paired = spread.withColumn("__lo", F.least("__own", "__other")).withColumn("__hi", F.greatest("__own", "__other"))

    keys = [*bucket, "__lo", "__hi"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["__lo"].iloc[0], group["__hi"].iloc[0]
        if lo == hi:
            return fn(group.reset_index(drop=True), None)
        first = group[group["__own"] == lo].reset_index(drop=True)
        return fn(first, group[group["__own"] == hi].reset_index(drop=True))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows in; most buckets are small, so many of them pass in one batch."""
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            fresh = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(fresh).tolist()
            held = frame.iloc[cuts[-1] :].reset_index(drop=True)
            for a, b in zip(cuts, cuts[1:]):
                yield run(frame.iloc[a:b])
        if held is not None and len(held):
            yield run(held)

    dealt = paired.drop("__n", "__blocks", "__other").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(stream, schema)


def local_roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``count`` nodes' component under the links (i, j)."""
    root = np.arange(count)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root
