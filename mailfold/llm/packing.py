"""Best-two-fit packing of tokenised documents into fixed-length sequences (dealt operator 4).

A document is its token ids and an end id.  A document longer than a sequence is cut into
full pieces, of which the first may be shorter, so at most one piece a document is not full.

Which pieces share a sequence depends on their lengths only, and there are at most
``capacity`` lengths.  The plan is therefore made over the counts of lengths: a bin is filled
greedily with the longest length that still fits, then its smallest piece is exchanged for
two unpacked pieces that fill the widened gap better, and the resulting composition is used
as often as the counts allow.  Every composition uses up one length at least, so the plan is
as large as the number of lengths, whatever the number of documents.  Spark tokenises,
counts, ranks the pieces of a length and joins ranks to places.

Defined results: a null text counts as empty (its piece is the end id alone); repeated rows
are packed once for each row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailfold.llm import byte_bpe
from mailfold.llm.common import map_rows
from mailfold.session import settle

CAPACITY = 2048
END_ID = 0
#: Strata in which the pieces of one length are ranked, so that no length meets in one task.
SALTS = 256

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces of a document; all but the first are full."""
    count = len(ids) // 4
    first = count % capacity or capacity
    bounds = [0, *range(min(first, count), count + 1, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]


def tokenised(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""
    path = vocabulary or byte_bpe.default_vocabulary()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(rows):
        encoder = byte_bpe.load(path)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            for number, (start, part) in enumerate(cut(encoder.ids(text or "").tobytes() + end, capacity)):
                for key, value in zip(out, (doc_id, number, start, len(part) // 4, zlib.crc32(part))):
                    out[key].append(value)
        yield out

    return map_rows(docs, PIECES, run, doc_id=id_col, text=text_col)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) that use up ``counts`` of lengths.

    Greedy fill from the longest length left; then the smallest piece of the bin gives way to
    the two unpacked pieces that fill its gap best, when they fill it better than it does.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)  # lengths with unpacked pieces
    out = []
    while sizes:
        used: dict[int, int] = {}
        bin_, gap = [], capacity
        while True:
            at = bisect_right(sizes, gap) - 1
            while at >= 0 and used.get(sizes[at], 0) >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            size = sizes[at]
            take = min(gap // size, left[size] - used.get(size, 0))
            bin_ += [size] * take
            used[size] = used.get(size, 0) + take
            gap -= size * take
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            pair = _best_two(sizes, left, used, gap + smallest)
            if pair and sum(pair) > smallest:
                bin_[-1:] = pair
                used[smallest] -= 1
                for size in pair:
                    used[size] = used.get(size, 0) + 1
        times = min(left[size] // n for size, n in used.items() if n)
        out.append((times, bin_))
        for size, n in used.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
        sizes = [s for s in sizes if s in left]
    return out


def _best_two(sizes: list[int], left: dict[int, int], used: dict[int, int], gap: int) -> list[int] | None:
    """The two unpacked pieces with the largest sum that is at most ``gap``."""
    low, high, best, found = 0, bisect_right(sizes, gap) - 1, 0, None
    free = lambda size: left[size] - used.get(size, 0)
    while low <= high:
        a, b = sizes[low], sizes[high]
        if a + b > gap or free(b) < (2 if low == high else 1):
            high -= 1
            continue
        if free(a) >= (2 if low == high else 1) and a + b > best:
            best, found = a + b, [b, a]
        low += 1
    return found


def places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for every slot.

    The pieces of a length are dealt to the slots of that length in order of rank; a slot of
    a composition that is used n times takes n of them, one for each of n sequences.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, bin_ in bins:
        offset = 0
        for size in bin_:
            rank = taken.get(size, 0)
            taken[size] = rank + times
            out.append((size, rank, rank + times, sequence, offset))
            offset += size
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to settled ``pieces`` (doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    strata = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    strata = settle(strata.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "llm-pack-strata")
    counts = {r["length"]: r["n"] for r in strata.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # At most ``capacity`` counts come to the driver, and the slots are bounded by them as well.
    slots = spark.createDataFrame(places(plan(counts, capacity)) or [(0, 0, 0, 0, 0)],
                                  "length bigint, lo bigint, hi bigint, first_sequence bigint, offset bigint")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(strata.select("length", "salt", "base")), ["length", "salt"])
        .withColumn("rank", F.col("row") + F.col("base"))
    )
    joined = ranked.join(F.broadcast(slots), "length").where("rank >= lo AND rank < hi")
    return joined.select(*pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` once, write the pieces, and place each of them in a sequence."""
    pieces = settle(tokenised(docs, vocabulary, capacity, end_id, id_col, text_col), "llm-pieces")
    return pack(pieces, capacity)
