"""Substring dedup by fixed-block anchors (dealt operator 12).

Words are runs of characters other than space and the five control characters beside it; a
window is WINDOW consecutive words of one document.  Every word goes that is covered by a
window whose words also start in a document of smaller id.

Each document is cut into blocks of BLOCK words that do not overlap.  As BLOCK is half of
WINDOW + 1, a repeat of WINDOW words holds a whole block of the earlier document wherever
its blocks lie, so it is enough to index blocks and to probe the index with the BLOCK words
at every place of every document.  Hits are then extended: every window that holds a hit is
looked up by a digest of all its words, and windows that overlap join to maximal repeats.

Both lookups are one exchange (:func:`_asks`, :func:`_answers`).  Documents travel in slices
of a few megabytes; a slice asks for each distinct key once, with the least id of its own
that offers the key, so a passage in a third of all documents costs one entry a slice.  Keys
go to buckets by their own hash; a bucket tells a slice which of its keys another slice has
too, and the least id of all, as a bitmap and a list.  Keys of blocks are 32 bits within a
bucket of bounded load: a chance hit is rare at every size and costs a digest only.  Digests
of windows are 128 bits and stand for the words.

Defined results: a null text has no words; white space at either end and between words does
not count; documents under WINDOW words stay whole; rows of one id are one document as
regards "smaller", each keeps a row; a null id is smaller than none, and none is smaller
than it: such rows stay whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from mailfold.llm.common import mix64
from mailfold.session import settle, settle_measured

#: Words in a window, and in a block: any WINDOW words hold a whole block of any alignment.
WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bytes of words in a slice; a longer document is a slice of its own.
SLICE_BYTES = 4_000_000
#: Words whose keys meet in one bucket: bounds what a task holds, and chance hits.
BUCKET_WORDS = 4_000_000

SLICES = "slice BIGINT, doc_id ARRAY<BIGINT>, n_words ARRAY<BIGINT>, words BINARY"
ASKS = "slice BIGINT, bucket INT, keys BINARY, more BINARY, least BINARY, near BINARY"
ANSWERS = "slice BIGINT, bucket INT, shared BINARY, least BINARY"
RESULT = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, repeats ARRAY<STRUCT<first: BIGINT, last: BIGINT>>, kept STRING"

NONE = np.iinfo(np.int64).max
_SPACES = bytes(0x20 if i in (0x20, *range(0x09, 0x0E)) else i for i in range(256))
#: An odd multiplier and its inverse modulo 2^64, for hashes of byte ranges by prefix sums.
_MULTIPLIER = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_MASK = (1 << 64) - 1


# --- one slice ---------------------------------------------------------------------------


def spaced(text: bytes | None) -> bytes:
    """The words of a text with one space between them."""
    out = (text or b"").translate(_SPACES).strip(b" ")
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, int, int]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    tables = []
    for base in (_MULTIPLIER, inverse):
        steps = np.full(_STEP, base, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return *tables, pow(_MULTIPLIER, _STEP, 1 << 64), pow(inverse, _STEP, 1 << 64)


def _prefixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the bytes before each sorted offset ``at``, and the power that shifts it to zero."""
    power, inverse, jump, back = _powers()
    sums, shifts = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    total, scale, unscale = 0, 1, 1
    for start in range(0, len(data) + 1, _STEP):
        part = data[start:start + _STEP]
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=run[1:])
        lo, hi = np.searchsorted(at, [start, start + _STEP])
        near = at[lo:hi] - start
        sums[lo:hi] = run[near] * np.uint64(scale) + np.uint64(total)
        shifts[lo:hi] = inverse[near] * np.uint64(unscale)
        total = (total + int(run[-1]) * scale) & _MASK
        scale, unscale = (scale * jump) & _MASK, (unscale * back) & _MASK
    return sums, shifts


class Slice:
    """Words of some documents in one buffer, with the document of each."""

    def __init__(self, doc_id: list[int | None], n_words: list[int], words: bytes):
        self.doc_id, self.counts = doc_id, np.array(n_words, dtype=np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(words) if words else b""
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        spaces = np.flatnonzero(self.bytes == 0x20)
        some = self.data != b""
        self.starts = np.concatenate([[0] if some else [], spaces + 1]).astype(np.int64)
        self.ends = np.concatenate([spaces, [len(self.data)] if some else []]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        doc = np.repeat(np.arange(len(doc_id)), self.counts)
        known = np.array([x is not None for x in doc_id], dtype=bool)
        ids = np.array([x if x is not None else 0 for x in doc_id], dtype=np.int64)
        self.ids, self.known = ids[doc], known[doc]
        self.place = np.arange(len(doc)) - self.first[doc]
        self.left = self.counts[doc] - self.place

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words; none of a document without id."""
        return np.flatnonzero((self.left >= size) & self.known)

    def block_keys(self, at: np.ndarray, size: int, buckets: int) -> np.ndarray:
        """Bucket and 32-bit hash of the windows ``at``, as one number."""
        before, shift = _prefixes(self.bytes, self.starts)
        after, _ = _prefixes(self.bytes, self.ends)
        h = mix64((after[at + size - 1] - before[at]) * shift[at])
        low = np.uint64(0xFFFFFFFF)
        return ((((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (h & low)

    def digests(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        ranges = zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist())
        view = memoryview(self.data)
        joined = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in ranges])
        pairs = np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


class Keys:
    """The distinct keys of a slice in order, the least id that offers each, and each window's key."""

    def __init__(self, key: np.ndarray, more: np.ndarray | None, ids: np.ndarray, offers: np.ndarray):
        order = np.argsort(key, kind="stable") if more is None else np.lexsort((more, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        if more is not None:
            new[1:] |= more[order][1:] != more[order][:-1]
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.key = key[order][new]
        self.more = np.zeros(len(self.key), dtype=np.uint64) if more is None else more[order][new]
        self.least = np.full(len(self.key), NONE, dtype=np.int64)
        np.minimum.at(self.least, self.of[offers], ids[offers])
        self.last = np.full(len(self.key), np.iinfo(np.int64).min, dtype=np.int64)
        np.maximum.at(self.last, self.of, ids)
        self.shared = self.least < self.last

    def buckets(self, bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to): keys are ordered by bucket first."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield int(bucket[a]), a, b

    def learn(self, bucket: np.ndarray, answers: list) -> None:
        """Take over what other slices have: the least id of all, and that the key is shared."""
        at = {b: (x, y) for b, x, y in self.buckets(bucket)}
        for answer in answers or ():
            a, b = at[answer["bucket"]]
            mask = np.unpackbits(np.frombuffer(answer["shared"], dtype=np.uint8), count=b - a).astype(bool)
            places = a + np.flatnonzero(mask)
            self.shared[places] = True
            self.least[places] = np.minimum(self.least[places], _unpacked(answer["least"]).view(np.int64))


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed: the planes that hardly vary vanish."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1)


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


# --- the two lookups ---------------------------------------------------------------------


def _block_keys(s: Slice, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, Keys, np.ndarray]:
    """(places, whether a block begins there, keys, bucket of each key)."""
    size = (window + 1) // 2
    at = s.windows(size)
    aligned = s.place[at] % size == 0
    keys = Keys(s.block_keys(at, size, buckets), None, s.ids[at], aligned)
    return at, aligned, keys, (keys.key >> np.uint64(32)).astype(np.int64)


def _window_keys(s: Slice, near: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, Keys, np.ndarray]:
    at = np.flatnonzero(near)
    key, more = s.digests(at, window)
    keys = Keys(key, more, s.ids[at], np.ones(len(at), dtype=bool))
    return at, keys, (((keys.key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _near(s: Slice, answers: list, window: int, buckets: int) -> np.ndarray:
    """For each word, whether a window begins there that holds a hit of a block or a block that was hit."""
    at, aligned, keys, bucket = _block_keys(s, window, buckets)
    keys.learn(bucket, answers)
    hit = np.zeros(len(s.ids) + 1, dtype=np.int64)
    hit[1:][at[keys.shared[keys.of] & (aligned | (keys.least[keys.of] < s.ids[at]))]] = 1
    sums, out = np.cumsum(hit), np.zeros(len(s.ids), dtype=bool)
    whole = s.windows(window)
    out[whole] = sums[whole + (window - (window + 1) // 2 + 1)] > sums[whole]
    return out


def _asked(slice_id: int, keys: Keys, bucket: np.ndarray, low: np.uint64) -> Iterator[tuple]:
    for b, lo, hi in keys.buckets(bucket):
        yield (slice_id, b, _packed(_steps(keys.key[lo:hi] & low)), _packed(keys.more[lo:hi]), _packed(keys.least[lo:hi]), None)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _rows(arrow: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _by_slice(table: DataFrame, schema: str, step) -> DataFrame:
    """``step(slice, row)`` on every slice; what it yields for one slice is one batch."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _rows(arrow, step(Slice(row["doc_id"], row["n_words"], row["words"]), row))

    return table.mapInArrow(run, schema)


def _asks(slices: DataFrame, window: int, buckets: int) -> DataFrame:
    """The keys of blocks and of all windows of a block's size."""

    def step(s: Slice, row: dict) -> Iterator[tuple]:
        _, _, keys, bucket = _block_keys(s, window, buckets)
        yield from _asked(row["slice"], keys, bucket, np.uint64(0xFFFFFFFF))

    return _by_slice(slices, ASKS, step)


def _asks_again(slices: DataFrame, window: int, buckets: int) -> DataFrame:
    """The digests of windows near a hit, and which windows they are."""

    def step(s: Slice, row: dict) -> Iterator[tuple]:
        near = _near(s, row["answers"], window, buckets)
        if near.any():
            _, keys, bucket = _window_keys(s, near, window, buckets)
            yield from _asked(row["slice"], keys, bucket, np.uint64(_MASK))
            yield row["slice"], None, None, None, None, zstandard.ZstdCompressor(level=3).compress(np.packbits(near).tobytes())

    return _by_slice(slices, ASKS, step)


def _meet(bucket: int, rows: list[dict]) -> Iterator[tuple]:
    """Answers to the slices that asked in one bucket."""
    keys = [np.cumsum(_unpacked(r["keys"])) for r in rows]
    more = [_unpacked(r["more"]) for r in rows]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    rest = np.concatenate(more)
    least = np.concatenate([_unpacked(r["least"]).view(np.int64) for r in rows])
    met = Keys(every, rest if rest.any() else None, least, np.ones(len(every), dtype=bool))
    several = (np.bincount(met.of) > 1) & (met.least < NONE)
    at = 0
    for row, size in zip(rows, sizes):
        of = met.of[at:at + size]
        at += size
        mask = several[of]
        if mask.any():
            yield row["slice"], bucket, np.packbits(mask).tobytes(), _packed(met.least[of[mask]])


def _answers(asks: DataFrame, width: int) -> DataFrame:
    """For every slice and bucket: which keys other slices have too, and the least id of those.

    Buckets are spread evenly over ``width`` partitions and read one after the other.
    """
    arrow = _arrow(ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] != current:
                    if held:
                        yield _rows(arrow, _meet(current, held))
                    current, held = row["bucket"], []
                held.append(row)
        if held:
            yield _rows(arrow, _meet(current, held))

    spread = asks.repartitionById(width, (F.col("bucket") % width).cast("int"))
    return spread.sortWithinPartitions("bucket", "slice").mapInArrow(run, ANSWERS)


def _told(answers: DataFrame) -> DataFrame:
    """All answers to a slice in one row; a slice asks a bounded number of keys."""
    return answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shared", "least")).alias("answers"))


# --- the operator ------------------------------------------------------------------------


def sliced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """The documents in slices of about ``size`` bytes of words."""
    arrow = _arrow(SLICES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids, counts, texts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = zstandard.ZstdCompressor(level=3).compress(b" ".join(t for t in texts if t))
            return _rows(arrow, [(made, ids, counts, words)])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = spaced(text.as_py())
                if held and held + len(words) > size:
                    yield flush()
                    made, ids, counts, texts, held = made + 1, [], [], [], 0
                ids.append(doc_id.as_py())
                counts.append(words.count(b" ") + 1 if words else 0)
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(cut, SLICES)


def _outcome(s: Slice, covered: np.ndarray, window: int) -> Iterator[tuple]:
    """The result rows of a slice from the first words of its repeated windows."""
    change = np.zeros(len(s.ids) + 1, dtype=np.int64)
    np.add.at(change, covered, 1)
    np.add.at(change, covered + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(gone, prepend=False) | (s.place == 0)) if len(gone) else np.zeros(0, dtype=np.int64)
    stops = np.append(edges[1:], len(gone)) if len(edges) else edges
    first_edge = np.searchsorted(edges, s.first).tolist()
    last_edge = np.searchsorted(edges, s.first + s.counts).tolist()
    edges, stops, first = edges.tolist(), stops.tolist(), s.first.tolist()
    for i, (doc_id, count) in enumerate(zip(s.doc_id, s.counts.tolist())):
        repeats, kept, removed = [], [], 0
        for e in range(first_edge[i], last_edge[i]) if count else ():
            a, b = edges[e], stops[e]
            if gone[a]:
                removed += b - a
                repeats.append({"first": a - first[i], "last": b - 1 - first[i]})
            else:
                kept.append(s.data[s.starts[a]:s.ends[b - 1]])
        yield doc_id, count, removed, repeats, b" ".join(kept).decode()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    slice_bytes: int = SLICE_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Per row of ``docs``: words, words removed, the maximal repeats (first and last word) and the words kept.

    ``window`` must be odd, so that a block is half of it, rounded up.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("a window has an odd number of words, three at least")
    count = F.aggregate("n_words", F.lit(0).cast("bigint"), lambda a, b: a + b)
    slices, (words,) = settle_measured(sliced(docs, id_col, text_col, slice_bytes), "llm-slices", n=F.sum(count))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, -(-(words or 0) // bucket_words))

    blocks = settle(_told(_answers(_asks(slices, window, buckets), width)), "llm-block-answers")
    again = settle(_asks_again(slices.join(blocks.hint("merge"), "slice", "left"), window, buckets), "llm-window-asks")
    told = _told(_answers(again.where("bucket IS NOT NULL").drop("near"), width))
    near = again.where("bucket IS NULL").select("slice", "near")

    def step(s: Slice, row: dict) -> Iterator[tuple]:
        covered = np.zeros(0, dtype=np.int64)
        if row["near"]:
            bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["near"]), dtype=np.uint8)
            at, keys, bucket = _window_keys(s, np.unpackbits(bits, count=len(s.ids)).astype(bool), window, buckets)
            keys.learn(bucket, row["answers"])
            covered = at[keys.least[keys.of] < s.ids[at]]
        return _outcome(s, covered, window)

    joined = slices.join(near.hint("merge"), "slice", "left").join(told.hint("merge"), "slice", "left")
    return _by_slice(joined, RESULT, step)


def oracle_sql(window: int = WINDOW) -> str:
    """The same counts and digest in SQL, every window compared by its words."""
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {window - 1}], ' ') AS content
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM cut WHERE len(w) >= {window})),
least AS (SELECT content, min(doc_id) AS first FROM win GROUP BY content HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM win JOIN least USING (content) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS p FROM hit),
listed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS kept FROM word LEFT JOIN gone USING (doc_id, p)
         WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT cut.doc_id, len(cut.w) AS n_words, coalesce(len(listed.ps), 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM cut LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
