"""Source divergence audit over run-length columns (dealt operator 13).

How far the sources of a language differ in their words.  A term is a run of letters (ASCII
letters, lower-cased, and all characters beyond ASCII); a language keeps the terms of at
least MIN_DOCS of its documents.  A source and the whole language each give a kept term the
smoothed share ``1 + floor(SCALE * (count + ADD) / (N + ADD * V))``; two of them differ by
the absolute difference, summed over the kept terms.

The counts of a source are a column over the vocabulary.  The vocabulary is put in the order
of the counts themselves (the list of sources and counts of a term), which brings equal counts together
in the first columns and long runs of zeros in all; each column is stored as runs of equal
count, in blocks of BLOCK terms.  A pair of sources is compared by intersecting the ends of
their runs: one difference for each piece, times its length.  All arithmetic is in whole
numbers.

Work is spread by term while counting.  A task counts first, whole batches of text at a time in
flat arrays that it merges as they grow, so a source or a word with a third of all rows adds no
more than a row for each of its terms and merges.  Counts are shuffled once, by term, where
terms of too few documents leave and the rest are summed.  Columns are compared by blocks of
terms and tiles of sources, which bounds a task; only the result has a row for each pair.

Defined results: null text, lang and source are empty strings; every (lang, source) that
occurs has its pairs, of value 0 if the language keeps no term; repeated rows count as
often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, _parse_datatype_string

from mailfold.llm.common import Rows, map_rows, slices
from mailfold.operators.reports import ranked
from mailfold.session import settle

MIN_DOCS = 30
SCALE = 1_000_000_000
ADD = 5
#: Ranks of the part ``term``.
TOP = 50
#: Terms in a block of a column, and columns of a block that meet in one task, about.
BLOCK = 16_384
TILE = 64
#: Counts (of a term in a source) that a task holds before it merges them and hands them on, and bytes
#: of terms beyond which it does so too.
HELD_TERMS = 2_000_000
HELD_BYTES = 64 << 20
#: Bytes of a text beyond which it is split in steps.
STEP_BYTES = 1 << 20
BATCH_ROWS = 20_000

PARTIAL = StructType([
    StructField("lang", StringType()), StructField("term", StringType()), StructField("docs", LongType()),
    StructField("cells", ArrayType(StructType([StructField("source", StringType()), StructField("n", LongType())]))),
])
COLUMN = "lang STRING, source STRING, block BIGINT, ends ARRAY<BIGINT>, counts ARRAY<BIGINT>, shares ARRAY<BIGINT>"
PAIRED = "lang STRING, source STRING, other STRING, value BIGINT"

#: ASCII letters in lower case, a space for all else in ASCII, other bytes as they are.
_LETTERS = bytes(i if i >= 0x80 or chr(i).islower() else i + 32 if chr(i).isupper() else 0x20 for i in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each step of bounded size."""
    at = 0
    while at < len(text):
        end = at + STEP_BYTES
        part = text[at:end].translate(_LETTERS)
        while end < len(text) and not part.endswith(b" "):  # a term does not end here
            more = text[end:end + 256].translate(_LETTERS)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        yield part.split()
        at = end


class Cells(NamedTuple):
    """Counts of a task, one for each term and group: terms by their place in ``words``."""

    words: pa.Array
    code: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray


def _summed(words: pa.Array, code: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray, groups: int) -> Cells:
    """One entry for each term and group, by term and then group."""
    key = code.astype(np.int64) * groups + group
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    code, group = np.divmod(key[first], groups)
    return Cells(words, code.astype(np.int32), group.astype(np.int32), np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))


def step_counts(texts: pa.Array, group: np.ndarray) -> Cells | None:
    """Counts of texts (binary, not null) of the given groups; None if they hold no term."""
    if not len(texts):
        return None
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offsets, start, end = offsets - offsets[0], int(offsets[0]), int(offsets[-1])
    if start == end:
        return None
    data = np.frombuffer(texts.buffers()[2].slice(start, end - start).to_pybytes().translate(_LETTERS), dtype=np.uint8)
    letter = data != 0x20
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a term does not go on in the next text
    begins[edges] = letter[edges]
    places = np.flatnonzero(begins)
    if not len(places):
        return None
    data, before = data[letter], np.cumsum(letter, dtype=np.int32)
    ends = np.append(before[places] - 1, len(data)).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(places, offsets)))
    pair, n = np.unique(doc * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
    doc, code = np.divmod(pair, len(coded.dictionary))
    return _summed(coded.dictionary, code, group[doc], n, np.ones(len(n), dtype=np.int64), int(group.max()) + 1)


def _merged(held: list[Cells], groups: int) -> Cells:
    """The counts of several steps as one."""
    coded = pa.chunked_array([c.words for c in held]).dictionary_encode()
    code = np.concatenate([chunk.indices.to_numpy()[c.code] for chunk, c in zip(coded.chunks, held)])
    return _summed(coded.chunk(0).dictionary, code, *(np.concatenate(x) for x in list(zip(*held))[2:]), groups)


def _packed(cells: Cells, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL; ``langs`` and ``sources`` name the groups."""
    known = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    lang = np.array([known[x] for x in langs])[cells.group]
    order = np.lexsort((lang, cells.code))
    code, lang = cells.code[order], lang[order]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
    ends = np.append(first, len(code))
    docs = np.add.reduceat(cells.docs[order], first)
    arrow = to_arrow_schema(PARTIAL)
    fields = list(arrow.field("cells").type.value_type)
    for at in range(0, len(first), BATCH_ROWS):
        rows = slice(at, at + BATCH_ROWS)
        cuts = ends[at:at + BATCH_ROWS + 1]
        own = order[cuts[0]:cuts[-1]]
        inner = pa.StructArray.from_arrays([pa.array(sources, pa.string()).take(pa.array(cells.group[own])), pa.array(cells.n[own])], fields=fields)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(known), pa.string()).take(pa.array(lang[first[rows]])), cells.words.take(pa.array(code[first[rows]])).cast(pa.string()),
            pa.array(docs[rows]), pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), inner)], names=arrow.names)


def partial_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, held_terms: int = HELD_TERMS) -> DataFrame:
    """Documents of every term of a language and its occurrences by source, in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Cells] = []
        groups: dict[tuple[str, str], int] = {}

        def over(share: int) -> bool:
            """Whether more is held than this part of the limits."""
            return sum(len(c.n) for c in held) * share > held_terms or sum(c.words.nbytes for c in held) * share > HELD_BYTES

        def flush(last: bool = False) -> Iterator[pa.RecordBatch]:
            """Merges what is held, and hands it on if that is still much."""
            if held:
                held[:] = [_merged(held, len(groups))]
                if last or over(2):
                    yield from _packed(held[0], *map(list, zip(*groups)))
                    held.clear()
                    groups.clear()

        for batch in batches:
            for part in slices(batch):
                group = np.array([groups.setdefault(key, len(groups)) for key in zip(*(c.to_pylist() for c in part.columns[:2]))])
                texts = part.column(2)
                large = pc.greater(pc.binary_length(texts), STEP_BYTES).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(large).tolist():
                    n: Counter[bytes] = Counter()
                    for words in terms(texts[i].as_py()):
                        n.update(words)
                    if n:
                        held.append(Cells(pa.array(list(n), pa.binary()), np.arange(len(n)), np.full(len(n), group[i]),
                                          np.fromiter(n.values(), dtype=np.int64), np.ones(len(n), dtype=np.int64)))
                if large.any():
                    texts, group = texts.filter(pa.array(~large)), group[~large]
                if cells := step_counts(texts, group):
                    held.append(cells)
                if over(1):
                    yield from flush()
        yield from flush(last=True)

    text = filled(text_col).cast("binary").alias("text")
    return docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), text).mapInArrow(count, PARTIAL)


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def exact_share(count: str, total: str, kept: str) -> Column:
    """The smoothed share of a count, for columns of counts, their sum and the number of terms: in decimals where 64 bits may not do."""
    whole = f"1 + (({count} + {ADD}) * CAST({SCALE} AS DECIMAL(19, 0))) div (CAST({total} AS DECIMAL(20, 0)) + {ADD} * CAST({kept} AS DECIMAL(20, 0)))"
    short = f"1 + (({count} + {ADD}) * CAST({SCALE} AS BIGINT)) div ({total} + {ADD} * CAST({kept} AS BIGINT))"
    fits = f"{count} < {9 * 10**18 // SCALE - ADD} AND {total} < {10**18} AND {kept} < {10**18}"
    return F.expr(f"CASE WHEN {fits} THEN {short} ELSE {whole} END")


def _shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for the counts of runs, in Python's integers, once for each distinct count."""
    distinct, of = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + ADD) // (total + ADD * kept) for c in distinct.tolist()], dtype=np.int64)[of]


def run_lengths(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, counts) of the runs of a column of ``length`` places that is zero where no count is given."""
    column = np.zeros(length, dtype=np.int64)
    column[places] = counts
    ends = np.append(np.flatnonzero(np.diff(column)) + 1, length)
    return ends, column[ends - 1]


def columns(entries: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every group's column as runs: ``entries`` (lang, source, place, n), ``groups`` (lang, source, total, kept)."""
    blocks = groups.where("kept > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(kept - 1) div {block}"))).alias("block"))
    cells = entries.select("lang", "source", F.expr(f"place div {block}").alias("block"),
                           F.struct((F.col("place") % block).alias("place"), "n").alias("cell"))
    gathered = cells.groupBy("lang", "source", "block").agg(F.collect_list("cell").alias("cells"))

    def encode(rows: Rows) -> Iterator[Rows]:
        out: Rows = {"lang": rows["lang"], "source": rows["source"], "block": rows["block"], "ends": [], "counts": [], "shares": []}
        for number, cells, total, kept in zip(rows["block"], rows["cells"], rows["total"], rows["kept"]):
            places = np.array([c["place"] for c in cells or ()], dtype=np.int64)
            counts = np.array([c["n"] for c in cells or ()], dtype=np.int64)
            ends, counts = run_lengths(places, counts, min(block, kept - number * block))
            for name, values in (("ends", ends), ("counts", counts), ("shares", _shares(counts, total, kept))):
                out[name].append(values)
        yield out

    return map_rows(blocks.join(gathered, ["lang", "source", "block"], "left"), COLUMN, encode,
                    **{c: c for c in ("lang", "source", "block", "cells", "total", "kept")})


def distance(ends: np.ndarray, shares: np.ndarray, other_ends: np.ndarray, other_shares: np.ndarray) -> int:
    """Sum over all places of the difference of two columns, a piece of equal counts at a time."""
    cuts = np.union1d(ends, other_ends)
    gaps = np.abs(shares[np.searchsorted(ends, cuts)] - other_shares[np.searchsorted(other_ends, cuts)])
    return int((gaps * np.diff(cuts, prepend=0)).sum())


def compared(runs: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, source, other, value) for each two sources of a language, the lesser name first.

    Sources of a language fall into tiles; every two tiles, and each with itself, meet once a block.
    """
    tiles = runs.groupBy("lang").agg(F.ceil(F.count_distinct("source") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    spread = runs.join(tiles, "lang").withColumn("own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = spread.select("lang", "block", F.least("own", "_with").alias("low"), F.greatest("own", "_with").alias("high"), "source", "own",
                           "ends", "shares")
    arrow = to_arrow_schema(_parse_datatype_string(PAIRED))

    def sums(table: pa.Table) -> pa.Table:
        lists = []
        for name in ("ends", "shares"):
            column = table.column(name).combine_chunks()
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            lists.append([values[a:b] for a, b in zip(offsets, offsets[1:])])
        names, tile_of = table.column("source").to_pylist(), table.column("own").to_pylist()
        lang, within = table.column("lang")[0].as_py(), table.column("low")[0] == table.column("high")[0]
        order = sorted(range(len(names)), key=names.__getitem__)
        out = [(lang, names[i], names[j], distance(lists[0][i], lists[1][i], lists[0][j], lists[1][j]))
               for k, i in enumerate(order) for j in order[k + 1:] if within or tile_of[i] != tile_of[j]]
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, arrow)], schema=arrow)

    parts = placed.groupBy("lang", "block", "low", "high").applyInArrow(sums, PAIRED)
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def _ranks(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
          top: int = TOP, block: int = BLOCK, tile: int = TILE, held_terms: int = HELD_TERMS) -> DataFrame:
    """Per group: its distance to each other source (``pair``), its most overused terms (``term``)."""
    parts = partial_counts(docs, text_col, lang_col, source_col, held_terms).withColumn("key", F.xxhash64("lang", "term"))
    # One shuffle: documents are summed, rare terms leave and sources are counted where a term's parts lie.
    # The key comes first because equal languages make a sort compare whole rows.
    own = ["key", "lang", "term"]
    known = parts.withColumn("docs", F.sum("docs").over(Window.partitionBy(*own))).where(F.col("docs") >= min_docs)
    cells = known.select(*own, F.explode("cells").alias("cell")).select(*own, "cell.source", "cell.n")
    found = settle(cells.groupBy(*own, "source").agg(F.sum("n").alias("n")).drop("key"), "llm-term-counts")
    # One entry a source in a signature: as many as the result has pairs of one source.
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("signature"))
    vocabulary = settle(ranked(kept, [F.col("signature"), F.col("term")], ["lang"]).select(
        "lang", "term", "lang_n", (F.col("rank") - 1).cast("bigint").alias("place")), "llm-vocabulary")
    entries = settle(found.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "place"), "llm-entries")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = settle(
        docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source")).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]), "llm-groups")

    values = compared(settle(columns(entries, groups, block), "llm-columns"), tile)
    both = values.select("lang", "source", F.col("other").alias("item"), "value").unionByName(
        values.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    names = groups.select("lang", "source")
    others = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", zero))

    p, q = exact_share("n", "total", "kept"), exact_share("lang_n", "lang_total", "kept")
    over = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
    words = _ranks(over.where("value > 0"), "term").where(F.col("rank") <= top)
    return _ranks(pairs, "pair").unionByName(words)


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same rows from dense columns of counts."""
    share = f"1 + ({SCALE}::HUGEINT * ({{c}} + {ADD})) // ({{n}} + {ADD} * v)"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS found FROM documents),
occ AS (SELECT doc_id, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_c FROM occ GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {min_docs}),
size AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
cell AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY ALL),
dense AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(cell.c, 0) AS c, {share.format(c="coalesce(cell.c, 0)", n="coalesce(total.n, 0)")} AS p,
         {share.format(c="lang_c", n="lang_n")} AS q
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN cell USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b
         ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE c > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR rank <= {top}"""
