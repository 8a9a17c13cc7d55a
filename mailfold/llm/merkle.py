"""Merkle fingerprints over sections, paragraphs and blocks of a text (dealt operator 6).

A paragraph is a line; a section ends at an empty line, or after a paragraph whose digest
falls in one class of four.  Paragraphs are cut into blocks of about eight words at places
that the four bytes before them choose.  All cuts depend on nearby content alone, so an edit changes the
blocks it touches, their paragraph and section and the root, and leaves other branches as
they were.  Digests are BLAKE2b of 16 bytes, and each level hashes the whole digests of the one below.

A fingerprint is text: the root digest, then the first bytes of the blocks' digests with
their lengths, sections separated by ``/``, paragraphs by ``;`` and blocks by ``,``.  Equal
roots mean equal texts as surely as 16 bytes can; two blocks of a branch are told apart by
the bytes printed.  :func:`likeness` is the share of characters in blocks that both trees hold (Dice), and
:func:`differences` walks down the branches that differ to the spans of an edit.

Defined results: a null text counts as empty; two empty texts are alike (1.0); the successor
of a row is the next in descending order of id, then of a hash of the text, and the first
row follows the last; a single row follows itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from mailfold.llm.common import map_rows
from mailfold.session import settle

BLOCK_WORDS = 8
SECTION_PARAGRAPHS = 4
#: Bytes of a digest, and of a block's digest as it is printed.
DIGEST = 16
BLOCK_DIGEST = 5

Tree = list[list[list[tuple[str, int]]]]


def _digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=DIGEST).hexdigest()


def block_cuts(data: np.ndarray) -> np.ndarray:
    """Places, in bytes, before which a block begins: after a line break, and after a space
    (or before a letter of three bytes or more) where the four bytes before it say so."""
    wide = data >= 0xE0
    at = np.flatnonzero((data == 0x20) | wide)
    at = at[at >= 4]
    context = np.zeros(len(at), dtype=np.uint32)
    for back in range(1, 5):
        context = context * np.uint32(0x01000193) ^ data[at - back]
    context *= np.uint32(0x9E3779B1)
    chosen = at[(context >> np.uint32(16)) % (BLOCK_WORDS * (1 + wide[at])) == 0]
    chosen = chosen + (data[chosen] == 0x20)
    cuts = np.concatenate([[0], chosen, np.flatnonzero(data == 0x0A) + 1, [len(data)]])
    return np.unique(cuts[cuts <= len(data)])


def tree(text: str) -> Tree:
    """Sections of paragraphs of (digest, characters) of blocks."""
    source = text.encode()
    cuts = block_cuts(np.frombuffer(source, dtype=np.uint8)).tolist()
    ascii_only = text.isascii()
    sections: Tree = [[]]
    paragraph: list[tuple[str, int]] = []
    blank = False
    for a, b in zip(cuts, cuts[1:]):
        block = source[a:b]
        paragraph.append((_digest(block), b - a if ascii_only else len(block.decode())))
        if block.endswith(b"\n") or b == len(source):
            empty = block == b"\n" and len(paragraph) == 1
            if sections[-1] and blank and not empty:
                sections.append([])
            sections[-1].append(paragraph)
            blank = empty
            if int(_paragraph(paragraph)[:8], 16) % SECTION_PARAGRAPHS == 0:
                sections.append([])
            paragraph = []
    return [s for s in sections if s]


def _paragraph(blocks: list[tuple[str, int]]) -> str:
    return _digest("".join(d for d, _ in blocks).encode())


def _section(paragraphs: list[list[tuple[str, int]]]) -> str:
    return _digest("".join(map(_paragraph, paragraphs)).encode())


def root(t: Tree) -> str:
    return _digest("".join(map(_section, t)).encode())


def fingerprint(text: str | None) -> str:
    t = tree(text or "")
    body = "/".join(";".join(",".join(f"{d[:2 * BLOCK_DIGEST]}{n:x}" for d, n in p) for p in s) for s in t)
    return f"{root(t)}:{body}"


def parse(print_: str) -> tuple[str, Tree]:
    head, body = print_.split(":")
    width = 2 * BLOCK_DIGEST
    one = lambda x: (x[:width], int(x[width:], 16))
    return head, [[[one(x) for x in p.split(",")] for p in s.split(";")] for s in body.split("/")] if body else []


def likeness(one: str, other: str) -> float:
    """2 x characters in shared blocks / characters of both; 1.0 exactly for equal roots."""
    (root_a, a), (root_b, b) = parse(one), parse(other)
    if root_a == root_b:
        return 1.0
    count_a, count_b = (Counter(x for s in t for p in s for x in p) for t in (a, b))
    total = sum(n * c for count in (count_a, count_b) for (_, n), c in count.items())
    shared = sum(x[1] * min(c, count_b[x]) for x, c in count_a.items() if x in count_b)
    return 2 * shared / total if total else 1.0


def differences(one: str, other: str) -> list[tuple[int, int]]:
    """Spans of the first text that lie in branches the second tree does not hold.

    Branches with a digest that the other tree holds at the same level are not entered.
    """
    (root_a, a), (root_b, b) = parse(one), parse(other)
    if root_a == root_b:
        return []
    held_sections, held_paragraphs = Counter(map(_section, b)), Counter(_paragraph(p) for s in b for p in s)
    held_blocks = Counter(d for s in b for p in s for d, _ in p)

    def take(held: Counter, digest: str) -> bool:
        held[digest] -= 1
        return held[digest] >= 0

    same = []  # for each paragraph, whether it or its section is held as a whole
    for s in a:
        whole = take(held_sections, _section(s))
        for p in s:
            same.append(take(held_paragraphs, _paragraph(p)) or whole)
            if same[-1]:
                held_blocks.subtract(d for d, _ in p)
    spans: list[tuple[int, int]] = []
    at = 0
    for p, whole in zip((p for s in a for p in s), same):
        for digest, n in p:
            if not whole and not take(held_blocks, digest):
                if spans and spans[-1][1] == at:
                    spans[-1] = spans[-1][0], at + n
                else:
                    spans.append((at, at + n))
            at += n
    return spans


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_SEAM = RESULT + ", part int, role string, text string"


def _result(doc_id, text: str, own: str, following: str, next_print: str) -> dict:
    new = edited(text, following)
    new_print = fingerprint(new)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
        "fingerprint": own, "edited_fingerprint": new_print, "near_edited": likeness(own, new_print),
        "near_next": likeness(own, next_print),
    }


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _pressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, a hash of the text to order equal ids by, and the text compressed: it is about to move."""
    def run(rows):
        press = zstandard.ZstdCompressor(level=3).compress
        yield {"doc_id": rows["doc_id"], "tie": rows["tie"], "body": [press((t or "").encode()) for t in rows["text"]]}

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return map_rows(keyed, "doc_id bigint, tie bigint, body binary", run, doc_id="doc_id", tie="tie", text="text")


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to it and to the next text.

    Texts are compressed and dealt out by ranges of the descending order once; inside a range each row meets
    its successor while rows stream by.  The last row of a range and the first of the next
    one are written out and joined on the number of the range.
    """
    arrow = to_arrow_schema(_parse_datatype_string(_SEAM))
    result = to_arrow_schema(_parse_datatype_string(RESULT))
    empty = {f.name: None for f in arrow}

    def stream(batches):
        part = TaskContext.get().partitionId()

        def rows():
            last, open_ = None, zstandard.ZstdDecompressor().decompress
            for doc_id, _, body in _rows(batches):
                text = open_(body).decode()
                own = fingerprint(text)
                if last is None:
                    yield empty | {"part": part, "role": "head", "text": text}
                else:
                    yield empty | _result(*last, text, own)
                last = doc_id, text, own
            if last is not None:
                yield empty | {"part": part, "role": "tail", "doc_id": last[0], "text": last[1]}

        return _batches(rows(), arrow)

    def close(batches):
        def rows():
            for doc_id, text, following in _rows(batches):
                yield _result(doc_id, text, fingerprint(text), following, fingerprint(following))

        return _batches(rows(), result)

    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = _pressed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = settle(dealt.mapInArrow(stream, _SEAM), "llm-merkle", compression="zstd")
    # As many numbers as there are ranges, not rows.
    parts = sorted(r["part"] for r in streamed.where("role = 'head'").select("part").collect())
    after = list(zip(parts, parts[1:] + parts[:1]))
    links = spark.createDataFrame(after, "part int, next_part int")
    heads = streamed.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    seams = streamed.where("role = 'tail'").select("part", "doc_id", "text").join(F.broadcast(links), "part").join(heads, "next_part")
    closed = seams.select("doc_id", "text", "following").mapInArrow(close, RESULT)
    return streamed.where("role IS NULL").select(*closed.columns).unionByName(closed)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row, without a shuffle."""
    def run(rows):
        yield {"doc_id": rows["doc_id"], "fingerprint": [fingerprint(t) for t in rows["text"]]}

    return map_rows(docs, "doc_id bigint, fingerprint string", run, doc_id=id_col, text=text_col)
