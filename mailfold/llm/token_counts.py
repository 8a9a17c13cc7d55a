"""Token counts of document sections by offset mapping (dealt operator 2).

A document is encoded once, as a whole, because the tokens of a part encoded alone differ at
its edges.  Every token covers a span of characters; sections cover the text without gaps;
the spans are interval-joined by binary search over the section bounds.  A token that
crosses a bound goes to the section that holds most of its bytes, the earliest of those on
a tie.  The counts of a document's sections therefore add up to its token count.

Sections are the lines of a text, each with the line break that ends it; a run of empty
lines belongs to the line before it.  A text of no tokens has one empty section.

Defined results: a null text counts as empty; repeated rows are counted once for each row;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from mailfold.llm import byte_bpe
from mailfold.llm.common import map_rows

SECTIONS = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint, n_doc_tokens bigint"

_LINE = re.compile(r"\n*[^\n]+\n*|\n+")


def sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of ``text``; together they cover it."""
    return [m.span() for m in _LINE.finditer(text)] or [(0, 0)]


def allocate(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether it crosses a bound.

    ``ends`` are the byte ends of consecutive tokens, ``bounds`` those of consecutive sections.
    """
    starts = np.concatenate([np.zeros(1, dtype=np.int64), ends])[:-1]
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends, side="left")
    owner = first.copy()
    for i in np.nonzero(last > first)[0].tolist():
        edges = np.concatenate([[starts[i]], bounds[first[i] : last[i]], [ends[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return owner, last > first


def section_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section: its character span, its tokens, those of them that cross a
    bound, and the tokens of the whole document."""
    path = vocabulary or byte_bpe.default_vocabulary()

    def run(rows):
        encoder = byte_bpe.load(path)
        out = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_doc_tokens")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            text = text or ""
            ids, spans = encoder.ids(text), sections(text)
            bounds = np.array([b for _, b in spans], dtype=np.int64)
            if not text.isascii():
                sizes = np.array([len(text[a:b].encode()) for a, b in spans], dtype=np.int64)
                bounds = np.cumsum(sizes)
            owner, crossing = allocate(np.cumsum(encoder.byte_lengths[ids]), bounds)
            n = len(spans)
            out["doc_id"] += [doc_id] * n
            out["section"] += range(n)
            out["start"] += [a for a, _ in spans]
            out["end"] += [b for _, b in spans]
            out["n_tokens"] += np.bincount(owner, minlength=n).tolist()
            out["n_crossing"] += np.bincount(owner[crossing], minlength=n).tolist()
            out["n_doc_tokens"] += [len(ids)] * n
        yield out

    return map_rows(docs, SECTIONS, run, doc_id=id_col, text=text_col)
