"""Language identification by compression (dealt operator 7).

Each language has a raw-content zstandard dictionary made of excerpts of labelled texts.  A
text is compressed, in blocks, against every dictionary; the language whose dictionary
leaves the fewest bytes is chosen.  The margin is the part by which the second smallest size
exceeds the smallest; a text with a narrow margin is rejected as undecided.

Text is lower-cased and everything but letters becomes a space first, so that markup,
digits and capitals say nothing about the language.  All of a text counts: blocks keep the
dictionary within reach at any length.

Only the dictionaries come from a bounded sample of labelled rows (``STRATA`` x
``STRATUM_ROWS`` a language, ``EXCERPT_CHARS`` characters of each, ``DICTIONARY_BYTES`` in
all), taken in order of a hash of the document id, so that the choice does not depend on
partitions, and by strata of that hash, so that no language meets in one task.

Defined results: null text or text without a letter gets ``und``, score 0, and is rejected;
equal sizes go to the alphabetically first language with score 0 (rejected); without a
single labelled text every prediction is ``und``; repeated rows get a result each.
"""

from __future__ import annotations

import functools
import re

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfold.llm.common import map_rows

#: A language's sample: so many rows from each of so many strata of the hash of the id.
STRATA = 60
STRATUM_ROWS = 10
EXCERPT_CHARS = 300
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 4096
LEVEL = 5
MIN_MATCH = 3
NARROW = 0.005
UNDECIDED = "und"

Dictionaries = tuple[tuple[str, bytes], ...]

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The letters of a text in lower case, one space for everything between them.

    Word characters include signs for numbers (superscripts, fractions, Roman numerals), which
    are no letters; they are rare, so they are looked for in one test of the whole text.
    """
    plain = _NOT_LETTERS.sub(" ", text.lower())
    if not plain.replace(" ", "").isalpha():
        plain = "".join(c if c.isalpha() else " " for c in plain)
    return " ".join(plain.split())


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Dictionaries:
    """One dictionary a language from a bounded sample of ``docs`` where ``learnable`` holds.

    The sample is chosen on ids alone; only its texts are read.  Repeated excerpts count once.
    """
    order = F.xxhash64(F.col(id_col), F.lit("excerpt"))
    labelled = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("language"), order.alias("place"))
    best = Window.partitionBy("language", "stratum").orderBy("place", "id")
    ranked = keyed.withColumn("stratum", F.pmod("place", F.lit(STRATA))).withColumn("n", F.row_number().over(best))
    chosen = ranked.where(F.col("n") <= STRATUM_ROWS).select("id", "language", "place")
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("language"), F.col(text_col).alias("text"))
    sampled = texts.join(F.broadcast(chosen.distinct()), ["id", "language"])
    excerpts = map_rows(sampled, "language string, place bigint, excerpt string", _excerpts, language="language", place="place", text="text")
    parts: dict[str, dict[str, None]] = {}
    for row in sorted(set(excerpts.collect()), key=lambda r: (r.language, r.place, r.excerpt)):
        parts.setdefault(row.language, {})[row.excerpt] = None
    return tuple((name, " ".join(found).encode()[:DICTIONARY_BYTES]) for name, found in sorted(parts.items()))


def _excerpts(rows):
    out = {"language": rows["language"], "place": rows["place"], "excerpt": []}
    for text in rows["text"]:
        plain = letters(text)
        start = max(0, (len(plain) - EXCERPT_CHARS) // 2)
        out["excerpt"].append(plain[start : start + EXCERPT_CHARS])
    yield out


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: Dictionaries) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, content in dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=BLOCK_BYTES, min_match=MIN_MATCH, write_content_size=False)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
        if known:
            known.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(compression_params=params, dict_data=known)))
    return out


def identify(text: str | None, dictionaries: Dictionaries) -> tuple[str, float]:
    """(language, margin from 0 to 1) of one text."""
    plain = letters(text or "").encode()
    if not plain or not dictionaries:
        return UNDECIDED, 0.0
    blocks = [plain[i : i + BLOCK_BYTES] for i in range(0, len(plain), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in _compressors(dictionaries))
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def predicted(docs: DataFrame, dictionaries: Dictionaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``."""
    def run(rows):
        found = [identify(t, dictionaries) for t in rows["text"]]
        yield {"doc_id": rows["doc_id"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found],
               "rejected": [a == UNDECIDED or b < NARROW for a, b in found]}

    return map_rows(docs, "doc_id bigint, lang_pred string, score double, rejected boolean", run, doc_id=id_col, text=text_col)


def keep_decided(docs: DataFrame, dictionaries: Dictionaries, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is decided."""
    @F.udf("boolean", useArrow=True)
    def decided(text):
        name, margin = identify(text, dictionaries)
        return name != UNDECIDED and margin >= NARROW

    return docs.where(decided(F.col(text_col)))
