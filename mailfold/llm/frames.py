"""Fill-in-the-middle over seekable compressed frames (dealt operator 11).

A unit is a word with the white space before it; white space at the end is a unit of its
own.  :func:`framed` stores a text as independent zstandard frames, each ending with a unit,
and the counts of units, characters and bytes before every frame.  A cut after any unit is
then found by decompressing the one frame that holds it.  :func:`transformed` draws the cuts
and the form from a hash of seed and id, and streams the frames in the order of the form, so
no step holds more of a text than a frame beside its compressed frames.

    plain  the text          psm  <P>prefix<S>suffix<M>middle          spm  <S>suffix<P>prefix<M>middle

:func:`restored` undoes a stream of output: what follows ``<S>`` is held back compressed and
comes last.  As a text with a mark in it stays plain, the marks found are those put in.

Defined results: a null text is an empty one, has no frame and stays plain; a unit longer
than a frame gets a frame of its own; rows of one id draw alike; a null id draws as the
empty string; every row of the input gives one row, an empty table none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfold.llm.common import Rows, map_rows

#: Bytes after which the unit being read ends its frame.
FRAME_BYTES = 65_536
SEED = 42
#: Percent of the texts that are cut, and percent of those in the order spm.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))
LONGEST_MARK = max(map(len, (PREFIX, SUFFIX, MIDDLE)))

FRAMES = "doc_id BIGINT, units ARRAY<BIGINT>, chars ARRAY<BIGINT>, places ARRAY<BIGINT>, frames BINARY"
OUTPUT = ("doc_id BIGINT, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output_sha256 STRING, "
          "restored_sha256 STRING, output STRING")

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of UTF-8 that begin a character.
_FIRST = np.ones(256, dtype=bool)
_FIRST[0x80:0xC0] = False


def unit_ends(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of UTF-8 text end."""
    if not data:
        return np.zeros(0, dtype=np.int64)
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(data))


def count_chars(data: bytes) -> int:
    return int(np.count_nonzero(_FIRST[np.frombuffer(data, dtype=np.uint8)])) if data else 0


def to_frames(data: bytes, size: int = FRAME_BYTES) -> tuple[list[int], list[int], list[int], bytes]:
    """(units, characters and bytes before each frame and in all, the frames in a row)."""
    pack = zstandard.ZstdCompressor(level=3)
    ends = unit_ends(data)
    units, chars, places, frames, at = [0], [0], [0], [], 0
    while at < len(data):
        last = min(int(np.searchsorted(ends, at + size)), len(ends) - 1)
        part = data[at:int(ends[last])]
        frames.append(pack.compress(part))
        units.append(last + 1)
        chars.append(chars[-1] + count_chars(part))
        places.append(places[-1] + len(frames[-1]))
        at += len(part)
    return units, chars, places, b"".join(frames)


class Seekable:
    """The frames of one text; a cut is (frame, byte in it, characters before it)."""

    def __init__(self, units: list[int], chars: list[int], places: list[int], frames: bytes):
        self.units, self.chars, self.places, self.frames = units, chars, places, frames
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        return self.unpack.decompress(self.frames[self.places[i]:self.places[i + 1]])

    def cut(self, units: int) -> tuple[int, int, int]:
        """Where the first ``units`` units end."""
        i = bisect_right(self.units, units) - 1
        if self.units[i] == units:
            return i, 0, self.chars[i]
        data = self.frame(i)
        byte = int(unit_ends(data)[units - self.units[i] - 1])
        return i, byte, self.chars[i] + count_chars(data[:byte])

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> Iterator[bytes]:
        for i in range(a[0], b[0] + bool(b[1])):
            data = self.frame(i)
            yield data[a[1] if i == a[0] else 0:b[1] if i == b[0] else len(data)]

    def whole(self) -> Iterator[bytes]:
        return self.between((0, 0, 0), (len(self.units) - 1, 0, 0))

    def marked(self) -> bool:
        """Whether a mark occurs in the text, also across frames."""
        end = b""
        for data in self.whole():
            if MARKS.search(end + data[:LONGEST_MARK]) or MARKS.search(data):
                return True
            end = data[-LONGEST_MARK:]
        return False


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: Seekable, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[str, int | None, int | None, Iterator[bytes]]:
    """(form, characters of prefix and middle, the output as a stream)."""
    n, (one, two, form, order) = text.units[-1], draws(seed, doc_id)
    if not n or form % 100 >= rate or text.marked():
        return "plain", None, None, text.whole()
    zero, end = (0, 0, 0), (len(text.units) - 1, 0, text.chars[-1])
    a, b = (text.cut(k) for k in sorted((one % (n + 1), two % (n + 1))))
    parts = {PREFIX: (zero, a), SUFFIX: (b, end), MIDDLE: (a, b)}
    name, marks = ("spm", (SUFFIX, PREFIX, MIDDLE)) if order % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))

    def stream() -> Iterator[bytes]:
        for mark in marks:
            yield mark
            yield from text.between(*parts[mark])

    return name, a[2], b[2] - a[2], stream()


def _by_mark(stream: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(mark, bytes after it); a mark may lie across two parts of the stream."""
    mark, rest = b"", b""
    for part in stream:
        rest += part
        at = 0
        for m in MARKS.finditer(rest):
            yield mark, rest[at:m.start()]
            mark, at = m[0], m.end()
        safe = max(at, len(rest) - LONGEST_MARK + 1)
        yield mark, rest[at:safe]
        rest = rest[safe:]
    yield mark, rest


def restored(stream: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The text that an output of this form was made from."""
    if form == "plain":
        yield from stream
        return
    pack, unpack, held = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), []
    for mark, part in _by_mark(stream):
        if mark == SUFFIX:
            held.append(pack.compress(part))
        else:
            yield part
    for part in held:
        yield unpack.decompress(part)


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME_BYTES) -> DataFrame:
    """Ids and the frames of their texts, a row for each row of ``docs``."""

    def store(rows: Rows) -> Iterator[Rows]:
        made = [to_frames(text or b"", size) for text in rows["text"]]
        units, chars, places, frames = (list(x) for x in zip(*made))
        yield {"doc_id": rows["id"], "units": units, "chars": chars, "places": places, "frames": frames}

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_rows(plain, FRAMES, store, id="id", text="text")


def transformed(frames: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, texts: bool = True) -> DataFrame:
    """Cuts, form, digests of the output and of the text restored from it; with ``texts`` the output too."""

    def draw(rows: Rows) -> Iterator[Rows]:
        out: Rows = {c.split()[0]: [] for c in OUTPUT.split(", ")}
        for doc_id, units, chars, places, data in zip(*(rows[c] for c in ("doc_id", "units", "chars", "places", "frames"))):
            form, prefix, middle, stream = arranged(Seekable(units, chars, places, data), doc_id, seed, rate, spm)
            made, back, kept = hashlib.sha256(), hashlib.sha256(), []

            def seen(stream=stream, made=made, kept=kept) -> Iterator[bytes]:
                for part in stream:
                    made.update(part)
                    if texts:
                        kept.append(part)
                    yield part

            for part in restored(seen(), form):
                back.update(part)
            row = (doc_id, units[-1], form, prefix, middle, made.hexdigest(), back.hexdigest(), b"".join(kept).decode() if texts else None)
            for c, v in zip(out, row):
                out[c].append(v)
        yield out

    return map_rows(frames, OUTPUT, draw, **{c: c for c in ("doc_id", "units", "chars", "places", "frames")})


def oracle_sql(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """The same columns from lists of units, without frames."""
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR h3 % 100 >= {rate} OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts"""
