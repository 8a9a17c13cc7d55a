"""Sentencepiece encoding that keeps source offsets, and decoding (dealt operator 9).

Normalisation goes through the model's compiled character map: at every place the longest
key of its double-array trie is replaced by its value, any other character stands for
itself, and for every normalised byte the source byte it came from is recorded.  Then come
the model's white-space rules: runs squeezed, a leading mark, spaces written as the mark.
Ids are those of the library; a piece covers as many normalised bytes as it is long, and the
recorded alignment projects it to a span of the original UTF-8 bytes.

Defined results: a null text counts as empty (begin and end id alone); repeated rows are
encoded once for each row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from mailfold.llm.common import map_rows

MARK = "▁"
_MARK_BYTES = MARK.encode()
_BAD_BYTES = "�".encode()

ENCODED = "doc_id bigint, ids binary, spans binary, decoded string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 keys, and its values."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.values = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key that starts at ``at``, its value)."""
        units, found = self.units, None
        if not units:
            return None
        node = _step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= _step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.values[start : self.values.index(b"\0", start)]


def _step(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """``align(source)`` -> (normalised bytes, source offset of each of them and of the end)."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = _MARK_BYTES if escape else b" "

    def _next(self, source: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(source, at)
        if hit:
            return hit
        lead = source[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return width, source[at : at + width]

    def align(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units and not self.squeeze:
            return self._align_plain(source)
        out, places, at, space = bytearray(), [], 0, self.space
        if self.squeeze:  # leading spaces go
            while at < len(source):
                width, value = self._next(source, at)
                if value != b" ":
                    break
                at += width
        if at >= len(source):
            return b"", np.zeros(1, dtype=np.int64)  # as the library has it
        if self.dummy_prefix:
            out += space
            places += [at] * len(space)
        after_space = self.squeeze
        while at < len(source):
            width, value = self._next(source, at)
            if after_space:
                value = value.lstrip(b" ")
            for byte in value:
                piece = space if byte == 0x20 else bytes((byte,))
                out += piece
                places += [at] * len(piece)
            if value:
                after_space = self.squeeze and value.endswith(b" ")
            at += width
        if self.squeeze:  # trailing spaces go
            while out.endswith(space):
                at = places[-len(space)]
                del out[-len(space) :], places[-len(space) :]
        return bytes(out), np.array([*places, at], dtype=np.int64)

    def _align_plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no squeezing: every byte stands for itself, a space for the mark."""
        if not source:
            return b"", np.zeros(1, dtype=np.int64)
        data = np.frombuffer(source, dtype=np.uint8)
        widths = np.where(data == 0x20, len(self.space), 1)
        places = np.repeat(np.arange(len(data), dtype=np.int64), widths)
        prefix = np.zeros(len(self.space) if self.dummy_prefix else 0, dtype=np.int64)
        text = (self.space if self.dummy_prefix else b"") + source.replace(b" ", self.space)
        return text, np.concatenate([prefix, places, [len(data)]])


class PieceCodec:
    """A sentencepiece model with offsets into the original bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normaliser = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix,
                                     spec.remove_extra_whitespaces, spec.escape_whitespaces)
        unknown, byte = 2, 6  # piece types of the model format
        self.widths = np.array([0 if p.type == unknown else 1 if p.type == byte else len(p.piece.encode())
                                for p in proto.pieces], dtype=np.int64)
        self.unknown = self.model.unk_id()

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, num_threads=1), dtype="<u4")

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(begin, end) source bytes of every piece.

        A piece begins where its first byte came from and ends where the next piece begins,
        so the spans of a text follow each other without gaps.
        """
        normal, places = self.normaliser.align(text.encode())
        widths = self.widths[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():
            widths = self._with_unknown(normal, ids, widths)
        edges = np.concatenate([[0], np.cumsum(widths)])
        if edges[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        cut = places[edges]
        return np.stack([cut[:-1], cut[1:]], axis=1)

    def _with_unknown(self, normal: bytes, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to where the known piece after it is found again."""
        widths, at = widths.copy(), 0
        for i, piece in enumerate(ids.tolist()):
            if piece == self.unknown:
                end = len(normal)
                if i + 1 < len(ids) and ids[i + 1] != self.unknown:
                    end = normal.index(self.model.id_to_piece(int(ids[i + 1])).encode(), at + 1)
                widths[i] = end - at
            at += int(widths[i])
        return widths

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@functools.lru_cache(maxsize=4)
def load(path: str) -> PieceCodec:
    """One instance for each Python worker."""
    return PieceCodec(path)


def _run(docs: DataFrame, schema: str, model: str | None, id_col: str, text_col: str, row) -> DataFrame:
    path = model or default_model()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows):
        codec = load(path)
        ends = np.array([codec.model.bos_id()], "<i4"), np.array([codec.model.eos_id()], "<i4")
        out = {k: [] for k in names}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            text = text or ""
            inner = codec.encode(text)
            ids = np.concatenate([ends[0].astype("<u4"), inner, ends[1].astype("<u4")])
            spans = codec.spans(text, inner).astype("<u4")
            for key, value in zip(names, (doc_id, *row(ids, spans, codec.decode(ids)))):
                out[key].append(value)
        yield out

    return map_rows(docs, schema, run, doc_id=id_col, text=text_col)


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids with begin and end id (little-endian unsigned 32-bit), the (begin, end) source bytes
    of every piece between them (likewise), and the decoded text."""
    return _run(docs, ENCODED, model, id_col, text_col, lambda ids, spans, text: (ids.tobytes(), spans.tobytes(), text))


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and SHA-256 digests of what :func:`encoded` gives, made in the same task."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return _run(docs, schema, model, id_col, text_col,
                lambda ids, spans, text: (len(ids), sha(ids.tobytes()), sha(text.encode()), sha(spans.tobytes())))
