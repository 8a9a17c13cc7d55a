"""Weighted word shingles of texts, computed for many texts at once."""

from __future__ import annotations

import re

import numpy as np

from mailfold.llm.common import mix64

WORDS = 5
#: Shingle identities have 52 bits, so that a text's number within a batch fits beside them.
ID_BITS = 52
BATCH_TEXTS = 1 << (64 - ID_BITS)

_STRANGE = re.compile(r"[^\w\x00-\x7f]")
_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text).  Words are maximal runs of letters and digits,
    lower-cased; a hash is that of a polynomial over the word's bytes."""
    plain = [t.lower() for t in texts]
    raw = [(t if t.isascii() else _STRANGE.sub(" ", t)).encode() for t in plain]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    powers = np.full(len(data), _BASE, dtype=np.uint64)
    powers[0] = 1
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(np.cumprod(powers) * (data + np.uint64(1)), dtype=np.uint64)])
    powers[1:] = _BASE_INVERSE
    back = np.cumprod(powers)[starts]
    hashes = mix64((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))
    bounds = np.cumsum(np.array([len(r) + 1 for r in raw]))
    return hashes, np.searchsorted(bounds, starts, side="right")


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(shingle identity, its text's number, its weight, the word hashes of every text).

    A weight is the number of times the text holds the shingle.  A text of fewer words than a
    shingle has one shingle, all its words; a text without words has none.
    """
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    length = np.minimum(counts, words)[text]
    mixed = length.astype(np.uint64)
    for k in range(words):
        there = k < length
        part = hashes[np.where(there, first + k, 0)] if len(hashes) else mixed
        mixed = mixed + np.where(there, part * _PLACES[k % len(_PLACES)] ^ np.uint64(k), np.uint64(0))
    key = (text.astype(np.uint64) << np.uint64(ID_BITS)) | (mix64(mixed) >> np.uint64(64 - ID_BITS))
    key.sort()
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    weights = np.diff(np.append(fresh, len(key))).astype(np.float64)
    unique = key[fresh]
    contents = [hashes[a : a + n].tobytes() for a, n in zip(begin.tolist(), counts.tolist())]
    return unique & np.uint64((1 << ID_BITS) - 1), (unique >> np.uint64(ID_BITS)).astype(np.int64), weights, contents


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over e of max(wa[e]/wa[d], wb[e]/wb[d]); sets of shingles
    without repetitions give their Jaccard similarity.  Identities are sorted; 1.0 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = a[at] == b
    n = int(shared.sum())
    if not n:
        return 0.0
    if wa.max() == wa.min() == 1 and wb.max() == wb.min() == 1:
        return n / (len(a) + len(b) - n)
    x, y = wa[at[shared]], wb[shared]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.searchsorted(ratio, ratio, side="right")  # elements whose ratio is at most this one's
    sum_x, rest_y = np.cumsum(x), np.append(np.cumsum(y[::-1])[::-1], 0.0)
    return float((x / (only_a + sum_x[below - 1] + (rest_y[below] + only_b) / ratio)).sum())
