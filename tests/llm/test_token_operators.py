"""Operators 2, 4, 6, 9 against plain versions of what they promise."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailfold.llm import byte_bpe, merkle, packing, sentence_pieces, token_counts

TEXTS = [
    "one two three\nfour five", "", None, "a" * 3000 + "\n\n" + "word " * 4000, "one two three\nfour five", "Éé ü 中文 — ok\n\n\n \t x",
    " lead and trail ", "no break", "\n\n", "x\n" * 50,
]
SCHEMA = "doc_id bigint, text string, n_tokens string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, "clash", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(7, "", "clash", None), (None, "no id", None, None)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.load(byte_bpe.default_vocabulary()).tokenizer


def test_byte_bpe_equals_the_library(tokenizer):
    rng, codec = random.Random(3), byte_bpe.load(byte_bpe.default_vocabulary())
    letters = "  \n\tab'sé1. \x85\xa0\x1c-中٣"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert codec.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("<|endoftext|> x", "don't we'll", "x" * 2000):
        assert codec.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_a_fresh_library_tokenizer(spark):
    from tokenizers import Tokenizer

    path = byte_bpe.default_vocabulary()
    fresh, codec = Tokenizer.from_file(path), byte_bpe.load(path)
    rng, parts = random.Random(5), ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n", "a", "é", "中", "word"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1000))]
    for text in texts:
        ids = fresh.encode(text, add_special_tokens=False).ids
        assert codec.ids(text).tolist() == ids, repr(text)
        assert codec.byte_lengths[ids].sum() == len(text.encode()), repr(text)
    assert codec.ids(texts[0]).tolist() == [64, 220, 50256, 275]
    one = spark.createDataFrame([(1, "a <|endoftext|>\nb")], "doc_id bigint, text string")
    want = fresh.encode("a <|endoftext|>\nb", add_special_tokens=False).ids
    assert [r.n_doc_tokens for r in token_counts.section_counts(one).collect()] == [len(want)] * 2
    crc = zlib.crc32(np.array(want + [0], dtype="<u4").tobytes())
    assert [(r.length, r.ids_crc32) for r in packing.packed(one).collect()] == [(len(want) + 1, crc)]


def test_section_counts_add_up(docs, tokenizer):
    rows = token_counts.section_counts(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        if i * 7 == 7:
            continue
        parts = sorted(by_doc[i * 7], key=lambda r: r.section)
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert sum(p.n_tokens for p in parts) == len(want) == parts[0].n_doc_tokens
        assert [p.start for p in parts] == [0] + [p.end for p in parts][:-1] and parts[-1].end == len(text or "")
    assert None in by_doc and len(by_doc[7]) == 2


def test_boundary_tokens_go_to_the_larger_part_then_the_earlier():
    owner, crossing = token_counts.allocate(np.array([2, 6, 8, 10]), np.array([3, 7, 10]))
    assert owner.tolist() == [0, 1, 1, 2] and crossing.tolist() == [False, True, True, False]


def test_packing_covers_every_token_once(docs, tokenizer):
    rows = packing.packed(docs, capacity=64).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.sequence_id, []).append(r)
    for members in lists.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i * 7), key=lambda r: r.piece)
        if i * 7 == 7:
            assert len(own) == 2
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    total = sum(r.length for r in rows)
    assert len(lists) <= total / 64 + 3


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_and_stays_near_the_bound(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(60)}
    counts[100] = 17
    bins = packing.plan(counts, 100)
    used = {}
    for times, bin_ in bins:
        assert sum(bin_) <= 100
        for size in bin_:
            used[size] = used.get(size, 0) + times
    assert used == counts
    slots = packing.places(bins)
    for size, n in counts.items():
        covered = sorted((lo, hi) for s, lo, hi, _, _ in slots if s == size)
        assert covered[0][0] == 0 and covered[-1][1] == n and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_two_small_documents_replace_a_smallest_one():
    # greedy: 60 + 30 leaves 10; 20 + 20 in place of 30 fills the bin
    assert sorted(packing.plan({60: 1, 30: 1, 20: 2}, 100)[0][1]) == [20, 20, 60]


def test_packing_of_an_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_merkle_rows(docs):
    got = {(r.doc_id, r.n_chars): r for r in merkle.with_successors(docs).collect()}
    rows = [(i * 7, t or "") for i, t in enumerate(TEXTS)] + [(7, "")]
    assert len(got) == len({(a, len(b)) for a, b in rows} | {(None, 5)})
    order = [(None, "no id")] + sorted(rows, key=lambda r: r[0])
    order = order[::-1]
    for n, (doc, text) in enumerate(order[:8]):  # 63 down to 14: ids without repetition
        following = order[n + 1][1]
        r = got[doc, len(text)]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(new)
        assert r.near_edited == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(new))
        assert r.near_next == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following))
        assert 0 <= r.near_edited <= 1
    following = order[0][1]
    assert got[None, 5].near_next == merkle.likeness(merkle.fingerprint("no id"), merkle.fingerprint(following))


def test_merkle_trees_locate_edits():
    rng = random.Random(1)
    text = "\n".join(" ".join("w%d" % rng.randrange(500) for _ in range(40)) for _ in range(30))
    at = text.index(" ", 3000) + 1
    other = text[:at] + "CHANGED " + text[at:]
    spans = merkle.differences(merkle.fingerprint(other), merkle.fingerprint(text))
    assert spans and all(a <= at + 8 and b >= at for a, b in spans) and sum(b - a for a, b in spans) < 400
    assert merkle.differences(merkle.fingerprint(text), merkle.fingerprint(text)) == []
    assert 0.9 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1


def test_section_counts_equal_an_allocation_token_by_token(spark):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(byte_bpe.default_vocabulary())
    lengths = byte_bpe.load(byte_bpe.default_vocabulary()).byte_lengths
    rng = random.Random(12)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["ab ", "\n", "\n\n", "日本", "é", "--", "\t", "word"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in token_counts.section_counts(docs).collect()}
    want = {}
    for i, text in enumerate(texts):
        lines, at = [], 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", text) or [""]:
            if lines and (line == "\n" or not text[:at].strip("\n")):
                lines[-1][1] += len(line)  # empty lines belong to the line before them, leading ones to the first
            else:
                lines.append([at, at + len(line)])
            at += len(line)
        counts, crossing, byte = [0] * len(lines), [0] * len(lines), 0
        spans = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in lines]
        for token in plain.encode(text, add_special_tokens=False).ids:
            size = int(lengths[token])
            held = [max(0, min(b, byte + size) - max(a, byte)) for a, b in spans]
            owner = held.index(max(held))
            counts[owner] += 1
            crossing[owner] += sum(h > 0 for h in held) > 1
            byte += size
        want |= {(i, k): (a, b, counts[k], crossing[k]) for k, (a, b) in enumerate(lines)}
    assert got == want


def plain_best_two_fit(lengths, capacity):
    """One piece at a time: fill with the largest that fits, then let two take the place of the smallest."""
    left, bins = sorted(lengths, reverse=True), Counter()
    while left:
        bin_, gap = [], capacity
        for size in list(left):
            if size <= gap:
                bin_.append(size)
                left.remove(size)
                gap -= size
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            pairs = [(a + b, -b, a) for i, a in enumerate(left) for b in left[i + 1:] if a + b <= room]
            if pairs and max(pairs)[0] > bin_[-1]:
                _, b, a = max(pairs)
                left.remove(a)
                left.remove(-b)
                left = sorted([*left, bin_.pop()], reverse=True)
                bin_ += [a, -b]
        bins[tuple(sorted(bin_))] += 1
    return bins


def test_plans_over_counts_equal_packing_piece_by_piece():
    rng = random.Random(9)
    for case in range(150):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.choice([1, 2, 3, rng.randrange(1, capacity + 1)]) for _ in range(rng.randrange(70))]
        got = Counter()
        for times, bin_ in packing.plan(dict(Counter(lengths)), capacity):
            got[tuple(sorted(bin_))] += times
        assert got == plain_best_two_fit(lengths, capacity), case


def plain_blocks(text):
    """Blocks by their definition, a byte at a time."""
    data, blocks, block = text.encode(), [], b""
    for i, byte in enumerate(data):
        wide = byte >= 0xE0
        context = 0
        for back in range(1, 5):
            context = (context * 0x01000193 ^ data[i - back]) % 2**32 if i >= 4 else 0
        chosen = i >= 4 and (byte == 0x20 or wide) and ((context * 0x9E3779B1) % 2**32 >> 16) % (merkle.BLOCK_WORDS * (1 + wide)) == 0
        if chosen and wide and block:
            blocks.append(block)
            block = b""
        block += bytes([byte])
        if chosen and not wide or byte == 0x0A:
            blocks.append(block)
            block = b""
    return blocks + [block] * bool(block)


def test_merkle_fingerprints_equal_their_definition():
    rng = random.Random(7)
    for _ in range(60):
        words = [rng.choice(["plain", "wörd", "日本語", "x", "\n", "\n\n", "longer-word"]) for _ in range(rng.randrange(120))]
        text = " ".join(words)
        blocks = plain_blocks(text)
        printed = [b for s in merkle.parse(merkle.fingerprint(text))[1] for p in s for b in p]
        assert printed == [(hashlib.blake2b(b, digest_size=16).hexdigest()[:10], len(b.decode())) for b in blocks]
        other = text.replace("x", "y", 1) + " more"
        a, b = Counter(blocks), Counter(plain_blocks(other))
        size = sum(len(k.decode()) * n for c in (a, b) for k, n in c.items())
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) == 2 * sum(len(k.decode()) * n for k, n in (a & b).items()) / size


def test_merkle_roots_hold_more_than_the_printed_digests(monkeypatch):
    text = "some words\nand others\n\nlast"
    before = merkle.fingerprint(text)
    monkeypatch.setattr(merkle, "BLOCK_DIGEST", 1)
    cut = merkle.fingerprint(text)
    assert cut.split(":")[0] == before.split(":")[0] and len(cut) < len(before)


def test_merkle_of_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert merkle.with_successors(empty).count() == 0
    one = merkle.with_successors(spark.createDataFrame([(1, "self")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    own = sentence_pieces.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    rng = random.Random(2)
    letters = "  aBéÀ①ﾊﾟ　中ﬁ½\t​́e가각ᄀ…Ａ"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(13)))
        want, offsets = library.normalize(text, with_offsets=True)
        got, places = own.align(text.encode())
        ends = np.concatenate([[0], np.cumsum([len(c.encode()) for c in got.decode()])]).astype(int)
        assert got.decode() == want
        assert [len(text.encode()[:p].decode(errors="ignore")) for p in places[ends]] == offsets


def test_pieces_equal_the_library_and_spans_cover_the_bytes(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    texts = {i * 7: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    seen = set()
    for r in sentence_pieces.encoded(docs).collect():
        seen.add(r.doc_id)
        if r.doc_id == 7:
            continue
        text = texts[r.doc_id]
        ids = model.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == model.decode(ids)
        spans = np.frombuffer(r.spans, "<u4").reshape(-1, 2).tolist()
        assert len(spans) == len(ids) - 2
        assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()
    assert seen == set(texts)
    digest = {r.doc_id: r for r in sentence_pieces.digests(docs).collect()}[0]
    ids = np.array(model.encode(TEXTS[0], add_bos=True, add_eos=True), dtype="<u4")
    assert (digest.n_tokens, digest.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert digest.decoded_sha256 == hashlib.sha256(TEXTS[0].encode()).hexdigest()
