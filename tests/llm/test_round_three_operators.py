"""Operators 11 to 13 against plain versions of what they promise."""

import hashlib
import random
import re
from collections import Counter

import pytest

from mailfold.llm import anchors, divergence, frames

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, slice string, term string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    """(doc_id, text[, lang, source]) with columns whose names the operators use themselves."""
    full = [(*r, *(None,) * (4 - len(r)), 1, "clash", "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ------------------------------------------------------------------


def plain_form(doc_id, text):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, form, order = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or form % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if order % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(seed, count):
    rng = random.Random(seed)
    bits = ["word", "é", "日本", "a", " ", "  ", "\n", "\t\x0b", " ", "\x1c", "<P", ">", "<S>", "<M", "<", "🙂" * 3]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 7, 65_536])
def test_every_frame_size_gives_the_units_cuts_and_output_of_whole_texts(spark, size):
    texts = [None, "", " ", "x", "<P>", "a <M> b", *some_texts(size, 150), "long " * 60_000 + "\n", "y" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id"), (3, "x"), (3, "y y y")]
    out = frames.transformed(frames.framed(table(spark, rows), size=size)).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in out)
    want = Counter((i, *(x := plain_form(i, t or "")), sha(x[-1]), sha(t or "")) for i, t in rows)
    assert got == want
    assert {"plain", "spm", "psm"} == {r.form for r in out}


def test_restoring_finds_marks_across_parts_of_the_stream():
    for form, output in (("psm", "<P>one <<S>three>P<M> two <S"), ("spm", "<S>three>P<P>one <<M> two <S")):
        for step in (1, 2, 3, 5, 100):
            parts = (output.encode()[i:i + step] for i in range(0, len(output), step))
            assert b"".join(frames.restored(parts, form)) == b"one < two <Sthree>P"


def test_a_cut_reads_one_frame():
    data = b"ab cd ef " * 1000
    text = frames.Seekable(*frames.to_frames(data, 100))
    read = []
    text.frame = lambda i, plain=text.frame: read.append(i) or plain(i)
    for k in (0, 1, 500, 2999, 3000, 3001):
        read.clear()
        i, byte, chars = text.cut(k)
        assert len(read) <= 1
        assert b"".join(text.between((0, 0, 0), (i, byte, chars))).decode() == "".join(UNIT.findall(data.decode())[:k]) and chars == len(
            "".join(UNIT.findall(data.decode())[:k]))


# --- substring dedup ---------------------------------------------------------------------


def plain_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def dedup(spark, rows, window, **sizes):
    out = anchors.without_repeats(table(spark, rows, 4), window=window, **sizes).collect()
    for r in out:
        assert sum(x["last"] - x["first"] + 1 for x in r.repeats) == r.n_removed and all(x["last"] - x["first"] + 1 >= window for x in r.repeats)
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.repeats, r.repeats[1:]))
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out)


@pytest.mark.parametrize("window,sizes", [(5, {"slice_bytes": 60, "bucket_words": 40}), (3, {"slice_bytes": 500}), (13, {"slice_bytes": 2000}), (13, {})])
def test_repeats_equal_a_search_of_every_window(spark, window, sizes):
    rng = random.Random(window)
    vocabulary = ["a", "b", "é", "日本語", "Word"] if window < 13 else [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(window, 4 * window))) for _ in range(6)]
    rows = [(None, passages[0]), (900, None), (901, ""), (902, " \n\t ")]
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 4 * window))]
        parts = [" ".join(words), *(rng.choice(passages) for _ in range(rng.randrange(3)))]
        rng.shuffle(parts)
        rows.append((rng.randrange(-50, 100), rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += rows[4:9] + [(50, passages[1])] * 3
    assert dedup(spark, rows, window, **sizes) == plain_repeats(rows, window)


def test_long_documents_hot_passages_and_a_repeat_within_one_document(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(400_000))
    rows = [(1, f"{passage} {passage}"), (2, f"x {passage} y"), (3, long), (4, " ".join(long.split()[1000:300_000])), (5, "z" * 3_000_000)]
    rows += [(i, f"u{i} {passage} t{i}") for i in range(10, 400)]
    assert dedup(spark, rows, 13, slice_bytes=5000) == plain_repeats(rows, 13)


def test_an_empty_table_has_no_repeats(spark):
    assert anchors.without_repeats(table(spark, [(1, "a")]).where("false")).collect() == []
    assert frames.transformed(frames.framed(table(spark, [(1, "a")]).where("false"))).collect() == []
    assert divergence.audit(table(spark, [(1, "a")]).where("false")).collect() == []


def test_prefix_hashes_do_not_depend_on_the_place():
    import numpy as np

    word = b"some words here"
    for lead in (0, 1, 4097, anchors._STEP - 5, anchors._STEP, 2 * anchors._STEP + 3):
        data = np.frombuffer(b"q" * lead + word + b"rest", dtype=np.uint8)
        at = np.array([lead, lead + len(word)])
        sums, shift = anchors._prefixes(data, at)
        value = ((sums[1:] - sums[:1]) * shift[:1])[0]
        first = value if lead == 0 else first
        assert value == first


# --- source divergence -------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= min_docs]
        names = sorted({d[1] for d in own})
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in names}
        counts[None] = Counter(t for d in own for t in d[2])
        share = {}
        for s, c in counts.items():
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in names:
            pair = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in names if o != s]
            term = [(share[None][t] - share[s][t], t) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, found, limit in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block,min_docs,top,tile,held", [(1, 2, 3, 1, 3), (4, 2, 50, 2, 10), (16_384, 3, 50, 64, 500_000)])
def test_divergence_equals_dense_columns(spark, block, min_docs, top, tile, held):
    rng = random.Random(block)
    vocabulary = ["Apple", "apple", "Été", "été", "x", "ab1cd", "日本", "no break", "Ä", "zz", "q-r", "\x7f", "123"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "é", None])) for i in range(80)]
    rows += [(90, None, "fr", "alone"), (91, "", "fr", "empty"), (92, "once", "it", "one"), (93, None, None, None)] + rows[:5]
    rows += [(99, "rare " * 50 + "long" * 700_000, "en", "s1")]
    got = divergence.audit(table(spark, rows), min_docs=min_docs, top=top, block=block, tile=tile, held_terms=held)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, min_docs, top)


def test_terms_are_not_cut_at_the_steps(monkeypatch):
    text = "Abc défg, hij " * 50
    whole = [w for part in divergence.terms(text.encode()) for w in part]
    for step in (1, 2, 3, 17):
        monkeypatch.setattr(divergence, "STEP_BYTES", step)
        assert [w for part in divergence.terms(text.encode()) for w in part] == whole
    assert whole[:3] == [b"abc", "défg".encode(), b"hij"]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.sql("SELECT 900000000000000 AS n, 1000000000000000 AS total, 70000 AS kept").select(divergence.exact_share("n", "total", "kept").alias("p"))
    assert row.first().p == 1 + 1_000_000_000 * (900000000000000 + 5) // (1000000000000000 + 5 * 70000)


def test_parts_hold_a_term_once_a_step(spark):
    """Counts of a task's documents are merged, not handed on with each document that fills the limit."""
    long = " ".join(f"w{i % 500}" for i in range(300_000))
    rows = [(i, " ".join(f"t{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)), "en", f"s{i % 3}") for i in range(30)] + [(99, long, "en", "s9")]
    parts = divergence.partial_counts(table(spark, rows, 1), "text", "lang", "source", held_terms=10).collect()
    small = [p for p in parts if p.term != "w"]
    assert len(small) == 100 and {p.docs for p in small} == {30}
    assert {tuple(sorted(map(tuple, p.cells))) for p in small} == {(("s0", 10), ("s1", 10), ("s2", 10))}
    assert [(p.docs, [tuple(c) for c in p.cells]) for p in parts if p.term == "w"] == [(1, [("s9", 300_000)])]


def test_step_counts_equal_counting_each_text():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "é", "日本", " ", "1", "\n", "xyz"]) for _ in range(rng.randrange(12))).encode() for _ in range(400)]
    texts = [b"", b"skipped", b"Ab", b"ab", b"", b" ", b"12", b"ab cd", *texts, b"end", b""]
    groups = np.array([i % 3 for i in range(len(texts))])
    for a, b in ((0, len(texts)), (2, 300), (4, 7), (4, 4)):
        got = divergence.step_counts(pa.array(texts, pa.binary())[a:b], groups[a:b])
        n, docs = Counter(), Counter()
        for text, g in zip(texts[a:b], groups[a:b].tolist()):
            found = Counter(w for part in divergence.terms(text) for w in part)
            n.update({(w, g): k for w, k in found.items()})
            docs.update((w, g) for w in found)
        rows = [] if got is None else [((got.words[int(c)].as_py(), g), k, d) for c, g, k, d in zip(got.code, got.group.tolist(), got.n.tolist(), got.docs.tolist())]
        assert sorted(rows) == sorted((key, k, docs[key]) for key, k in n.items())


def test_shares_do_not_change_where_decimals_begin(spark):
    cases = [(n, total, kept) for n in (0, 1, 8_999_999_993, 8_999_999_994, 8_999_999_995, 8_999_999_996, 9_223_372_036, 9_223_372_037)
             for total in (1, 10**10, 10**18 - 1, 10**18, 9 * 10**18) for kept in (1, 70_000, 10**12)]
    rows = spark.createDataFrame(cases, "n LONG, total LONG, kept LONG").where("n <= total").select("*", divergence.exact_share("n", "total", "kept").alias("p")).collect()
    assert all(r.p == 1 + 1_000_000_000 * (r.n + 5) // (r.total + 5 * r.kept) for r in rows) and len(rows) > 90
