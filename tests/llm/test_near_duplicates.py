"""Operators 1 and 10, the graph they share, and the pipeline, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from mailfold.llm import embedding_dedup, language, line_dedup, packing, personal_data, probminhash, shingles
from mailfold.llm.block_pairs import in_block_pairs, local_roots
from mailfold.llm.graph import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901)]
    links += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_every_two_rows_of_a_bucket_meet_once(spark):
    rows = spark.createDataFrame([(b, i) for b, n in (("x", 23), ("y", 1), ("z", 2), ("é", 9)) for i in range(n)], "bucket string, i bigint")

    def pairs(a, b):
        import pandas as pd

        own = a["i"].tolist()
        out = [(p, q) for n, p in enumerate(own) for q in own[n + 1 :]] if b is None else [(p, q) for p in own for q in b["i"]]
        return pd.DataFrame([(a["bucket"].iloc[0], min(x), max(x)) for x in out], columns=["bucket", "p", "q"])

    got = Counter((r.bucket, r.p, r.q) for r in in_block_pairs(rows, ["bucket"], "i", pairs, "bucket string, p bigint, q bigint", block_rows=4).collect())
    assert set(got.values()) == {1} and len(got) == sum(n * (n - 1) // 2 for n in (23, 2, 9))


def test_local_roots():
    assert local_roots(6, np.array([4, 3, 1]), np.array([3, 1, 5])).tolist() == [0, 1, 2, 1, 1, 1]


# --- embeddings ------------------------------------------------------------------------


def plain_links(rows, least=0.93):
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for n, (a, va, la) in enumerate(rows):
        for b, vb, lb in rows[n + 1 :]:
            if la is not None and la == lb and a is not None and b is not None and good(va) and good(vb) and len(va) == len(vb):
                x, y = np.array(va), np.array(vb)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("dim", [24, 3])
def test_embedding_links_equal_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    rows, centre = [], rng.normal(size=(12, dim))
    for i in range(220):
        v = centre[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3])
        rows.append((1000 - i, v.tolist(), ["p", "q", None][i % 12 % 3] if i % 50 else "p"))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]), (2002, (np.array(rows[0][1]) * 1e-200).tolist(), rows[0][2]),
             (2003, [0.0] * dim, "p"), (2004, None, "p"), (2005, [float("nan")] * dim, "p"), (2006, [None] + [1.0] * (dim - 1), "p"),
             (2007, [], "p"), (2008, [1.0], "p"), (2009, [2.0], "p"), (2010, [float("inf")] * dim, "p"), (None, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, label string, n_links string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    links = plain_links(rows)
    degree = Counter(x for pair in links for x in pair)
    part = roots([r[0] for r in rows if r[0] is not None], links)
    found = sum(got[i].n_links for i in part)
    assert found >= 0.98 * sum(degree.values()) and all(got[i].n_links <= degree[i] for i in part)
    assert len(got) == len(rows) and got[None].kept and got[None].n_links == 0
    same = [i for i in part if got[i].component_id == part[i]]
    assert len(same) >= 0.98 * len(part)
    assert all(got[i].kept == (got[i].component_id == i) for i in part)
    assert all(got[i].n_links == 0 for i in (2003, 2004, 2005, 2006, 2007, 2010)) and got[2009].component_id == 2008


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)) @ np.diag(np.linspace(3, 0.1, 32)) + 2
    rotation = embedding_dedup.Rotation(x, 5, 6)
    bits = np.concatenate([(rotation.codes(x)[:, t, None] >> np.arange(6)) & 1 for t in range(5)], axis=1)
    assert (abs(bits.mean(axis=0) - 0.5) < 0.2).all()


# --- documents -------------------------------------------------------------------------


def plain_weights(text):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "Über", "naïve"]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else ", ".join(copy) + ".")
    chain = [rng.choice(words) for _ in range(120)]
    for i in range(12):  # neighbours are alike, ends are not
        out.append(" ".join(chain))
        chain = chain[4:] + [rng.choice(words) for _ in range(4)]
    out += ["again and again " * 40, "again and again " * 39, None, "", "!!", "one", "One!", "x " * 5000]
    return out


def test_similarity_equals_its_definition():
    rng = random.Random(3)
    for _ in range(200):
        a = " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        b = " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        sets = probminhash.shingle_sets([a, b], 5)
        assert math.isclose(shingles.probability_jaccard(*sets[0], *sets[1]), plain_similarity(plain_weights(a), plain_weights(b)), abs_tol=1e-9)


def test_signatures_estimate_the_similarity():
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(300)]
    other = list(base)
    for i in range(0, 300, 60):
        other[i] = "new"
    texts = [" ".join(base), " ".join(other), " ".join(base) + " " + " ".join(base[:150])]
    ids, owner, weights, _ = shingles.shingles(texts)
    signature = probminhash.signatures(ids, owner, weights, 3, 2000)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want = plain_similarity(plain_weights(texts[i]), plain_weights(texts[j]))
        assert abs((signature[i] == signature[j]).mean() - want) < 0.05
    alone = shingles.shingles(texts[1:2])
    assert (probminhash.signatures(*alone[:3], 1, 2000)[0] == signature[1]).all()


def plain_groups(texts):
    sets = {i: plain_weights(t) for i, t in texts}
    ids = sorted(sets)
    return roots(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if plain_similarity(sets[a], sets[b]) >= 0.8 - 1e-9])


def test_groups_equal_all_pairs(spark):
    texts = list(enumerate(corpus(5), start=10))
    frame = spark.createDataFrame([(i, t, "clash", None) for i, t in texts] + [(None, "no id", None, None)], "doc_id bigint, text string, class_id string, kept string")
    rows = {r.doc_id: r for r in probminhash.groups(frame).collect()}
    want = plain_groups(texts)
    missed = [i for i in want if rows[i].class_id != want[i]]
    assert len(missed) <= 0.02 * len(want)
    assert all(r.kept == (r.class_id == i) for i, r in rows.items() if i is not None) and rows[None].kept and rows[None].class_id is None
    stay = probminhash.one_of_each(frame)
    assert stay.columns == frame.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted(i for i, r in rows.items() if i is not None and r.kept)


def test_links_across_components_of_one_bucket(spark):
    # with one band of one place buckets are large and mix components
    texts = list(enumerate(corpus(8, 20)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = {r.doc_id: r.class_id for r in probminhash.groups(frame, bands=40, rows=1).collect()}
    assert rows == plain_groups(texts)


def test_blocks_of_one_bucket_are_compared_at_once(monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    texts, n = [], 160
    for _ in range(10):
        base = [f"w{rng.randrange(900)}" for _ in range(60)]
        for k in range(n // 10):
            copy = list(base)
            for _ in range(k % 5):
                copy[rng.randrange(60)] = f"x{rng.randrange(900)}"
            texts.append(" ".join(copy))
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    i, j = np.array(pairs).T
    mixed = texts[:40] + [" ".join([t] * (2 + k % 2)) for k, t in enumerate(texts[40:])]  # shingles that repeat
    for some in (texts, mixed):
        sets = probminhash.shingle_sets(some, 5)
        like, exact = probminhash.likeness(sets, i, j)
        for (a, b), got, known in zip(pairs, like, exact):
            want = shingles.probability_jaccard(*sets[a], *sets[b])
            assert got == want if known else got >= want

    calls = []
    monkeypatch.setattr(probminhash, "probability_jaccard", lambda *x: calls.append(1) or shingles.probability_jaccard(*x))
    for some in (texts, mixed):
        frame = pd.DataFrame({"doc_id": range(n), "version": 0, "component_id": range(n), "component_version": 0, "text": some, "band": 0})
        frame["bands"] = [np.zeros(1, dtype=np.int64)] * n
        for rows in ([frame], [frame[:70], frame[70:].reset_index(drop=True)]):
            calls.clear()
            found = probminhash._across(5, 0.8)(rows[0].copy(), *([rows[1]] if len(rows) > 1 else [None]))
            sets = {k: plain_weights(t) for k, t in enumerate(some)}
            links = [(a, b) for a, b in pairs if (len(rows) == 1 or a < 70 <= b) and plain_similarity(sets[a], sets[b]) >= 0.8 - 1e-9]
            assert roots(range(n), zip(found["u"], found["v"])) == roots(range(n), links)
            assert len(calls) == 0 if some is texts else len(calls) < len(pairs) / 4


def test_components_write_few_tables(spark, monkeypatch):
    from mailfold.llm import graph

    written = []
    for name in ("settle", "settle_measured"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(graph, name), **k: written.append(1) or f(*a, **k))
    stars = spark.createDataFrame([(i, i % 3) for i in range(40)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(stars).collect()} == {i: i % 3 for i in range(40)}
    assert len(written) == 2  # the links, and the step that finds them to be stars


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here"), (None, "a b c d e f")]
    stay = probminhash.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in stay) == [(0, "a b c d e f"), (1, "a b c d e f"), (3, "other words here")]
    assert probminhash.groups(spark.createDataFrame([], schema)).count() == 0


def test_ids_that_repeat_with_different_texts_lose_none(spark):
    schema = "doc_id bigint, text string"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    a, b, c, d = (" ".join(words[i:] + words[:i]) for i in (0, 3, 6, 9))
    rows = []
    for n, (p, q) in enumerate([(a + " p", b + " q"), (d + " q", c + " p")]):
        for base, one, two in ((0, p, q), (100, f"{q} {q} x{n}", f"{p} {p} x{n}")):  # whichever text's hash is the less
            base += 1000 * n
            rows += [(base + 5, one), (base + 7, one), (base + 7, two), (base + 8, two.upper()), (base + 9, one), (base + 9, two), (base + 9, two)]
    rows += [(5000, "only once " * 9), (5000, "another text altogether " * 9), (5000, "ONLY once " * 9)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter((r.doc_id, r.class_id, r.kept) for r in probminhash.groups(docs).collect())
    for base in (0, 100, 1000, 1100):
        want = [(5, 5, True), (7, 5, False), (7, 7, True), (8, 7, False), (9, 5, False), (9, 7, False), (9, 7, False)]
        want = Counter((base + i, base + g, k) for i, g, k in want)
        assert {k: n for k, n in got.items() if base <= k[0] < base + 100} == want
    assert got[5000, 5000, True] == 2 and got[5000, 5000, False] == 1
    stay = {(r.doc_id, r.text.lower()) for r in probminhash.one_of_each(docs).collect()}
    assert stay == {(i, t.lower()) for i, t in rows if i % 100 in (5, 7) and (i % 100 == 5 or (i - 2, t) not in rows) or i == 5000}


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_equals_its_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    known = {"aa": "lorem ipsum dolor amet elit vivamus nunc".split(), "bb": "kuta wezo bandri mokalu sindre havolt".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(known))
        lines = [" ".join(rng.choice(known[lang]) + str(rng.randrange(9)) for _ in range(12)) for _ in range(4)]
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0))
    rows += [(200, rows[3][1], "aa", "s", 0), (201, "shared first line here\nshared second line here\n" + rows[5][1].replace("1", "7"), "bb", "s", 0),
             (202, "shared first line here\nshared second line here", "bb", "s", 0), (203, None, "aa", "s", 0), (204, "12 34", None, "s", 0),
             (205, rows[7][1] + "\nmail me a.b@c.de", rows[7][2], "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    learned = language.learn(docs, ~language.held_out())
    texts = {r[0]: r[1] for r in rows if not (lambda f: f[0] == "und" or f[1] < language.NARROW)(language.identify(r[1], learned))}
    first, gone = {}, {}
    for doc in sorted(texts):
        lines = texts[doc].split("\n")
        for p in range(len(lines) - 1):
            at = first.setdefault(tuple(lines[p : p + 2]), (doc, p))
            if at[0] != doc or p >= at[1] + 2:
                gone.setdefault(doc, set()).update((p, p + 1))
    texts = {d: "\n".join(l for n, l in enumerate(t.split("\n")) if n not in gone.get(d, ())) for d, t in texts.items()}
    group = plain_groups(list(texts.items()))
    texts = {d: t for d, t in texts.items() if group[d] == d}
    patterns = Counter((k, ",".join(map(str, v))) for t in texts.values() for k, _, _, v in personal_data.proposals(t, personal_data.base_spans(t)))
    accepted = frozenset(k for k, p in personal_data.train([(*k, n) for k, n in patterns.items()]).items() if p >= 0.5)
    texts = {d: personal_data.masked_text(t, accepted) for d, t in texts.items()}
    plain = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.tokenised(plain).collect()}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert {203, 204}.isdisjoint(texts) and not texts.get(200) and 202 in gone and 201 not in gone
    assert all("a.b@c.de" not in t for t in texts.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_one_of_each_takes_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "a", 1, "x"), (2, text, "b", 2, "y"), (3, "other " * 9, "c", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own string, version int, chosen string")
    kept = probminhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.own for r in kept.collect()} == {1: "a", 3: "c"}
