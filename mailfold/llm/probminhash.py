"""Near-duplicate documents by ProbMinHash (dealt operator 10).

Shingles of five words weigh as often as they occur.  For every shingle of a text a Poisson
process of rate its weight, seeded by the shingle, throws arrivals at the ``BANDS x ROWS``
places of a signature; a place keeps the shingle of its earliest arrival (Ertl's
ProbMinHash).  A shingle's process stops once its next arrival is later than the latest one
kept by any place.  Two signatures agree in a place with the probability Jaccard similarity
of the texts.  Places are banded; texts that agree in a band are candidates and are verified
by their exact probability Jaccard similarity, at least 0.8.  A pair at 0.8 shares none of
16 bands of 5 with probability 0.002.

Texts of equal words are one class from the start.  Every member of a band's bucket is first
verified against the least one, so a bucket of n costs n - 1 pairs.  The few buckets whose
members then still lie in different components are compared in blocks of bounded size,
across components only, without the least member, so no link that joins two groups is lost.  A group is a connected
component of links and is named by its least document id.

Defined results: texts without words (null, empty, punctuation) are copies of each other; a
row without an id is in no group (null group, kept).  Texts are grouped, not ids: rows of one
id with unlike texts are in groups of their own, and two groups whose least id is the same
bear the same name.  The flag ``kept`` marks one row of each group, of repeated rows one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailfold.llm.block_pairs import in_block_pairs
from mailfold.llm.common import free_names, map_rows, mix64
from mailfold.llm.graph import components
from mailfold.llm.shingles import BATCH_TEXTS, WORDS, probability_jaccard, shingles
from mailfold.session import settle

BANDS = 16
ROWS = 5
LEAST = 0.8
_SLACK = 1e-12
#: Shingles counted at a time when blocks are compared; bounds worker memory.
COLUMNS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(ids: np.ndarray, owner: np.ndarray, weights: np.ndarray, texts: int, places: int) -> np.ndarray:
    """The shingle kept in every place, one row a text; all shingles of a batch throw together."""
    earliest = np.full(texts * places, np.inf)
    kept = np.zeros(texts * places, dtype=np.uint64)
    state, owner, rate = ids.copy(), owner.copy(), weights.copy()
    time = np.zeros(len(ids))
    name = ids
    while len(name):
        state = state + _STEP
        bits = mix64(state)
        time = time - np.log1p(-(bits >> np.uint64(16)).astype(np.float64) / 2.0**48) / rate
        place = owner * places + ((mix64(bits) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < earliest[place])
        np.minimum.at(earliest, place[better], time[better])
        won = better[time[better] == earliest[place[better]]]
        kept[place[won]] = name[won]
        latest = earliest.reshape(texts, places).max(axis=1)
        alive = np.flatnonzero(time < latest[owner])
        state, owner, rate, time, name = state[alive], owner[alive], rate[alive], time[alive], name[alive]
    return kept.reshape(texts, places)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for every band of every row."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(parts.shape[2]):
        key = mix64(key * _STEP + parts[:, :, k] + np.uint64(k + 1))
    return key.view(np.int64)


_SKETCH = "doc_id bigint, version bigint, content string, bands array<bigint>"


def sketches(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Content digest and band keys of every text."""
    def run(batch):
        out = {"doc_id": batch["doc_id"], "version": batch["version"], "content": [], "bands": []}
        for a in range(0, len(batch["text"]), BATCH_TEXTS):
            texts = [t or "" for t in batch["text"][a : a + BATCH_TEXTS]]
            ids, owner, weights, contents = shingles(texts, words)
            out["bands"] += list(band_keys(signatures(ids, owner, weights, len(texts), bands * rows), bands))
            out["content"] += [hashlib.blake2b(c, digest_size=16).hexdigest() for c in contents]
        yield out

    versioned = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return map_rows(versioned, _SKETCH, run, doc_id="doc_id", version="version", text="text")


def _split(ids: np.ndarray, owner: np.ndarray, weights: np.ndarray, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cut = np.searchsorted(owner, np.arange(texts + 1))
    return [(ids[a:b], weights[a:b]) for a, b in zip(cut, cut[1:])]


def shingle_sets(texts: list[str], words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingles, weights) of every text."""
    out = []
    for a in range(0, len(texts), BATCH_TEXTS):
        part = texts[a : a + BATCH_TEXTS]
        out += _split(*shingles(part, words)[:3], len(part))
    return out


_LINKS = "u bigint, version_u bigint, v bigint, version_v bigint"


def verified(pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The ``pairs`` (u, version_u, v, version_v, text_u, text_v), without texts, that are similar enough."""
    def run(batch):
        u, v = shingle_sets(batch["text_u"], words), shingle_sets(batch["text_v"], words)
        good = [i for i, (a, b) in enumerate(zip(u, v)) if probability_jaccard(*a, *b) >= least - _SLACK]
        yield {k: [batch[k][i] for i in good] for k in ("u", "version_u", "v", "version_v")}

    return map_rows(pairs, _LINKS, run, u="u", version_u="version_u", v="v", version_v="version_v", text_u="text_u", text_v="text_v")


def _components(links: DataFrame) -> DataFrame:
    """(doc_id, version, component) of every linked class; a component is its least (doc_id, version)."""
    node = lambda side: F.struct(F.col(side).alias("doc_id"), F.col(f"version_{side}").alias("version")).alias(side)
    return components(links.select(node("u"), node("v"))).select("node.doc_id", "node.version", "component")


def likeness(sets: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, exact) of the pairs (sets[i], sets[j]): exact where no shingle of either
    repeats, else a bound from above, the lesser share of one's weight that the other holds.
    Shared shingles are counted for all pairs at once, COLUMNS of them at a time.
    """
    left, at_left = np.unique(i, return_inverse=True)
    right, at_right = np.unique(j, return_inverse=True)
    sizes = np.array([len(ids) for ids, _ in sets])
    single = np.array([len(ids) > 0 and w.max() == 1 for ids, w in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    share = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
    _, column, held_by = np.unique(np.concatenate([ids for ids, _ in sets]), return_inverse=True, return_counts=True)
    often = np.flatnonzero(held_by[column] > 1)
    row, share, column = row[often], share[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, share, column = row[order], share[order], column[order]
    both, of_left, of_right = (np.zeros((len(left), len(right)), dtype=np.float32) for _ in range(3))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        there[row[a:b], column[a:b] - start] = 1
        both += there[left] @ there[right].T
        if not single.all():
            part = np.zeros_like(there)
            part[row[a:b], column[a:b] - start] = share[a:b]
            of_left += part[left] @ there[right].T
            of_right += there[left] @ part[right].T
    shared = both[at_left, at_right].astype(np.float64)
    bound = np.minimum(of_left, of_right)[at_left, at_right] + 1e-3  # these are sums of 32-bit shares
    exact = single[i] & single[j]
    empty = (sizes[i] == 0) & (sizes[j] == 0)
    return np.where(exact, shared / np.maximum(sizes[i] + sizes[j] - shared, 1), np.where(empty, 1.0, bound)), exact


def _across(words: int, least: float):
    """Links found among the rows of one or two blocks, as pairs of the different components they join."""
    def run(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        rows = a if b is None else pd.concat([a, b], ignore_index=True)
        whole = np.stack([rows["component_id"].to_numpy(), rows["component_version"].to_numpy()], axis=1)
        names, parts = np.unique(whole, axis=0, return_inverse=True)
        names, parts, found = [tuple(n) for n in names.tolist()], parts.reshape(-1), []
        if len(names) == 1:
            return pd.DataFrame(found, columns=["u", "version_u", "v", "version_v"], dtype="int64")
        differ = parts[: len(a), None] != parts[None, :]
        i, j = np.nonzero(np.triu(differ, 1) if b is None else differ & (np.arange(len(rows)) >= len(a)))
        bands, band = np.stack(rows["bands"].to_list()), int(rows["band"].iloc[0])
        fresh = ~(bands[i, :band] == bands[j, :band]).any(axis=1)  # not met in an earlier band
        i, j = i[fresh], j[fresh]
        if not len(i):
            return pd.DataFrame(found, columns=["u", "version_u", "v", "version_v"], dtype="int64")
        needed, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = shingle_sets(rows["text"].iloc[needed].fillna("").to_list(), words)
        i, j = place[: len(i)], place[len(i) :]
        parts = parts[needed]
        like, exact = likeness(sets, i, j)
        near = np.flatnonzero(like >= least - _SLACK)
        leader = {p: p for p in parts.tolist()}

        def top(p):
            while leader[p] != p:
                p = leader[p]
            return p

        for x, y, known in zip(i[near].tolist(), j[near].tolist(), exact[near].tolist()):
            p, q = top(int(parts[x])), top(int(parts[y]))
            if p != q and (known or probability_jaccard(*sets[x], *sets[y]) >= least - _SLACK):
                leader[max(p, q)] = min(p, q)
                found.append((*names[int(parts[x])], *names[int(parts[y])]))
        return pd.DataFrame(found, columns=["u", "version_u", "v", "version_v"], dtype="int64")

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS,
           rows: int = ROWS, least: float = LEAST) -> DataFrame:
    """(doc_id, version, class_id, kept) for every row; ``version`` is xxhash64 of the text."""
    sketched = settle(sketches(docs, words, bands, rows, id_col, text_col), "llm-sketches")
    named = sketched.where("doc_id IS NOT NULL")
    chosen = F.min_by(F.struct("doc_id", "version", "bands"), F.struct("doc_id", "version"))
    classes = settle(named.groupBy("content").agg(chosen.alias("c")).select("content", "c.*"), "llm-classes")

    spread = classes.select("doc_id", "version", F.posexplode("bands").alias("band", "key"))
    leaders = spread.groupBy("band", "key").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.count(F.lit(1)).alias("n"))
    # in a struct the bucket is dealt anew, not as the minima were, so that a hot one can be split
    bucket = F.struct("band", "key").alias("bucket")
    leaders = leaders.where("n > 1").select(bucket, F.col("least.doc_id").alias("v"), F.col("least.version").alias("version_v"))
    stars = spread.select("doc_id", "version", bucket).join(leaders, "bucket").where("doc_id <> v OR version <> version_v")
    stars = settle(stars.select(F.col("doc_id").alias("u"), F.col("version").alias("version_u"), "v", "version_v").distinct(), "llm-stars")

    # Texts move only for documents that are a candidate of some pair.  Candidates grow with the
    # input, so these joins are sort-merge joins at every size.
    needed = stars.select(F.col("u").alias("doc_id"), F.col("version_u").alias("version")).union(stars.select("v", "version_v")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = settle(texts.join(needed.hint("merge"), ["doc_id", "version"], "left_semi"), "llm-candidate-texts")
    one = lambda side: texts.select(F.col("doc_id").alias(side), F.col("version").alias(f"version_{side}"), F.col("text").alias(f"text_{side}"))
    pairs = stars.join(one("u").hint("merge"), ["u", "version_u"]).join(one("v").hint("merge"), ["v", "version_v"])
    links = settle(verified(pairs, words, least), "llm-links")

    # A class is named by its id and version, since one id may have several texts.
    alone = F.coalesce("component", F.struct("doc_id", "version"))
    placed = classes.join(_components(links), ["doc_id", "version"], "left")
    placed = settle(placed.withColumn("component", alone), "llm-placed")

    # Buckets that still hold several components: compare across them.  The least member has
    # met all others above, so it stays out, and with it buckets of two.
    keyed = placed.select("doc_id", "version", "component", "bands", F.posexplode("bands").alias("band", "key"))
    mixed = keyed.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("size"),
                                             F.min(F.struct("doc_id", "version")).alias("first"))
    mixed = mixed.where("a <> b AND size > 2").select("band", "key", "size", "first")
    rest = keyed.join(settle(mixed, "llm-mixed"), ["band", "key"]).where(F.col("first") != F.struct("doc_id", "version")).drop("first")
    rest = rest.join(texts, ["doc_id", "version"])
    rest = rest.withColumns({"component_id": F.col("component.doc_id"), "component_version": F.col("component.version")}).drop("component")
    more = settle(in_block_pairs(rest, ["band", "key"], "version", _across(words, least), _LINKS, size="size"), "llm-more-links")
    merged = _components(more).select(F.struct("doc_id", "version").alias("part"), F.col("component").alias("whole"))

    final = placed.select("content", "component").join(merged, F.col("component") == F.col("part"), "left")
    final = settle(final.select("content", F.coalesce("whole", "component").alias("component")), "llm-groups")
    own = Window.partitionBy("doc_id", "version").orderBy("content")
    out = named.select("doc_id", "version", "content").join(final, "content").withColumn("again", F.row_number().over(own))
    least_row = (F.col("doc_id") == F.col("component.doc_id")) & (F.col("version") == F.col("component.version"))
    out = out.select("doc_id", "version", F.col("component.doc_id").alias("class_id"), (least_row & (F.col("again") == 1)).alias("kept"))
    nameless = sketched.where("doc_id IS NULL").select("doc_id", "version", F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group, and those without an id."""
    marked = settle(groups(docs, id_col, text_col, **options), "llm-marked")
    chosen, version, own = free_names(docs.columns, "chosen", "version", "own")
    stay = marked.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(chosen), F.col("version").alias(version))
    versioned = docs.withColumn(own, F.xxhash64(text_col))
    kept = versioned.join(stay, (F.col(id_col) == F.col(chosen)) & (F.col(own) == F.col(version)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own).unionByName(docs.where(F.col(id_col).isNull()))
