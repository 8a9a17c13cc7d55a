"""Personal data by weak supervision (dealt operator 3).

Base spans are fixed patterns with a check each (see ``BASE``).  Looser patterns propose
further spans: addresses written out in words, cards with other separators, telephone
numbers without a plus sign.  Labelers - regular expressions, gazetteers and context words -
vote on every proposed span, for, against, or not at all.  Expectation-maximisation over the
votes estimates how reliable each labeler is and how likely each vote pattern is personal
data (Dawid and Skene's model, one for each kind); a logistic span classifier over votes and
shape features is then fitted to those likelihoods and decides about every proposed span
that no base span overlaps.  Base spans stay whatever the classifier says.

Spark proposes spans in one pass and counts patterns of votes and features over all
documents.  Votes and features are few and have two or three values, so the table of counts
is bounded (at most 3^labelers x 2^features rows, whatever the input) and only it reaches
the driver, where both models are fitted.

Defined results: a null text counts as empty; spans count code points, end exclusive; a
document without spans has empty strings; repeated rows get a result each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfold.llm.common import map_rows
from mailfold.session import settle

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns and checks of the base spans.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

_DOTTED = re.compile(r"[0-9]\.[0-9]")
#: A match of "ip" takes whole runs of digits, so it is tried once a run, at its first digit.
_SEARCHED = {**BASE, "ip": re.compile(r"(?<![0-9])" + BASE["ip"].pattern)}

#: Looser proposals; group 0 is the span.
PROPOSALS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\bat\b|@) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]+)+", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}[ ./_-]?[0-9]{4}[ ./_-]?[0-9]{4}[ ./_-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\(?0[0-9]{1,4}\)?|\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])"),
}

#: Gazetteers and context words, each list in its natural order.
DOMAIN_ENDINGS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|address|reach|correo|contacto|courriel|adresse|schreib|kontakt", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|tarjeta|carte|karte|zahlung|pago", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|whatsapp|tel[eé]fono|llam|appel|anruf|handy", re.I),
}
AGAINST = re.compile(r"token|version|order|invoice|isbn|issn|serial|build|commit|hash|doi|sku|\bid\b|\bno\b", re.I)
WINDOW = 40

#: Votes: 1 personal, -1 not, 0 abstains.
LABELERS = ("form", "check", "gazetteer", "context")
FEATURES = ("separated", "obfuscated", "line_alone")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def passes(kind: str, span: str) -> bool:
    """The check of a base span."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in span.split("."))
    digits = _digits(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


_IN_ADDRESS = frozenset("._%+-")
#: Whoever ignores case takes these for the letters i, s and k as well.
_IN_PROPOSAL = _IN_ADDRESS | frozenset("\u0130\u0131\u017f\u212a")


def _run_start(text: str, at: int, least: int, others: frozenset = _IN_ADDRESS) -> int:
    """Where the characters of an address that end before ``at`` begin, ``least`` at the earliest."""
    while at > least and (text[at - 1] in others or text[at - 1].isascii() and text[at - 1].isalnum()):
        at -= 1
    return at


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses.  Every match holds one @ with the run of address
    characters before it, so one try at the start of that run is enough."""
    at, done = text.find("@"), 0
    while at >= 0:
        m = BASE["email"].match(text, _run_start(text, at, done))
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass their check, by start, then kind."""
    found = [("email", *span) for span in _addresses(text)]
    present = {"ip": _DOTTED.search(text), "card": True, "phone": "+" in text}
    for kind in KINDS[1:]:
        if present[kind]:
            found += [(kind, *m.span()) for m in _SEARCHED[kind].finditer(text) if passes(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _words_of(span: str) -> str:
    return re.sub(r" ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?", ".", re.sub(r" ?(?:\(at\)|\[at\]|\bat\b|@) ?", "@", span, flags=re.I), flags=re.I)


def vote(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of LABELERS, then FEATURES as 0 or 1, on one proposed span."""
    span = text[start:end]
    before = text[max(0, start - WINDOW) : start]
    digits = _digits(span)
    context = 1 if CONTEXT[kind].search(before) else -1 if AGAINST.search(before) else 0
    if kind == "email":
        plain = _words_of(span)
        bracketed = "(" in span or "[" in span
        form = 1 if BASE["email"].fullmatch(plain) and (bracketed or re.search(r"\bdot\b", span, re.I)) else -1
        ending = plain.rsplit(".", 1)[-1].lower()
        votes = form, 1 if any(c in plain.split("@")[0] for c in "._0123456789") else 0, 1 if ending in DOMAIN_ENDINGS else -1, context
        features = " " in span, bracketed, False
    elif kind == "card":
        groups = re.split(r"[ ./_-]", span)
        form = 1 if len(groups) == 4 and len({c for c in span if not c.isdigit()}) == 1 else -1 if len(groups) == 1 else 0
        votes = form, 1 if luhn(digits) and 14 <= len(digits) <= 19 else -1, 1 if digits.startswith(CARD_PREFIXES) else 0, context
        features = len(groups) > 1, any(c in span for c in "./_"), False
    else:
        form = 1 if span[0] in "+(0" else 0
        votes = form, 1 if 9 <= len(digits) <= 15 else -1, -1 if re.fullmatch(r"(19|20)\d\d.*", span) else 0, context
        features = len({c for c in span if not c.isalnum()}) > 1, "." in span, False
    at = start
    while at and text[at - 1] != "\n" and text[at - 1].isspace():
        at -= 1
    line = (not at or text[at - 1] == "\n") and text[end : end + 1] in ("", "\n")
    return (*votes, int(features[0]), int(features[1]), int(line))


def proposals(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Proposed spans that no base span overlaps, with votes and features.  ``base`` is in order of start."""
    starts = [s for _, s, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    for kind, pattern in PROPOSALS.items():
        if kind == "email":
            places = _address_matches(text)
        else:
            places = (m.span() for m in pattern.finditer(text))
        for start, end in places:
            before = bisect_left(starts, end)
            if not before or ends[before - 1] <= start:
                yield kind, start, end, vote(kind, text, start, end)


_AT = re.compile(r"[(\[]at[)\]]|\bat\b|@", re.I)


def _address_matches(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address proposal.  Every match holds a sign for
    "at" with the run of address characters before it, so one try at the start of that run is
    enough."""
    done = 0
    for sign in _AT.finditer(text):
        if sign.start() < done:
            continue
        end = sign.start()
        if end > done and text[end - 1] == " ":
            end -= 1
        left = _run_start(text, end, done, _IN_PROPOSAL)
        m = PROPOSALS["email"].match(text, left)
        if m and m.end() > sign.start():
            done = m.end()
            yield m.span()


_FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base array<string>, "
    "proposed array<struct<kind:string,start:bigint,end:bigint,pattern:string>>"
)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and proposed spans of every document."""
    def run(rows):
        out = {k.split()[0]: [] for k in _FOUND.split(", ")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            text = text or ""
            base = base_spans(text)
            out["doc_id"].append(doc_id)
            for kind in KINDS:
                out["n_" + kind].append(sum(k == kind for k, _, _ in base))
            out["base"].append([f"{k}:{s}:{e}" for k, s, e in base])
            out["proposed"].append([{"kind": k, "start": s, "end": e, "pattern": ",".join(map(str, v))} for k, s, e, v in proposals(text, base)])
        yield out

    return map_rows(docs, _FOUND, run, doc_id=id_col, text=text_col)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Likelihood that each vote pattern is personal data, by expectation-maximisation.

    Every labeler has a table P(vote | truth); the start is the share of votes in favour.
    """
    posterior = np.clip((votes.sum(axis=1) / votes.shape[1] + 1) / 2, 0.05, 0.95)
    for _ in range(rounds):
        log_odds = None
        for truth, weight in ((1, posterior * counts), (0, (1 - posterior) * counts)):
            total = weight.sum() + 1e-9
            log_p = np.full(len(votes), math.log(total / (counts.sum() + 2e-9)))
            for j in range(votes.shape[1]):
                share = {v: (weight[votes[:, j] == v].sum() + 0.5) / (total + 1.5) for v in (-1, 0, 1)}
                log_p += np.array([math.log(share[v]) for v in votes[:, j].tolist()])
            log_odds = log_p if log_odds is None else log_odds - log_p
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior


def fit(inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic classifier for soft targets, by Newton's method."""
    x = np.concatenate([np.ones((len(inputs), 1)), inputs], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [ridge] * inputs.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (targets - p)) - keep @ w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(patterns: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """(kind, pattern) -> probability, from (kind, pattern, count) over all documents."""
    out = {}
    for kind in KINDS:
        rows = sorted((p, n) for k, p, n in patterns if k == kind)
        if not rows:
            continue
        values = np.array([[int(v) for v in p.split(",")] for p, _ in rows])
        counts = np.array([n for _, n in rows], dtype=float)
        soft = estimate(values[:, : len(LABELERS)], counts)
        weights = fit(values, soft, counts)
        score = weights[0] + values @ weights[1:]
        # A span that more labelers reject than support is never personal data.
        balance = values[:, : len(LABELERS)].sum(axis=1)
        out.update({(kind, p): float(1 / (1 + math.exp(-max(-30.0, min(30.0, s))))) * (b > 0) for (p, _), s, b in zip(rows, score.tolist(), balance.tolist())})
    return out


ACCEPT = 0.5


def accepted_patterns(seen: DataFrame) -> dict[tuple[str, str], float]:
    """Fit both models on the pattern counts of all of ``seen`` (settled rows of :func:`found`)."""
    spans = seen.select(F.explode("proposed").alias("p"))
    counts = spans.groupBy("p.kind", "p.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return train([(r["kind"], r["pattern"], r["n"]) for r in counts])


def decided(seen: DataFrame, probability: dict[tuple[str, str], float]) -> DataFrame:
    """Counts, digest of the base spans, all spans, and the added ones, of every document."""
    accepted = frozenset(k for k, p in probability.items() if p >= ACCEPT)

    def run(rows):
        out = {k.split()[0]: [] for k in DECIDED.split(", ")}
        for key in ("doc_id", *("n_" + k for k in KINDS)):
            out[key] = rows[key]
        for base, proposed in zip(rows["base"], rows["proposed"]):
            extra = [(p["kind"], p["start"], p["end"]) for p in proposed if (p["kind"], p["pattern"]) in accepted]
            parsed = [(k, int(s), int(e)) for k, s, e in (b.split(":") for b in base)]
            spans = sorted({*parsed, *extra}, key=lambda s: (s[1], KINDS.index(s[0])))
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
            out["n_added"].append(len(spans) - len(parsed))
        yield out

    return map_rows(seen, DECIDED, run, **{c: c for c in seen.columns})


DECIDED = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find, train and decide; one row for every row of ``docs``."""
    seen = settle(found(docs, id_col, text_col), "llm-personal")
    return decided(seen, accepted_patterns(seen))


def masked_text(text: str, accepted: frozenset) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the earlier wins."""
    base = base_spans(text)
    extra = [(k, s, e) for k, s, e, v in proposals(text, base) if (k, ",".join(map(str, v))) in accepted]
    out, at = [], 0
    for kind, start, end in sorted([*base, *extra], key=lambda s: (s[1], KINDS.index(s[0]))):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, probability: dict[tuple[str, str], float], text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with personal data in the text replaced; a null text stays null."""
    accepted = frozenset(k for k, p in probability.items() if p >= ACCEPT)

    @F.udf("string", useArrow=True)
    def mask(text):
        return None if text is None else masked_text(text, accepted)

    return docs.withColumn(text_col, mask(F.col(text_col)))
