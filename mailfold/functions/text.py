"""Pattern rendering and text cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed

# Unicode white space; the JVM's own \s knows ASCII only.  \p{Z} is all of it but for controls and U+FEFF: a
# class of few parts, which the JVM tries one by one for every character of a text.
WHITE = r"\t-\r\p{Z}\ufeff"
WHITE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_WORD = "[0-9A-Za-z_]"


def jvm(pattern: str) -> str:
    """Render a fixed pattern for the JVM: Unicode ``\\s``, ASCII ``\\b``, absolute ``$``."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            rest = pattern[i + 2:]
            i += 2
            if nxt == "s":
                out.append(WHITE if in_class else f"[{WHITE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{WHITE}]")
            elif nxt == "b" and not in_class:
                out.append(f"(?<!{_WORD})" if _opens_word(rest) else f"(?!{_WORD})")
            else:
                out.append(ch + nxt)
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch == "[":
                ch = "\\["
        elif ch == "[":
            in_class = True
        elif ch == "$":
            ch = r"\z"
        out.append(ch)
        i += 1
    return "".join(out)


def _opens_word(rest: str) -> bool:
    """Does the boundary stand before a word (rather than after one)?"""
    if not rest or rest.startswith(("(?:\\s", "[^")):
        return False
    return rest[0].isalnum() or rest[0] in "(["


def seen(low: Column, words: Sequence[str]) -> Column:
    """Does the lower-cased text hold one of the words?"""
    return reduce(or_, [low.contains(w) for w in words])


def matches(col: Column, pattern: str, low: Column | None = None) -> Column:
    """Does the pattern match?  ``low``, the text in lower case, spares most texts the scan.

    A plain search for the words a pattern needs costs a small part of its scan.  Patterns
    ignore the case of ASCII letters only, so a text without any of the words cannot match.
    """
    found = col.rlike(jvm(pattern))
    return found if low is None else seen(low, fixed.NEEDED_WORDS[pattern]) & found


def sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, jvm(pattern), replacement.replace("\\", "\\\\").replace("$", "\\$"))


def grab(col: Column, pattern: str, group: int = 1, low: Column | None = None) -> Column:
    """A capture group of the first match, null when there is none; ``low`` as for :func:`matches`.

    The text is scanned once: ``nullif`` would repeat the scan inside lambdas, and elsewhere
    run it for every row, ahead of the conditions it stands behind.
    """
    found = let(F.regexp_extract(col, jvm(pattern), group), lambda g: F.when(g != "", g))
    return found if low is None else F.when(seen(low, fixed.NEEDED_WORDS[pattern]), found)


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(WHITE_CHARS))


def squash(col: Column) -> Column:
    return strip(F.regexp_replace(col, rf"[{WHITE}]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name ``value`` inside ``body`` so that it is computed once however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def digits(col: Column) -> Column:
    return F.length(F.regexp_replace(col, "[^0-9]", ""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


# --- message parts ---------------------------------------------------------------


def part_text(parts: Column, mime_type: str) -> Column:
    """Decoded text of the first non-empty part of a type, depth-first; null if absent."""
    found = F.filter(
        parts, lambda p: (p["mime_type"] == mime_type) & (F.length(F.coalesce(p["data"], F.lit(""))) > 0)
    )
    data = F.get(found, F.lit(0))["data"]
    raw = F.unbase64(F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")))
    return F.make_valid_utf8(raw.cast("string"))


def select_body(parts: Column) -> Column:
    """Plain text, unless it is an unrendered template and an HTML part exists."""
    usable = lambda t: (t != "") & ~(t.rlike("[<{I]") & matches(t, fixed.TEMPLATE_MARKERS))
    return let(
        part_text(parts, "text/plain"),
        lambda plain: F.when(usable(plain), plain)
        .otherwise(F.coalesce(strip_html(part_text(parts, "text/html")), plain, F.lit(""))),
    )


def html_body(parts: Column) -> Column:
    return F.coalesce(strip_html(part_text(parts, "text/html")), F.lit(""))


# --- cleaning ----------------------------------------------------------------------


def strip_html(col: Column) -> Column:
    text = sub(col, fixed.STYLE_BLOCK, "")
    text = sub(text, fixed.SCRIPT_BLOCK, "")
    return squash(sub(text, fixed.ANY_TAG, " "))


def decode_entities(col: Column) -> Column:
    def chain(text: Column, entities: Sequence[tuple[str, str]]) -> Column:
        for pattern, replacement in entities:
            text = sub(text, pattern, replacement)
        return text

    def rest(text: Column) -> Column:
        return F.when(text.contains("&"), chain(text, fixed.ENTITIES[2:])).otherwise(text)

    # every entity starts with an ampersand: text skips what it has none for, before and after the two commonest
    decoded = F.when(col.contains("&"), let(chain(col, fixed.ENTITIES[:2]), rest)).otherwise(col)
    return F.regexp_replace(decoded, fixed.INVISIBLE, "")


def _without_markup(col: Column) -> Column:
    return let(col, lambda text: F.when(matches(text, fixed.MARKUP_SEEN), strip_html(text)).otherwise(text))


def clean_body(col: Column) -> Column:
    """Flatten a body to one line of prose without boilerplate."""

    def tidy(markup_free: Column) -> Column:
        text = decode_entities(markup_free)
        text = sub(text, fixed.ARTIFACT_TEMPLATE, "")
        text = sub(text, fixed.ARTIFACT_NUMBER, "")
        text = sub(text, fixed.LINK_MARKER, "")
        text = sub(text, fixed.URL, "")
        text = sub(text, fixed.DIVIDER, " ")
        return let(let(text, without_notices), lambda t: squash(_before_footer(t)))

    def without_notices(text: Column) -> Column:
        out = text
        for notice in fixed.REPLY_NOTICES:
            out = sub(out, notice, " ")
        words = [w for notice in fixed.REPLY_NOTICES for w in fixed.NEEDED_WORDS[notice]]
        return F.when(seen(F.lower(text), words), out).otherwise(text)

    return let(_without_markup(col), tidy)


def _before_footer(text: Column) -> Column:
    """Cut at the first footer signal; a text that starts with one is left whole."""

    def cut(low: Column) -> Column:
        head = F.split(text, jvm(fixed.FOOTER), 2).getItem(0)
        return F.when(seen(low, fixed.NEEDED_WORDS[fixed.FOOTER]), let(head, lambda h: F.when(h != "", h)))

    return F.coalesce(let(F.lower(text), cut), text)


def clean_card_body(col: Column) -> Column:
    """Job-board cards keep their lines: the extractor reads them by position."""

    def tidy(markup_free: Column) -> Column:
        text = decode_entities(markup_free)
        text = F.split(text, jvm(fixed.CARD_TAIL), 2).getItem(0)
        text = sub(text, fixed.URL, "")
        text = sub(text, fixed.DIVIDER, " ")
        lines = F.transform(F.split(text, "\n"), lambda l: strip(F.regexp_replace(l, "[ \t]+", " ")))
        kept = F.filter(lines, lambda l: (l != "") & ~matches(l, fixed.CARD_LINK_LINE))
        return F.array_join(kept, "\n")

    return let(_without_markup(col), tidy)


def build_body(parts: Column, sender: Column) -> Column:
    """The whole cleaned text the classifiers read, by sending platform."""

    def board_b(rich: Column) -> Column:
        employer = strip(grab(rich, fixed.BOARD_B_SENT_TO))
        return F.when(
            employer.isNotNull(),
            F.concat(F.lit("Employer: "), employer, F.lit("\n\n"), rich),
        ).otherwise(rich)

    rich = clean_body(F.coalesce(let(html_body(parts), blank_to_null), select_body(parts)))
    return (
        F.when(sender.contains(fixed.BOARD_A_SENDER), clean_card_body(select_body(parts)))
        .when(sender.contains(fixed.BOARD_B_SENDER), let(rich, board_b))
        .otherwise(clean_body(select_body(parts)))
    )
