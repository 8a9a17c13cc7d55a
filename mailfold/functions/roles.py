"""Job titles: tidying and recovery from prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.text import digits, grab, let, matches, seen, strip, sub


def tidy_role(role: Column) -> Column:
    """Drop identifiers, work-mode and place tails; never rejects."""

    def without_lead(text: Column) -> Column:
        lead = F.coalesce(grab(text, fixed.ROLE_LEADING_REQ, 0), F.lit(""))
        return let(
            lead,
            lambda l: F.when(
                digits(l) >= fixed.REQ_MIN_DIGITS, strip(F.substring(text, F.length(l) + 1, F.length(text)))
            ).otherwise(text),
        )

    def chain(text: Column, steps: tuple) -> Column:
        for pattern, replacement in steps:
            text = strip(sub(text, pattern, replacement))
        return text

    # every identifier step needs a digit, a brace or a parenthesis to act on
    def without_ids(text: Column) -> Column:
        return F.when(
            text.rlike(r"[0-9{(]"), chain(let(text, without_lead), fixed.ROLE_ID_STRIPS)
        ).otherwise(text)

    # and every tail step a word, a comma or a dash: the title is already trimmed
    def without_tail(text: Column) -> Column:
        low, words = F.lower(text), fixed.NEEDED_WORDS[fixed.ROLE_TAIL_STRIPS]
        return F.when(seen(low, words), chain(text, fixed.ROLE_TAIL_STRIPS)).otherwise(text)

    return let(let(strip(role), without_ids), without_tail)


def clean_role(raw: Column) -> Column:
    """A captured title if it reads like one, else null."""
    low, high = fixed.ROLE_LENGTH

    def accept(text: Column) -> Column:
        return F.when(
            F.length(text).between(low, high)
            & ~matches(text, fixed.ROLE_OVERRUN)
            & ~matches(text, fixed.ROLE_PROSE)
            & ~matches(text, fixed.ROLE_COUNTRY),
            text,
        )

    def validate(text: Column) -> Column:
        return F.when(matches(text, fixed.ROLE_START), let(tidy_role(text), accept))

    bare = strip(sub(raw, fixed.ROLE_ARTICLE, ""))
    return let(strip(sub(bare, fixed.ROLE_POSSESSIVE, "")), validate)


def recover_role(body: Column, subject: Column) -> Column:
    """First of twelve prose patterns whose capture survives cleaning."""
    source = {"body": body, "subject": subject}

    def ladder(low: Column) -> Column:
        return F.coalesce(*[clean_role(grab(source[f], p, low=low[f])) for f, p in fixed.ROLE_RECOVERY])

    return let(F.struct(*[F.lower(text).alias(f) for f, text in source.items()]), ladder)


def unknown_role(role: Column) -> Column:
    """Reports: null, blank or the stored placeholder."""
    return role.isNull() | (strip(role) == "") | (role == fixed.UNKNOWN_ROLE)
