"""Sender addresses, employer domains and employer names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.text import WHITE, blank_to_null, grab, let, seen, strip, sub

SHARED_BRANDS = tuple(dict.fromkeys(host.split(".")[0] for host in fixed.SHARED_HOSTS))


def sender_address(sender: Column) -> Column:
    """Lower-case address in angle brackets, else the first token with an @, else ''."""
    bare = F.when(sender.contains("@"), grab(sender, r"\S+@\S+", 0))
    return F.lower(F.coalesce(grab(sender, r"<([^>]+)>"), bare, F.lit("")))


def company_domain(sender: Column) -> Column:
    """The employer's registrable domain; null for shared hosts and mail providers."""

    def registrable(labels: Column) -> Column:
        two = F.array_join(F.slice(labels, -2, 2), ".")
        three = F.array_join(F.slice(labels, -3, 3), ".")
        return (
            F.when((F.size(labels) >= 3) & two.rlike(fixed.SECOND_LEVEL_TLD.replace("$", r"\z")), three)
            .when(F.size(labels) >= 2, two)
            .otherwise(labels.getItem(0))
        )

    def own(reg: Column) -> Column:
        shared = reg.isin(*fixed.SHARED_HOSTS) | F.split_part(reg, F.lit("."), F.lit(1)).isin(*SHARED_BRANDS)
        return F.when(~shared, reg)

    host = blank_to_null(F.get(F.split(sender_address(sender), "@"), F.lit(1)))
    return let(
        host,
        lambda h: F.when(
            h.isNotNull() & ~h.isin(*fixed.SHARED_HOSTS), let(registrable(F.split(h, r"\.")), own)
        ),
    )


def normalize_company(name: Column) -> Column:
    """Trade name, without page qualifier and without one legal suffix."""
    steps = (fixed.TRADE_NAME_PREFIX, fixed.PAGE_QUALIFIER, fixed.LEGAL_SUFFIX)

    def shorten(text: Column) -> Column:
        out = text
        for step in steps:
            out = strip(sub(out, step, ""))
        words = [w for step in steps for w in fixed.NEEDED_WORDS[step]]
        return let(F.lower(text), lambda low: F.when(seen(low, words), out).otherwise(strip(text)))

    return let(name, shorten)


def name_words(name: Column) -> Column:
    """Lower-case words of a name, reduced to letters and digits, empties dropped."""
    bare = F.regexp_replace(F.lower(name), f"[^a-z0-9{WHITE}]+", "")
    return F.filter(F.split(bare, f"[{WHITE}]+"), lambda w: w != "")


def same_entity_words(a: Column, b: Column) -> Column:
    """One word list starts the other and only descriptors are added."""
    shorter = F.least(F.size(a), F.size(b))
    longer = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    extra = F.slice(longer, shorter + 1, F.greatest(F.size(longer) - shorter, F.lit(0)))
    return (
        (shorter > 0)
        & (F.slice(a, 1, F.greatest(shorter, F.lit(1))) == F.slice(b, 1, F.greatest(shorter, F.lit(1))))
        & F.forall(extra, lambda w: w.isin(*fixed.DESCRIPTORS))
    )


def same_entity(a: Column, b: Column) -> Column:
    return let(name_words(a), lambda wa: let(name_words(b), lambda wb: same_entity_words(wa, wb)))


def core_name(words: Column) -> Column:
    """Words without trailing descriptors, at least one kept.

    Two names of the same entity always share it, so it is an exact equi-join key for
    every name match; null when a name has no words.
    """

    def core(words: Column) -> Column:
        last_plain = F.array_max(
            F.transform(words, lambda w, i: F.when(~w.isin(*fixed.DESCRIPTORS), i + 1).otherwise(F.lit(1)))
        )
        return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, F.coalesce(last_plain, F.lit(1))), " "))

    return let(words, core)


def raw_first_word(name: Column) -> Column:
    return F.split(name, f"[{WHITE}]+").getItem(0)


def starts_with_word(name: Column, word: Column) -> Column:
    """``name`` starts with ``word``, ignoring case, and the word ends there."""
    head = F.lower(F.substring(name, F.lit(1), F.length(word))) == F.lower(word)
    following = F.lower(F.substring(name, F.length(word) + 1, F.lit(1)))
    return head & ~following.rlike("[a-z0-9]")


def title_key(role: Column) -> Column:
    """Letters and digits only; '' for a missing title."""
    return F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), "[^a-z0-9]", "")
