"""Choosing messages and applications."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.text import WHITE, let, matches

WORD = "[0-9A-Za-z_]"


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """Any of the phrases as whole words, ignoring case and the width of gaps."""
    alternatives = "|".join(re.escape(p).replace(r"\ ", f"[{WHITE}]+") for p in phrases)
    return f"(?i)(?<!{WORD})(?:{alternatives})(?!{WORD})"


def scan_window(days: int | None) -> int:
    """An offered window length, or the shortest one."""
    return days if days in fixed.SCAN_WINDOWS else fixed.SCAN_WINDOWS[0]


def in_window(messages: DataFrame, days: int | None, as_of: dt.date) -> DataFrame:
    since = as_of - dt.timedelta(days=scan_window(days))
    return messages.filter(F.col("msg_date") >= F.lit(since))


def candidate(messages: DataFrame) -> Column:
    """What the retrieval query asks of a message, apart from its age: at least one wanted phrase, no exclusion.

    Columns ``mailbox_category`` and ``account`` take part when they are there.
    """
    subject, sender = F.col("subject"), F.lower("sender")
    anywhere = F.concat_ws("\n", "subject", "body")
    keep = anywhere.rlike(phrase_pattern(fixed.WANTED_PHRASES))
    keep &= ~subject.rlike(phrase_pattern(fixed.EXCLUDED_SUBJECTS))
    keep &= ~anywhere.rlike(phrase_pattern(fixed.EXCLUDED_ANYWHERE))
    for address in fixed.EXCLUDED_SENDERS:
        keep &= ~sender.contains(address)
    if "account" in messages.columns:
        keep &= ~F.coalesce(sender.contains(F.lower("account")), F.lit(False))
    if "mailbox_category" in messages.columns:
        keep &= ~F.coalesce(
            F.lower("mailbox_category").isin(*fixed.EXCLUDED_MAILBOX_CATEGORIES), F.lit(False)
        )
    return keep


def select_candidates(messages: DataFrame, days: int | None, as_of: dt.date) -> DataFrame:
    """The retrieval query: recent candidates.  The date comparison comes first and reaches the scan."""
    recent = in_window(messages, days, as_of)
    return recent.filter(candidate(recent))


def unprocessed(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages the ledger does not know; runs before any body work."""
    return messages.join(ledger.select("owner", "message_id"), ["owner", "message_id"], "left_anti")


def noise_reason() -> Column:
    subjects = "(?i)" + "|".join(fixed.NOISE_SUBJECTS)
    patterns = {"subject": subjects, "sender": fixed.NOISE_SENDER, "body": fixed.NOISE_BODY}

    def noisy(name: str) -> Column:
        return let(F.lower(name), lambda low: matches(F.col(name), patterns[name], low))

    return F.coalesce(*[F.when(noisy(name), F.lit(name)) for name in patterns])


def mark_noise(messages: DataFrame) -> DataFrame:
    return messages.withColumn("noise_reason", noise_reason())


def drop_noise(messages: DataFrame) -> DataFrame:
    return mark_noise(messages).filter(F.col("noise_reason").isNull()).drop("noise_reason")


def search(apps: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive literal substring of company or role; blank text filters nothing."""
    if not text:
        return apps
    needle = F.lit(text.lower())
    return apps.filter(F.lower("company").contains(needle) | F.lower("role").contains(needle))


def with_status(apps: DataFrame, status: str | None) -> DataFrame:
    """Equality; a value outside the four statuses filters nothing."""
    return apps.filter(F.col("status") == status) if status in fixed.STATUSES else apps


def drop_applications(apps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining applications, requested ids with a ``found`` flag)."""
    keys = [c for c in ("owner", "app_id") if c in ids.columns]  # one owner's requests may leave the owner out
    wanted = ids.select(*keys).distinct()
    known = apps.select(*keys, F.lit(True).alias("found")).distinct()
    return (
        apps.join(wanted, keys, "left_anti"),
        wanted.join(known, keys, "left").withColumn("found", F.coalesce("found", F.lit(False))),
    )
