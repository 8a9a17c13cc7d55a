"""Message references, links, labels, dates and durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed, schemas
from mailfold.functions.text import blank_to_null, grab, let, strip

REFS_TYPE = f"array<{schemas.REF}>"


def encode_refs(refs: Column) -> Column:
    """``category|id|date[|fast]`` entries joined by `` ; ``."""

    def entry(r: Column) -> Column:
        flag = F.when(F.coalesce(r["fast_apply"], F.lit(False)), F.lit(fixed.REF_FAST_FLAG))
        return F.concat_ws(fixed.REF_FIELD_SEP, r["category"], r["message_id"], F.coalesce(r["date"], F.lit("")), flag)

    return F.coalesce(F.array_join(F.transform(refs, entry), fixed.REF_ENTRY_SEP), F.lit(""))


def decode_refs(cell: Column) -> Column:
    """The inverse; malformed entries are dropped and a foreign fourth field is ignored."""

    def entry(text: Column) -> Column:
        fields = F.transform(F.split(text, r"\|"), strip)
        return F.struct(
            F.get(fields, F.lit(1)).alias("message_id"),
            F.get(fields, F.lit(0)).alias("category"),
            F.coalesce(F.get(fields, F.lit(2)), F.lit("")).alias("date"),
            F.coalesce(F.get(fields, F.lit(3)) == fixed.REF_FAST_FLAG, F.lit(False)).alias("fast_apply"),
        )

    def valid(r: Column) -> Column:
        return (F.coalesce(r["message_id"], F.lit("")) != "") & r["category"].isin(*fixed.STATUSES)

    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda e: entry(strip(e))), valid)


def sanitize_refs(refs: Column) -> Column:
    """Well-formed references only, ids trimmed, the first of equal ids kept."""
    trimmed = F.transform(
        F.coalesce(refs, F.array().cast(REFS_TYPE)),
        lambda r: F.struct(
            strip(r["message_id"]).alias("message_id"),
            r["category"].alias("category"),
            F.coalesce(r["date"], F.lit("")).alias("date"),
            F.coalesce(r["fast_apply"], F.lit(False)).alias("fast_apply"),
        ),
    )
    valid = F.filter(
        trimmed,
        lambda r: (F.coalesce(r["message_id"], F.lit("")) != "")
        & F.coalesce(r["category"].isin(*fixed.STATUSES), F.lit(False)),
    )
    return let(
        valid,
        lambda rs: F.filter(rs, lambda r, i: F.array_position(rs["message_id"], r["message_id"]) == i + 1),
    )


def refs_chronological(refs: Column) -> Column:
    """By date string; equal dates keep their order."""
    placed = F.transform(refs, lambda r, i: F.struct(r["date"].alias("date"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda p: p["r"])


def extract_message_id(text: Column) -> Column:
    """The id at the end of a pasted link, or a bare id; null when nothing id-like is there."""
    bare = strip(text)
    tail = F.substring_index(F.substring_index(bare, "#", -1), "/", -1)
    candidate = F.when(bare.contains("#"), strip(F.substring_index(tail, "?", 1))).otherwise(bare)
    return let(candidate, lambda c: F.when(c.rlike(r"^[A-Za-z0-9_-]+\z"), c))


def _percent(text: Column) -> Column:
    """Percent-encoding of a URI component (form encoding differs in five characters)."""
    out = F.url_encode(text)
    for form, component in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(component))
    return out


def message_link(message_id: Column, account: Column) -> Column:
    user = F.when(blank_to_null(account).isNotNull(), F.concat(F.lit("?authuser="), _percent(account)))
    return F.concat(
        F.lit(fixed.MESSAGE_URL), F.coalesce(user, F.lit("")), F.lit("#all/"), _percent(message_id)
    )


def label(value: Column, labels: dict[str, str]) -> Column:
    """Human label; null for anything else."""
    return reduce(lambda out, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(out), labels.items(), F.lit(None).cast("string"))


def from_label(cell: Column, labels: dict[str, str]) -> Column:
    """Raw value from either the value or its label, ignoring case; null for anything else."""
    text = F.lower(cell)
    return reduce(
        lambda out, kv: F.when(text.isin(kv[0], kv[1].lower()), F.lit(kv[0])).otherwise(out),
        labels.items(),
        F.lit(None).cast("string"),
    )


def provenance(source: Column, detected_by: Column, edited: Column) -> Column:
    """Badges: imported, and how the newest mail was read until a user edits the record."""
    imported = F.when(source == "csv", F.lit(fixed.BADGE_IMPORTED))
    detected = F.when(~F.coalesce(edited, F.lit(False)), label(detected_by, fixed.BADGES))
    return F.filter(F.array(imported, detected), lambda b: b.isNotNull())


FREE_DATES = (
    "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy",
)
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +"


def iso_date(cell: Column) -> Column:
    """yyyy-MM-dd text from ISO, year-first, day/month-first or written dates, else null."""
    text = strip(cell)
    iso = grab(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})")
    year_first = r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$"
    year_last = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"

    def two(part: Column) -> Column:
        return F.lpad(part, 2, "0")

    from_year = F.concat_ws("-", grab(text, year_first, 1), two(grab(text, year_first, 2)), two(grab(text, year_first, 3)))
    a, b = grab(text, year_last, 1).cast("int"), grab(text, year_last, 2).cast("int")
    month, day = F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)
    from_parts = F.when(
        month.between(1, 12) & day.between(1, 31),
        F.concat_ws("-", grab(text, year_last, 3), two(month.cast("string")), two(day.cast("string"))),
    )
    bare = F.regexp_replace(text, WEEKDAY, "")
    written = F.coalesce(*[F.try_to_timestamp(bare, F.lit(fmt)) for fmt in FREE_DATES])
    return (
        F.when(iso.isNotNull(), iso)
        .when(grab(text, year_first, 0).isNotNull(), from_year)
        .when(from_parts.isNotNull(), from_parts)
        .otherwise(F.date_format(written, "yyyy-MM-dd"))
    )


def valid_date(text: Column) -> Column:
    """DATE from yyyy-MM-dd text; null for an impossible day."""
    return F.try_to_date(text, "yyyy-MM-dd")


def format_duration(ms: Column) -> Column:
    """``1h 2m 3s`` from milliseconds; zero units are dropped, all zero is ``0s``."""

    def units(total: Column) -> Column:
        hours = F.floor(total / 3600)
        minutes = F.floor((total % 3600) / 60)
        seconds = total % 60
        return F.concat_ws(
            " ",
            F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
            F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))),
            F.when((seconds > 0) | (total == 0), F.concat(seconds.cast("string"), F.lit("s"))),
        )

    return let(F.floor(ms / 1000 + 0.5).cast("bigint"), units)

