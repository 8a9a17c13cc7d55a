"""Creating, editing and importing applications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.refs import sanitize_refs, valid_date
from mailfold.functions.text import blank_to_null, strip
from mailfold.operators.blocks import connected_components
from mailfold.session import settle, together

EDITABLE = (
    "company", "role", "status", "interview_step", "reached_interview", "date_applied",
    "last_activity", "job_url", "external_id", "notes", "account",
)


def date_ms(date: Column) -> Column:
    """Epoch ms of a day, 0 when unknown."""
    return F.coalesce(F.unix_date(date).cast("bigint") * F.lit(86_400_000), F.lit(0).cast("bigint"))


def prepare_new(rows: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(accepted applications, rejects with a reason) from hand-made or imported rows.

    ``rows`` carry owner, app_id, the text fields of an application, ``reached_interview``
    and ``emails``; dates are yyyy-MM-dd text.
    """
    missing = blank_to_null(F.col("company")).isNull() | blank_to_null(F.col("role")).isNull()
    checked = rows.withColumn("reason", F.when(missing, F.lit("company and role are required")))
    status = blank_to_null(F.col("status"))
    reached = F.coalesce("reached_interview", F.lit(False)) | F.coalesce(
        status.isin("interview", "offer"), F.lit(False)
    )
    promoted = reached & (status.isNull() | (status == "applied"))
    stamp = F.lit(as_of).cast("timestamp")
    accepted = (
        checked.filter(F.col("reason").isNull())
        .withColumn("activity", valid_date(blank_to_null(F.col("last_activity"))))
        .select(
            "owner",
            "app_id",
            "company",
            "role",
            F.when(promoted, F.lit("interview")).otherwise(F.coalesce(status, F.lit("applied"))).alias("status"),
            blank_to_null(F.col("interview_step")).alias("interview_step"),
            reached.alias("reached_interview"),
            valid_date(blank_to_null(F.col("date_applied"))).alias("date_applied"),
            F.col("activity").alias("last_activity"),
            date_ms(F.col("activity")).alias("last_activity_ts"),
            blank_to_null(F.col("job_url")).alias("job_url"),
            blank_to_null(F.col("notes")).alias("notes"),
            F.lit("manual").alias("notes_source"),
            blank_to_null(F.col("external_id")).alias("external_id"),
            F.lit(False).alias("edited"),
            F.lit(None).cast("string").alias("detected_by"),
            blank_to_null(F.col("company_domain")).alias("company_domain"),
            F.lit(False).alias("awaiting_application"),
            F.lit(False).alias("fast_apply"),
            F.lit(False).alias("confirmed"),
            F.when(F.col("source").isin(*fixed.USER_SOURCES), F.col("source"))
            .otherwise(F.lit("manual"))
            .alias("source"),
            F.lit(None).cast("string").alias("thread_id"),
            blank_to_null(strip(F.col("account"))).alias("account"),
            F.lit(None).cast("bigint").alias("first_ms"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
            sanitize_refs(F.col("emails")).alias("emails"),
        )
    )
    return accepted, checked.filter(F.col("reason").isNotNull())


#: Applications are keyed on owner and id: ids of two owners may be equal.
KEYS = ["owner", "app_id"]


def _same(keys: list[str]) -> Column:
    """Rows whose ``keys`` equal the private copies ``_owner``, ``_app_id`` of them."""
    on = F.lit(True)
    for c in keys:
        on &= F.col(c) == F.col(f"_{c}")
    return on


def _private(table: DataFrame, keys: list[str], *rest: Column) -> DataFrame:
    return table.select(*[F.col(c).alias(f"_{c}") for c in keys], *rest)


def check_edits(edits: DataFrame) -> DataFrame:
    """Adds ``reason``: why an edit is refused, or null.

    Edits carry no order, so several of one application contradict each other and are all refused.
    """
    fields = F.col("set_fields")
    status, step = fields["status"], fields["interview_step"]
    bad_status = F.map_contains_key(fields, "status") & ~F.coalesce(status.isin(*fixed.STATUSES), F.lit(False))
    bad_step = step.isNotNull() & ~step.isin(*fixed.STEPS)
    checked = edits.withColumn(
        "reason",
        F.when(F.coalesce(bad_status, F.lit(False)), F.lit("invalid status")).when(
            F.coalesce(bad_step, F.lit(False)), F.lit("invalid interview_step")
        ),
    )
    keys = KEYS
    several = edits.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = F.when(F.col("_n").isNotNull(), F.lit("several edits of one application"))
    joined = checked.join(_private(several, keys, F.col("_n")), _same(keys), "left")
    return joined.withColumn("reason", F.coalesce("reason", repeated)).drop("_n", *[f"_{c}" for c in keys])


def apply_edits(apps: DataFrame, edits: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(applications after the edits, refused edits with a reason).

    An edit is a map of the fields it sets: an absent key leaves the field, a null value
    clears it.
    """
    checked, keys = check_edits(edits), KEYS
    good = _private(checked.filter(F.col("reason").isNull()), keys, F.col("set_fields").alias("_set"))
    joined = apps.join(good, _same(keys), "left")
    given = F.col("_set")

    def sets(name: str) -> Column:
        return F.coalesce(F.map_contains_key(given, name), F.lit(False))

    def value(name: str) -> Column:
        raw = given[name]
        if name == "account":
            return blank_to_null(strip(raw))
        if name == "reached_interview":
            return raw.try_cast("boolean")
        if name in ("date_applied", "last_activity"):
            return valid_date(raw)
        return raw

    changes = {name: F.when(sets(name), value(name)).otherwise(F.col(name)) for name in EDITABLE}
    advanced = sets("status") & given["status"].isin("interview", "offer")
    changes["reached_interview"] = F.when(advanced, F.lit(True)).otherwise(changes["reached_interview"])
    changes["notes_source"] = F.when(sets("notes"), F.lit("manual")).otherwise(F.col("notes_source"))
    changes["edited"] = F.col("edited") | sets("company") | sets("role")
    changes["last_activity_ts"] = F.when(
        sets("last_activity"), date_ms(valid_date(given["last_activity"]))
    ).otherwise(F.col("last_activity_ts"))
    changes["updated_at"] = F.when(given.isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    unmatched = (
        checked.filter(F.col("reason").isNull())
        .join(_private(apps, keys), _same(keys), "left_anti")
        .withColumn("reason", F.lit("not found"))
    )
    refused = checked.filter(F.col("reason").isNotNull()).unionByName(unmatched)
    return joined.withColumns(changes).drop("_set", *[f"_{c}" for c in keys]), refused


def apply_ref_edits(refs: DataFrame, edits: DataFrame, apps: DataFrame) -> DataFrame:
    """Replace the references of applications whose edit carries ``emails``."""
    replaced = check_edits(edits).filter(F.col("reason").isNull() & F.col("emails").isNotNull())
    keys = KEYS
    fresh = (
        replaced.join(apps.select("owner", "app_id"), keys)
        .select("owner", "app_id", F.posexplode(sanitize_refs(F.col("emails"))).alias("position", "r"))
        .select(
            "owner", "app_id", F.col("position").cast("bigint").alias("position"), "r.message_id", "r.category",
            "r.date", "r.fast_apply",
        )
    )
    kept = refs.join(replaced.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def company_role_key(company: Column, role: Column) -> Column:
    return F.concat(F.lower(strip(company)), F.lit("|||"), F.lower(strip(role)))


def new_from_csv(parsed: DataFrame, apps: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``is_new``: rows of a sheet that are not on the board, in-file copies collapsed.

    ``parsed`` carries owner, position, company, role and emails.  A row with references is
    a copy if any of its ids is on the board or on an earlier accepted row; a row without
    is a copy if its company and role are (:func:`settle_chain`).
    """
    rows = parsed.select("owner", "position", "company", "role", F.col("emails.message_id").alias("ids"))
    with_ids = rows.filter(F.size("ids") > 0)
    without = rows.filter(F.size("ids") == 0)

    # no references: the first row of a company and role that the board does not have
    known_keys = apps.select("owner", company_role_key(F.col("company"), F.col("role")).alias("key")).distinct()
    keyed = without.withColumn("key", company_role_key(F.col("company"), F.col("role")))
    firsts = keyed.groupBy("owner", "key").agg(F.min("position").alias("position"))
    new_keys = firsts.join(known_keys, ["owner", "key"], "left_anti").select("owner", "position")

    long = with_ids.select("owner", "position", F.explode(F.array_distinct("ids")).alias("id"))
    board_ids = refs.select("owner", F.col("message_id").alias("id")).distinct()
    on_board = long.join(board_ids, ["owner", "id"], "left_semi").select("owner", "position").distinct()
    open_rows = long.join(on_board, ["owner", "position"], "left_anti")
    accepted = settle_chain(open_rows)

    fresh = new_keys.unionByName(accepted).withColumn("is_new", F.lit(True))
    return parsed.join(fresh, ["owner", "position"], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))
    )


def settle_chain(long: DataFrame) -> DataFrame:
    """Accepted (owner, position) among rows sharing ids; ``long`` is (owner, position, id).

    In order of position a row is accepted unless one of its ids is on an accepted row.  Rows
    can only touch each other within a component of shared ids, so each component is walked
    once, in order; rows that share no id are accepted as they are.
    """
    rows = settle(long, "import")
    shared = rows.groupBy("owner", "id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    linked = settle(rows.join(shared, ["owner", "id"]), "shared-ids")
    alone = rows.join(linked, ["owner", "position"], "left_anti").select("owner", "position").distinct()
    row_node = F.concat(F.lit("p:"), F.col("position"))
    parts = connected_components(linked.select("owner", row_node.alias("u"), F.concat(F.lit("i:"), F.col("id")).alias("v")), "import-parts")
    sets = linked.groupBy("owner", "position").agg(F.collect_list("id").alias("ids")).withColumn("node", row_node)
    width = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = sets.join(parts, ["owner", "node"]).select("owner", "component", "position", "ids")
    ordered = together(walked, width, "owner", "component").sortWithinPartitions("owner", "component", "position")
    return alone.unionByName(ordered.mapInPandas(_accept, "owner STRING, position BIGINT"))


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of components one after the other; what is remembered are the accepted ids of the open one."""
    current, taken = None, set()
    for batch in batches:
        accepted = []
        for owner, component, position, ids in batch.itertuples(index=False, name=None):
            if (owner, component) != current:
                current, taken = (owner, component), set()
            if taken.isdisjoint(ids):
                taken.update(ids)
                accepted.append((owner, position))
        yield pd.DataFrame(accepted, columns=["owner", "position"])


def import_summary(marked: DataFrame, failed: int = 0) -> DataFrame:
    """One row: imported, skipped copies, failed and the tone of the message."""
    counted = marked.agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("is_new")) - F.lit(failed)).alias("imported"),
        F.count_if(~F.col("is_new")).alias("duplicates"),
    )
    return counted.select(
        "imported",
        "duplicates",
        F.lit(failed).cast("bigint").alias("failed"),
        F.when((F.col("n") == 0) | (F.lit(failed) > 0) | (F.col("imported") == 0), F.lit("warning"))
        .otherwise(F.lit("success"))
        .alias("tone"),
        F.when(F.col("n") == 0, F.lit("Nothing to import"))
        .when(F.col("imported") > 0, F.lit("Import complete"))
        .otherwise(F.lit("Nothing new to import"))
        .alias("title"),
    )


def ledger_append(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent on (owner, message_id): the first writer wins."""
    first = new.groupBy("owner", "message_id").agg(
        F.min(F.struct("synced_at", "thread_id", "classified_as")).alias("r")
    )
    rows = first.select(
        "owner", "message_id", F.col("r.thread_id").alias("thread_id"),
        F.col("r.classified_as").alias("classified_as"), F.col("r.synced_at").alias("synced_at"),
    )
    absent = rows.join(ledger.select("owner", "message_id"), ["owner", "message_id"], "left_anti")
    return ledger.unionByName(absent)


def changed_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, app_id) of applications that are new or whose ``updated_at`` moved."""
    old = before.select(*KEYS, F.col("updated_at").alias("_before"))
    return after.join(old, KEYS, "left").filter(~F.col("updated_at").eqNullSafe(F.col("_before"))).select(*KEYS)
