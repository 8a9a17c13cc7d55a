"""Application records as aggregates over their messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfold import fixed


def stage_of(category: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, stage in fixed.STAGE.items():
        out = F.when(category == name, F.lit(stage)).otherwise(out)
    return out


def forward_status(category: Column, order: Column) -> Column:
    """Aggregate: the first terminal stage in order if any, else the furthest stage."""
    terminal = F.min(F.when(category.isin(*fixed.TERMINAL), F.struct(order.alias("o"), category.alias("c"))))
    furthest = F.max(F.struct(stage_of(category).alias("s"), category.alias("c")))
    return F.coalesce(terminal["c"], furthest["c"])


def step_statuses(rows: DataFrame, keys: list[str], category: str, order: str) -> DataFrame:
    """Adds ``status`` after each row of its group, step by step in order: a terminal stage stays,
    another never goes back.  A running window, so no group is held as a whole."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stage = F.col(category)
    ended = F.first(F.when(stage.isin(*fixed.TERMINAL), stage), ignorenulls=True).over(so_far)
    furthest = F.max(F.struct(stage_of(stage).alias("s"), stage.alias("c"))).over(so_far)
    return rows.withColumn("status", F.coalesce(ended, furthest["c"]))


def auto_note(subject: Column, role_known: Column) -> Column:
    base = F.concat(F.lit(fixed.NOTE_PREFIX), subject)
    return F.when(role_known, base).otherwise(F.concat(base, F.lit(fixed.NOTE_WARNING)))


def rollup_applications(
    assigned: DataFrame, events: DataFrame, existing: DataFrame | None, as_of: dt.datetime
) -> DataFrame:
    """One record per application that received mail.

    ``existing`` records take part as the first contribution of their application, so one
    set of aggregates covers creation and merging.  All aggregates combine map-side.
    """
    joined = assigned.select("owner", "message_id", "app_id").join(events, ["owner", "message_id"])
    mail = joined.select(
        "owner",
        "app_id",
        F.lit(1).alias("kind_no"),
        "internal_ms",
        F.col("message_id").alias("ref"),
        "company",
        "role",
        F.col("category").alias("status"),
        F.col("category").isin("interview", "offer").alias("reached"),
        F.col("msg_date").alias("date_applied"),
        F.col("msg_date").alias("last_activity"),
        "subject",
        "external_id",
        "company_domain",
        "account",
        "detected_by",
        F.col("is_confirmation").alias("conf"),
        F.col("is_fast_apply").alias("fast"),
        (F.col("is_confirmation") & ~F.col("is_fast_apply")).alias("confirmed"),
        "thread_id",
        F.lit(None).cast("struct<notes:string,notes_source:string,interview_step:string,job_url:string,"
                         "edited:boolean,source:string,awaiting:boolean,first_ms:bigint,created_at:timestamp>")
        .alias("kept"),
    )
    if existing is not None:
        touched = assigned.select("owner", "app_id").distinct()
        mail = mail.unionByName(
            existing.join(touched, ["owner", "app_id"], "left_semi").select(
                "owner",
                "app_id",
                F.lit(0).alias("kind_no"),
                F.coalesce("last_activity_ts", F.lit(0)).alias("internal_ms"),
                F.lit("").alias("ref"),
                "company",
                F.when(F.col("role") != fixed.UNKNOWN_ROLE, F.col("role")).alias("role"),
                "status",
                F.col("reached_interview").alias("reached"),
                "date_applied",
                "last_activity",
                F.lit(None).cast("string").alias("subject"),
                "external_id",
                "company_domain",
                "account",
                "detected_by",
                F.lit(False).alias("conf"),
                F.col("fast_apply").alias("fast"),
                "confirmed",
                "thread_id",
                F.struct(
                    "notes", "notes_source", "interview_step", "job_url", "edited", "source",
                    F.col("awaiting_application").alias("awaiting"), "first_ms", "created_at",
                ).alias("kept"),
            )
        )
    order = F.struct(F.col("kind_no"), F.col("internal_ms"), F.col("ref"))
    recency = F.struct(F.col("internal_ms"), F.col("kind_no"), F.col("ref"))

    def first_known(name: str) -> Column:
        value = F.col(name)
        return F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]

    # fields that one row decides travel as one value: each aggregate carries its order through the shuffle
    stamp = F.lit(as_of).cast("timestamp")
    grouped = mail.groupBy("owner", "app_id").agg(
        F.min_by(F.struct("company", "thread_id"), order).alias("first"),
        first_known("role").alias("known_role"),
        forward_status(F.col("status"), order).alias("status"),
        F.bool_or("reached").alias("reached_interview"),
        F.min("date_applied").alias("date_applied"),
        F.max_by(F.struct("last_activity", "subject", "kind_no", "detected_by"), recency).alias("newest"),
        F.max("internal_ms").alias("last_activity_ts"),
        first_known("external_id").alias("external_id"),
        first_known("company_domain").alias("company_domain"),
        first_known("account").alias("account"),
        F.bool_or("conf").alias("any_conf"),
        F.bool_or("fast").alias("fast_apply"),
        F.bool_or("confirmed").alias("confirmed"),
        F.min(F.when(F.col("kind_no") == 1, F.col("internal_ms"))).alias("mail_ms"),
        F.max("kept").alias("kept"),
    )
    kept = F.col("kept")
    known = F.col("known_role").isNotNull()
    newest = F.col("newest")
    fresh_note = (newest["kind_no"] == 1) & ~F.coalesce(kept["notes_source"] == "manual", F.lit(False))
    return grouped.select(
        "owner",
        "app_id",
        F.col("first.company").alias("company"),
        F.coalesce("known_role", F.lit(fixed.UNKNOWN_ROLE)).alias("role"),
        "status",
        kept["interview_step"].alias("interview_step"),
        "reached_interview",
        "date_applied",
        newest["last_activity"].alias("last_activity"),
        "last_activity_ts",
        kept["job_url"].alias("job_url"),
        F.when(fresh_note, auto_note(newest["subject"], known)).otherwise(kept["notes"]).alias("notes"),
        F.coalesce(kept["notes_source"], F.lit("auto")).alias("notes_source"),
        "external_id",
        F.coalesce(kept["edited"], F.lit(False)).alias("edited"),
        newest["detected_by"].alias("detected_by"),
        "company_domain",
        (~F.col("any_conf") & F.coalesce(kept["awaiting"], F.lit(True))).alias("awaiting_application"),
        "fast_apply",
        "confirmed",
        F.coalesce(kept["source"], F.lit("gmail")).alias("source"),
        F.col("first.thread_id").alias("thread_id"),
        "account",
        F.when(kept.isNull(), F.col("mail_ms")).otherwise(kept["first_ms"]).alias("first_ms"),
        F.coalesce(kept["created_at"], stamp).alias("created_at"),
        stamp.alias("updated_at"),
    )


def application_refs(assigned: DataFrame, events: DataFrame) -> DataFrame:
    """One row per tracked message; ``position`` sorts them in merge order.

    Kept long rather than nested, so an application with very many messages stays many
    small rows; :func:`collect_refs` nests them where a report or sheet asks for it.
    """
    return assigned.select("owner", "message_id", "app_id").join(events, ["owner", "message_id"]).select(
        "owner",
        "app_id",
        F.col("internal_ms").alias("position"),
        "message_id",
        "category",
        F.date_format("msg_date", "yyyy-MM-dd").alias("date"),
        F.col("is_fast_apply").alias("fast_apply"),
    )


def collect_refs(refs: DataFrame) -> DataFrame:
    """(owner, app_id, emails): refs in merge order, the first of equal message ids kept."""
    once = refs.groupBy("owner", "app_id", "message_id").agg(
        F.min(F.struct("position", "category", "date", "fast_apply")).alias("r")
    )
    item = F.struct(
        F.col("r.position").alias("position"), "message_id", F.col("r.category").alias("category"),
        F.col("r.date").alias("date"), F.col("r.fast_apply").alias("fast_apply"),
    )
    nested = once.groupBy("owner", "app_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return nested.select(
        "owner",
        "app_id",
        F.transform(
            "items",
            lambda i: F.struct(
                i["message_id"].alias("message_id"), i["category"].alias("category"),
                i["date"].alias("date"), i["fast_apply"].alias("fast_apply"),
            ),
        ).alias("emails"),
    )


def sync_summary(events: DataFrame, assigned: DataFrame, known: int, failed: int) -> DataFrame:
    """One row of counters for a run; ``known`` were in the ledger, ``failed`` unreadable."""
    code = F.col("classifier_code")
    counters = (
        "processed", "added", "updated", "skipped", "failed",
        "board_a_applied", "board_a_rejected", "board_b_applied", "general_template",
    )

    def part(table: DataFrame, **values: Column) -> DataFrame:
        aggregated = table.agg(*[v.cast("bigint").alias(k) for k, v in values.items()])
        return aggregated.select(*[F.col(c) if c in values else F.lit(0).cast("bigint").alias(c) for c in counters])

    read = part(
        events,
        processed=F.count("*"),
        skipped=F.count_if(F.col("kind") == "skip") + F.lit(known),
        failed=F.max(F.lit(failed)),
        board_a_applied=F.count_if(code == fixed.CODE_A_APPLIED),
        board_a_rejected=F.count_if(code == fixed.CODE_A_REJECTED),
        board_b_applied=F.count_if(code == fixed.CODE_B_APPLIED),
        general_template=F.count_if(code == fixed.CODE_GENERAL),
    )
    merged = part(assigned, added=F.count_if(F.col("is_new")), updated=F.count_if(~F.col("is_new")))
    return read.unionByName(merged).agg(*[F.sum(c).alias(c) for c in counters])
