"""Board, table, statistics and link reports over applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.refs import encode_refs, label, message_link, provenance
from mailfold.functions.roles import unknown_role
from mailfold.session import settle

SORT_KEYS = ("company", "role", "status", "date_applied", "last_activity")


def stats(apps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, active, offers and interview rate (percent, one decimal, half up)."""
    interviewed = F.col("status").isin("interview", "offer") | F.col("reached_interview")
    counted = apps.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "rejected").alias("active"),
        F.count_if(F.col("status") == "offer").alias("offers"),
        F.count_if(interviewed).alias("interviewed"),
    )
    share = F.col("interviewed").cast("decimal(18,0)") * 100 / F.nullif("total", F.lit(0)).cast("decimal(18,0)")
    rate = F.coalesce(F.round(share, 1).cast("decimal(4,1)").cast("string"), F.lit("0.0"))
    return counted.withColumn("interview_rate", rate)


def count_by_status(apps: DataFrame) -> DataFrame:
    """All four statuses with their label and count, zero included."""
    spark = apps.sparkSession
    rows = [(i, s, fixed.STATUS_LABELS[s]) for i, s in enumerate(fixed.STATUSES)]
    columns = spark.createDataFrame(rows, "position INT, status STRING, label STRING")
    counts = apps.groupBy("status").agg(F.count("*").alias("n"))
    return columns.join(counts, "status", "left").select(
        F.col("position").cast("bigint").alias("position"), "status", "label",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def board(apps: DataFrame, preview: int = fixed.BOARD_PREVIEW, by: Sequence[str] = ("owner",)) -> DataFrame:
    """Per board and status: the newest ``preview`` cards with their rank, and how many hide.

    The rank filter is a grouped limit, applied before the shuffle as well as after it, so
    a status that holds most rows moves only ``preview`` rows per task; counts are
    aggregated on their own for the same reason.
    """
    keys = [*by, "status"]
    order = Window.partitionBy(*keys).orderBy(
        F.col("last_activity").desc_nulls_last(), F.col("updated_at").desc(), F.col("app_id")
    )
    shown = apps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= preview)
    counts = apps.groupBy(*keys).agg(F.count("*").alias("n_status"))
    return shown.join(counts, keys).withColumn(
        "hidden", F.greatest(F.col("n_status") - F.lit(preview), F.lit(0))
    )


def ranked(apps: DataFrame, order: Sequence[Column], by: Sequence[str] = ("owner",)) -> DataFrame:
    """Adds ``rank`` (from 1) inside each ``by`` group without gathering a group in one task.

    Rows are range-sorted over the cluster; a row's rank is its place in its own partition
    plus the sizes of the partitions before it, less the rows of the groups before its own.
    Only one number per partition and one per group is exchanged.
    """
    placed = apps.orderBy(*[F.col(c) for c in by], *order).withColumns(
        {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
    )
    written = settle(placed, "ranked")
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort: bounded by the cluster, not by the data
    before = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("_n")
    overall = written.join(F.broadcast(before), "_part").withColumn(
        "_overall", F.col("_before") + F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    )
    if not by:
        return overall.withColumn("rank", F.col("_overall") + 1).drop("_part", "_place", "_before", "_overall")
    starts = overall.groupBy(*by).agg(F.min("_overall").alias("_start"))
    return (
        overall.join(starts, list(by))
        .withColumn("rank", F.col("_overall") - F.col("_start") + 1)
        .drop("_part", "_place", "_before", "_overall", "_start")
    )


def default_order() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("app_id").asc()]


def table_order(key: str, descending: bool = False, collation: str | None = None) -> list[Column]:
    """Order of the table view; unknown titles come last in both directions."""
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {key!r}")
    value = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if collation:
        value = F.collate(value, collation)
    first = [unknown_role(F.col("role")).asc()] if key == "role" else []
    return [*first, value.desc() if descending else value.asc(), *default_order()]


def table_sort(
    apps: DataFrame,
    key: str = "last_activity",
    descending: bool = True,
    collation: str | None = None,
    by: Sequence[str] = ("owner",),
) -> DataFrame:
    return ranked(apps, table_order(key, descending, collation), by)


def page(sorted_apps: DataFrame, number: int, size: int = fixed.PAGE_SIZE, by: Sequence[str] = ("owner",)) -> DataFrame:
    """Page ``number`` (from 0) of every board, clamped to its last page."""
    totals = sorted_apps.groupBy(*by).agg(F.max("rank").alias("n_total"))
    last = F.ceil(F.col("n_total") / size) - 1
    start = F.least(F.lit(number), last) * size
    return (
        sorted_apps.join(totals, list(by))
        .withColumn("page", F.least(F.lit(number).cast("bigint"), last.cast("bigint")))
        .filter((F.col("rank") > start) & (F.col("rank") <= start + size))
    )


def with_labels(apps: DataFrame) -> DataFrame:
    """Human labels, badges and the unknown-title flag."""
    return apps.withColumns(
        {
            "status_label": label(F.col("status"), fixed.STATUS_LABELS),
            "step_label": label(F.col("interview_step"), fixed.STEP_LABELS),
            "badges": provenance(F.col("source"), F.col("detected_by"), F.col("edited")),
            "unknown_role": unknown_role(F.col("role")),
        }
    )


def email_links(refs: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per tracked message with its label and web link; ``date`` and ``position`` order them."""
    accounts = apps.select("owner", "app_id", "account")
    text = F.when(F.col("fast_apply"), F.lit(fixed.LINK_FAST)).otherwise(
        F.concat(F.lit(fixed.LINK_STAGE), label(F.col("category"), fixed.STATUS_LABELS))
    )
    return refs.join(accounts, ["owner", "app_id"]).select(
        "owner", "app_id", "date", "position", "message_id", text.alias("label"),
        message_link(F.col("message_id"), F.col("account")).alias("link"),
    )


def sheet(apps: DataFrame) -> DataFrame:
    """The fourteen labelled text columns of the exported sheet; ``apps`` carries ``emails``."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    values = (
        text("company"),
        text("role"),
        F.coalesce(label(F.col("status"), fixed.STATUS_LABELS), F.col("status")),
        F.coalesce(label(F.col("interview_step"), fixed.STEP_LABELS), F.lit("")),
        F.when(F.col("reached_interview"), F.lit("Yes")).otherwise(F.lit("No")),
        text("date_applied"),
        text("last_activity"),
        text("job_url"),
        text("notes"),
        text("source"),
        text("company_domain"),
        text("external_id"),
        text("account"),
        encode_refs(F.col("emails")),
    )
    return apps.select(*[v.alias(h) for v, h in zip(values, fixed.CSV_HEADERS, strict=True)])
