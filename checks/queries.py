"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import shapes
from mailfold import fixed
from mailfold.functions import identity, refs as ref_functions, requisition, roles, templates, text
from mailfold.operators import assign, blocks, classify, edits, match, reports, rollup, select
from mailfold.plans.history import build_history
from mailfold.session import scratch_path, settle
from mailfold.sources import messages as message_source
from mailfold.sources import sheets
from mailfold.sources.bridge import derive
from mailfold.sources.snapshots import Board
from mailfold.streaming.landing import Landing
from mailfold.streaming.sync import incremental_sync, progress, rebuilt, running_totals, sync_batch, sync_landed

AS_OF = dt.datetime(2002, 1, 1)
SCAN_AS_OF = dt.date(1999, 6, 30)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def shaped(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested dumps around the derived messages: headers, MIME parts, receipt times."""
    m = derive(spark, sf_dir, "messages").selectExpr(
        "*",
        f"{shapes.PLAIN_TEXT} AS plain",
        f"{shapes.HTML_TEXT} AS html",
    )
    url_safe = lambda c: F.replace(F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    part = lambda path, kind, data: F.struct(
        F.lit(path).alias("path"), F.lit(kind).alias("mime_type"), url_safe(data).alias("data")
    )
    header = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    late = F.col("internal_ms") % 5 == 0
    undated = F.col("internal_ms") % 35 == 0
    date_header = F.date_format(F.timestamp_millis("internal_ms"), "EEE, d MMM yyyy HH:mm:ss '+0000'")
    return m.select(
        F.col("message_id").alias("id"),
        "thread_id",
        F.when(~late, F.col("internal_ms").cast("string")).alias("internal_date"),
        "account",
        "owner",
        F.when(F.col("internal_ms") % 23 == 0, F.lit("promotions")).alias("mailbox_category"),
        F.array(
            header(F.when(F.col("internal_ms") % 11 == 0, F.lit("subject")).otherwise(F.lit("Subject")), F.col("subject")),
            header(F.lit("From"), F.col("sender")),
            header(F.when(undated, F.lit("X-Date")).otherwise(F.lit("Date")), date_header),
        ).alias("headers"),
        F.array(
            part("0.0", "text/plain", F.col("plain")),
            part("0.1", "text/html", F.col("html")),
        ).alias("parts"),
    )


# --- sources -----------------------------------------------------------------------


@query
def messages_read(spark, sf_dir):
    path = scratch_path(spark, "dumps")
    raw_messages(spark, sf_dir).write.mode("overwrite").json(path, compression="gzip")
    readable, _ = message_source.split_corrupt(message_source.read_messages(spark, path))
    m = message_source.project_messages(readable, AS_OF)
    return m.select("owner", "message_id", "thread_id", "subject", "sender", "internal_ms", day("msg_date"))


@query
def message_bodies_selected(spark, sf_dir):
    raw = raw_messages(spark, sf_dir)
    return raw.select(F.col("id").alias("message_id"), text.select_body(F.col("parts")).alias("body"))


@query
def message_bodies_built(spark, sf_dir):
    projected = message_source.project_messages(raw_messages(spark, sf_dir), AS_OF)
    return message_source.clean_messages(projected).select("message_id", "body")


@query
def candidates_selected(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").withColumn(
        "mailbox_category", F.when(F.col("internal_ms") % 23 == 0, F.lit("promotions"))
    )
    return select.select_candidates(m, 180, SCAN_AS_OF).select("owner", "message_id", day("msg_date"))


@query
def scan_window_counts(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").select("msg_date")
    parts = [
        select.in_window(m, d, SCAN_AS_OF).agg(
            F.lit(d).cast("bigint").alias("requested"),
            F.lit(select.scan_window(d)).cast("bigint").alias("days"),
            F.count("*").alias("n"),
        )
        for d in (30, 60, 90, 180, 45)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derive(spark, sf_dir, "messages").filter(F.col("msg_date") < F.lit(dt.date(1998, 1, 1)))
    return m.select(
        "owner", "message_id", "thread_id", F.lit("applied").alias("classified_as"),
        F.lit(AS_OF).cast("timestamp").alias("synced_at"),
    )


@query
def messages_unprocessed(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").select("owner", "message_id", "thread_id")
    return select.unprocessed(m, sample_ledger(spark, sf_dir))


@query
def ledger_appended(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    new = m.select(
        "owner", "message_id", "thread_id", F.lit("rejected").alias("classified_as"),
        F.lit(AS_OF + dt.timedelta(days=1)).cast("timestamp").alias("synced_at"),
    )
    again = new.withColumn("classified_as", F.lit("ignored")).withColumn(
        "synced_at", F.lit(AS_OF + dt.timedelta(days=2)).cast("timestamp")
    )
    out = edits.ledger_append(sample_ledger(spark, sf_dir), new.unionByName(again))
    return out.select("owner", "message_id", "thread_id", "classified_as")


@query
def board_reset(spark, sf_dir):
    apps, ref_rows = thread_applications(spark, sf_dir), thread_refs(spark, sf_dir)
    board = Board(spark, scratch_path(spark, "board"))
    board.commit(apps, ref_rows, sample_ledger(spark, sf_dir), at=AS_OF)
    kept = board.applications().count()
    lost = board.reset(AS_OF)
    rows = [(kept, lost["applications"], lost["messages"])]
    left = board.applications().agg(F.count("*").alias("applications_left"))
    return left.select(
        *[F.lit(v).cast("bigint").alias(n) for n, v in zip(("saved", "applications", "messages"), rows[0], strict=True)],
        "applications_left",
    )


# --- noise and text ------------------------------------------------------------------


@query
def noise_marked(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").selectExpr("*", f"{shapes.NOISY_SUBJECT} AS noisy")
    marked = select.mark_noise(m.drop("subject").withColumnRenamed("noisy", "subject"))
    return marked.select("message_id", "noise_reason")


@query
def messages_kept(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return select.drop_noise(m).groupBy("owner").agg(F.count("*").alias("n_kept"))


@query
def pages_stripped(spark, sf_dir):
    pages = source(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_html(F.col("html")).alias("body"))


@query
def pages_decoded(spark, sf_dir):
    pages = source(spark, sf_dir, "pages").selectExpr("page_id", f"{shapes.ENTITY_TEXT} AS html")
    return pages.select("page_id", text.decode_entities(F.col("html")).alias("body"))


@query
def documents_cleaned(spark, sf_dir):
    docs = source(spark, sf_dir, "documents").selectExpr("doc_id", f"{shapes.NOISY_DOCUMENT} AS raw")
    return docs.select("doc_id", text.clean_body(F.col("raw")).alias("body"))


@query
def cards_cleaned(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").selectExpr("message_id", "sender", f"{shapes.CARD_TEXT} AS raw")
    cards = m.filter(F.col("sender").contains(fixed.BOARD_A_SENDER))
    return cards.select("message_id", text.clean_card_body(F.col("raw")).alias("body"))


# --- identity ------------------------------------------------------------------------


@query
def sender_addresses(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return m.groupBy("sender").agg(F.count("*").alias("n")).withColumn(
        "address", identity.sender_address(F.col("sender"))
    )


@query
def document_addresses(spark, sf_dir):
    docs = source(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.sender_address(F.col("text")).alias("address"))


@query
def company_domains(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return m.groupBy("sender").agg(F.count("*").alias("n")).withColumn(
        "company_domain", identity.company_domain(F.col("sender"))
    )


@query
def shared_host_messages(spark, sf_dir):
    """Vocabulary lookups as broadcast semi and anti joins on the fixed host list."""
    hosts = spark.createDataFrame([(h,) for h in fixed.SHARED_HOSTS], "host STRING")
    # counted before they are read: a join on the host itself would push its patterns, unnamed, into the join below
    senders = derive(spark, sf_dir, "messages").groupBy("sender").agg(F.count("*").alias("n"))
    m = settle(
        senders.withColumn("host", F.split_part(identity.sender_address(F.col("sender")), F.lit("@"), F.lit(2)))
        .groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    shared = m.join(F.broadcast(hosts), "host", "left_semi")
    own = m.join(F.broadcast(hosts), "host", "left_anti")
    return shared.withColumn("shared", F.lit("yes")).unionByName(own.withColumn("shared", F.lit("no")))


@query
def companies_normalized(spark, sf_dir):
    m = derive(spark, sf_dir, "events").selectExpr(f"{shapes.LEGAL_NAME} AS raw")
    return m.groupBy("raw").agg(F.count("*").alias("n")).withColumn(
        "company", identity.normalize_company(F.col("raw"))
    )


@query
def requisitions_extracted(spark, sf_dir):
    m = derive(spark, sf_dir, "messages").selectExpr("message_id", "body", f"{shapes.REQ_SUBJECT} AS subject")
    return m.select(
        "message_id", requisition.extract_requisition(F.col("subject"), F.col("body")).alias("external_id")
    )


@query
def document_requisitions(spark, sf_dir):
    docs = source(spark, sf_dir, "documents")
    return docs.select("doc_id", requisition.extract_requisition(F.lit(""), F.col("text")).alias("external_id"))


@query
def requisitions_canonical(spark, sf_dir):
    raw = source(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{shapes.RAW_REQ} AS raw")
    return raw.select("o_orderkey", "raw", requisition.canonical_requisition(F.col("raw")).alias("external_id"))


@query
def roles_tidied(spark, sf_dir):
    raw = derive(spark, sf_dir, "events").filter("role IS NOT NULL").selectExpr("message_id", f"{shapes.RAW_ROLE} AS raw")
    return raw.select("message_id", "raw", roles.tidy_role(F.col("raw")).alias("role"))


@query
def roles_recovered(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return m.select("message_id", roles.recover_role(F.col("body"), F.col("subject")).alias("role"))


@query
def employer_sentences(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    found = m.select("message_id", templates.extract_company_role(F.col("subject"), F.col("body")).alias("e"))
    return found.select("message_id", F.col("e.company").alias("company"), F.col("e.role").alias("role"))


@query
def statuses_read(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return m.select("message_id", templates.general_status(F.col("body")).alias("status"))


@query
def message_signals(spark, sf_dir):
    m = derive(spark, sf_dir, "messages")
    return m.select(
        "message_id",
        templates.looks_confirmation(F.col("subject"), F.col("body")).cast("int").cast("bigint").alias("confirms"),
        templates.looks_update(F.col("subject")).cast("int").cast("bigint").alias("updates"),
    )


@query
def templates_extracted(spark, sf_dir):
    hits = classify.extract_templates(derive(spark, sf_dir, "messages"))
    return hits.select(
        "message_id", "noise_reason", F.col("hit.category").alias("category"), F.col("hit.company").alias("company"),
        F.col("hit.role").alias("role"), F.col("hit.code").alias("code"),
    )


# --- model path ----------------------------------------------------------------------


@query
def model_outputs_parsed(spark, sf_dir):
    parsed = classify.parse_model_outputs(derive(spark, sf_dir, "outputs"))
    return parsed.select(
        "message_id", F.col("model.category").alias("category"), F.col("model.company").alias("company"),
        F.col("model.role").alias("role"), F.col("model.req_id").alias("req_id"),
    )


@query
def model_needed(spark, sf_dir):
    hits = classify.extract_templates(derive(spark, sf_dir, "messages"))
    return classify.needs_model(hits).select("owner", "message_id")


EVENT_COLUMNS = (
    "owner", "message_id", "kind", "category", "company", "role", "external_id", "company_domain",
    "detected_by", "classifier_code",
)


def as_flag(name: str):
    return F.col(name).cast("int").cast("bigint").alias(name)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_messages(derive(spark, sf_dir, "messages"), derive(spark, sf_dir, "outputs"))


@query
def events_classified(spark, sf_dir):
    return classified(spark, sf_dir).select(*EVENT_COLUMNS, as_flag("is_confirmation"), as_flag("is_fast_apply"))


# --- relational matching -------------------------------------------------------------


def bridge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events")


MATCH_EVENTS = ("owner", "message_id", "company", "role", "external_id", "company_domain", "msg_date", "is_confirmation", "is_fast_apply")
MATCH_RECORDS = (
    "owner", "app_id", "company", "role", "external_id", "company_domain", "date_applied", "awaiting_application",
    "fast_apply", "confirmed",
)


def match_records(events: DataFrame) -> DataFrame:
    """Records of every thread with the fields that matching reads; the others never enter the rollup's shuffles."""
    records = rollup.rollup_applications(by_thread(events), events, None, AS_OF).select(*MATCH_RECORDS)
    return settle(records.withColumn("seq", F.regexp_replace("app_id", "^t", "").cast("bigint")), "match-records")


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and records to match, each written once: every lookup reads them several times."""
    events = settle(bridge_events(spark, sf_dir), "match-events")
    return events.select(*MATCH_EVENTS), match_records(events)


def held_out_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of one half of the mail, to be met by the other half: open slots and waiting records among them."""
    mail = settle(bridge_events(spark, sf_dir), "match-events")
    half = F.col("internal_ms") % 2 == 0
    return mail.filter(~half).select(*MATCH_EVENTS), match_records(mail.filter(half))


def pair_counts(events: DataFrame, records: DataFrame, pairs: DataFrame) -> DataFrame:
    return match.candidate_counts(events, records, pairs)


@query
def candidates_by_domain(spark, sf_dir):
    e, r = both_sides(spark, sf_dir)
    return pair_counts(e, r, match.pairs_by_domain(e, r))


@query
def candidates_by_first_word(spark, sf_dir):
    e, r = both_sides(spark, sf_dir)
    return pair_counts(e, r, match.pairs_by_first_word(e, r))


@query
def candidates_same_entity(spark, sf_dir):
    e, r = both_sides(spark, sf_dir)
    return pair_counts(e, r, match.pairs_same_entity(e, r))


@query
def candidates_gathered(spark, sf_dir):
    return match.gather_candidates(*both_sides(spark, sf_dir))


@query
def requisitions_matched(spark, sf_dir):
    return match.match_requisition(*both_sides(spark, sf_dir))


@query
def postings_matched(spark, sf_dir):
    out = match.match_posting(*both_sides(spark, sf_dir))
    return out.withColumn("is_exact", F.col("is_exact").cast("int").cast("bigint"))


@query
def unique_variants(spark, sf_dir):
    e, r = held_out_sides(spark, sf_dir)
    return match.exactly_one(e, r).select("owner", "message_id", "first_app_id")


@query
def nearest_paired(spark, sf_dir):
    return match.pair_nearest(*held_out_sides(spark, sf_dir))


@query
def latest_asof(spark, sf_dir):
    out = match.asof_latest(*both_sides(spark, sf_dir))
    return out.select("owner", "message_id", "app_id", day("date_applied"))


@query
def oldest_asof(spark, sf_dir):
    return match.asof_oldest(*both_sides(spark, sf_dir))


@query
def roleless_asof(spark, sf_dir):
    return match.asof_roleless(*both_sides(spark, sf_dir))


@query
def employer_components(spark, sf_dir):
    return blocks.employer_blocks(bridge_events(spark, sf_dir))


@query
def employer_block_sizes(spark, sf_dir):
    e = bridge_events(spark, sf_dir)
    out = blocks.with_blocks(e, blocks.employer_blocks(e), "message_id")
    return out.groupBy("owner", "block").agg(F.count("*").alias("n_rows"))


@query
def messages_assigned(spark, sf_dir):
    out = assign.assign(bridge_events(spark, sf_dir))
    return out.select("owner", "message_id", "app_id", as_flag("is_new"))


@query
def domain_bridges(spark, sf_dir):
    return assign.domain_bridges(assign.assign(bridge_events(spark, sf_dir)))


APPLICATION_COLUMNS = (
    "owner", "app_id", "company", "role", "status", "last_activity_ts", "notes", "external_id",
    "detected_by", "company_domain", "thread_id", "account", "first_ms",
)
FLAGS = ("reached_interview", "awaiting_application", "fast_apply", "confirmed")


def application_view(apps: DataFrame) -> DataFrame:
    return apps.select(*APPLICATION_COLUMNS, *[as_flag(f) for f in FLAGS], day("date_applied"), day("last_activity"))


@query
def applications_matched(spark, sf_dir):
    """The whole job: classified mail, fold and rollup."""
    return application_view(build_history(classified(spark, sf_dir), None, AS_OF).applications)


# --- rollup --------------------------------------------------------------------------


def by_thread(events: DataFrame) -> DataFrame:
    return events.select("owner", "message_id", F.col("thread_id").alias("app_id"))


def thread_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bridge_events(spark, sf_dir)
    return rollup.rollup_applications(by_thread(events), events, None, AS_OF)


def thread_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bridge_events(spark, sf_dir)
    return rollup.application_refs(by_thread(events), events)


@query
def applications_rolled_up(spark, sf_dir):
    return application_view(thread_applications(spark, sf_dir))


@query
def applications_merged(spark, sf_dir):
    """Early mail first, later mail merged into the stored records: equals one pass."""
    events = bridge_events(spark, sf_dir)
    cut = F.col("msg_date") < F.lit(dt.date(1998, 6, 1))
    early, late = events.filter(cut), events.filter(~cut)
    stored = rollup.rollup_applications(by_thread(early), early, None, AS_OF)
    merged = rollup.rollup_applications(by_thread(late), late, stored, AS_OF)
    untouched = stored.join(merged.select("app_id"), "app_id", "left_anti")
    return application_view(merged.unionByName(untouched))


def user_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{shapes.EVENT_STAGE} AS stage")


@query
def statuses_forward(spark, sf_dir):
    return user_stages(spark, sf_dir).groupBy("user_id").agg(
        rollup.forward_status(F.col("stage"), F.col("event_id")).alias("status")
    )


@query
def statuses_stepwise(spark, sf_dir):
    steps = rollup.step_statuses(user_stages(spark, sf_dir), ["user_id"], "stage", "event_id")
    return steps.groupBy("user_id").agg(F.max_by("status", "event_id").alias("status"))


@query
def refs_collected(spark, sf_dir):
    nested = rollup.collect_refs(thread_refs(spark, sf_dir))
    return nested.select("owner", "app_id", ref_functions.encode_refs(F.col("emails")).alias("emails"))


@query
def sync_counters(spark, sf_dir):
    events = settle(classified(spark, sf_dir), "classified")
    merges = events.filter("kind = 'merge'")
    first = merges.groupBy("owner", "thread_id").agg(F.min(F.struct("internal_ms", "message_id")).alias("f"))
    assigned = merges.join(first, ["owner", "thread_id"]).select(
        "message_id", (F.col("message_id") == F.col("f.message_id")).alias("is_new")
    )
    return rollup.sync_summary(events, assigned, 7, 3)


# --- reports -------------------------------------------------------------------------


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with the fields users edit filled in."""
    return shaped(spark, shapes.decorate("{apps}", "spark"), apps=thread_applications(spark, sf_dir))


@query
def stats_overall(spark, sf_dir):
    return reports.stats(decorated(spark, sf_dir))


@query
def stats_by_owner(spark, sf_dir):
    return reports.stats(decorated(spark, sf_dir), ["owner"])


@query
def stats_of_search(spark, sf_dir):
    found = select.search(decorated(spark, sf_dir), "(BACKEND)")
    return reports.stats(found)


@query
def status_counts(spark, sf_dir):
    return reports.count_by_status(decorated(spark, sf_dir))


@query
def board_columns(spark, sf_dir):
    out = reports.board(decorated(spark, sf_dir))
    return out.select("owner", "status", "app_id", F.col("rank").cast("bigint").alias("rank"), "n_status", "hidden")


@query
def applications_default_order(spark, sf_dir):
    out = reports.ranked(decorated(spark, sf_dir).select("owner", "app_id", "updated_at"), reports.default_order(), [])
    return out.select("owner", "app_id", "rank")


@query
def table_by_role_descending(spark, sf_dir):
    out = reports.table_sort(decorated(spark, sf_dir), "role", True)
    return out.select("owner", "app_id", "role", "rank")


@query
def table_by_company(spark, sf_dir):
    out = reports.table_sort(decorated(spark, sf_dir), "company", False, by=[])
    return out.select("app_id", "company", "rank")


@query
def table_page(spark, sf_dir):
    out = reports.page(reports.table_sort(decorated(spark, sf_dir), "last_activity", True), 1, 5)
    return out.select("owner", "app_id", "rank", "page", "n_total")


@query
def merge_order(spark, sf_dir):
    e = bridge_events(spark, sf_dir).select("owner", "message_id", "internal_ms")
    return reports.ranked(e, [F.col("internal_ms"), F.col("message_id")]).select("owner", "message_id", "rank")


@query
def applications_searched(spark, sf_dir):
    return select.search(decorated(spark, sf_dir), "kids").select("owner", "app_id", "company", "role")


@query
def applications_with_status(spark, sf_dir):
    apps = decorated(spark, sf_dir)
    hit = select.with_status(apps, "interview").select("app_id", F.lit("interview").alias("asked"))
    return hit.unionByName(select.with_status(apps, "archived").select("app_id", F.lit("archived").alias("asked")))


@query
def application_labels(spark, sf_dir):
    out = reports.with_labels(decorated(spark, sf_dir))
    return out.select(
        "app_id", "status_label", "step_label", F.array_join("badges", " + ").alias("badges"), as_flag("unknown_role")
    )


@query
def message_links(spark, sf_dir):
    links = reports.email_links(thread_refs(spark, sf_dir), decorated(spark, sf_dir))
    return links.select("owner", "app_id", "date", "position", "message_id", "label", "link")


@query
def changed_applications(spark, sf_dir):
    after = decorated(spark, sf_dir)
    before = shaped(spark, shapes.earlier("{apps}", "spark"), apps=after)
    return edits.changed_since(before, after)


@query
def refs_by_date(spark, sf_dir):
    nested = rollup.collect_refs(thread_refs(spark, sf_dir))
    reversed_refs = nested.withColumn("emails", F.reverse("emails"))
    return reversed_refs.select(
        "app_id", ref_functions.encode_refs(ref_functions.refs_chronological(F.col("emails"))).alias("emails")
    )


# --- creating, editing, importing ------------------------------------------------------


def raw_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unclean reference list per order, with blank, unknown and repeated entries."""
    return source(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{shapes.RAW_REFS} AS cell")


@query
def refs_decoded(spark, sf_dir):
    decoded = raw_refs(spark, sf_dir).withColumn("refs", ref_functions.decode_refs(F.col("cell")))
    return decoded.select("o_orderkey", "cell", ref_functions.encode_refs(F.col("refs")).alias("encoded"))


@query
def refs_sanitized(spark, sf_dir):
    loose = raw_refs(spark, sf_dir).withColumn(
        "refs",
        F.transform(
            F.split("cell", ";"),
            lambda e: F.struct(
                F.get(F.split(e, r"\|"), F.lit(1)).alias("message_id"),
                F.trim(F.get(F.split(e, r"\|"), F.lit(0))).alias("category"),
                F.get(F.split(e, r"\|"), F.lit(2)).alias("date"),
                (F.get(F.split(e, r"\|"), F.lit(3)) == "fast").alias("fast_apply"),
            ),
        ),
    )
    clean = ref_functions.sanitize_refs(F.col("refs"))
    return loose.select("o_orderkey", ref_functions.encode_refs(clean).alias("encoded"))


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, shapes.new_rows("{orders}", "spark"), orders=source(spark, sf_dir, "orders"))
    return rows.withColumn("emails", ref_functions.decode_refs(F.col("cell")))


@query
def applications_prepared(spark, sf_dir):
    accepted, _ = edits.prepare_new(new_rows(spark, sf_dir), AS_OF)
    return accepted.select(
        "app_id", "company", "role", "status", "interview_step", as_flag("reached_interview"), day("date_applied"),
        day("last_activity"), "last_activity_ts", "notes", "notes_source", "source", "account",
    )


@query
def applications_rejected(spark, sf_dir):
    _, rejects = edits.prepare_new(new_rows(spark, sf_dir), AS_OF)
    return rejects.select("app_id", "reason")


def edit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = shaped(spark, shapes.flat_edits("{orders}", "spark"), orders=source(spark, sf_dir, "orders"))
    entries = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("key"), F.col(f"e_{name}").alias("value"))
                for name in ("status", "interview_step", "notes", "role", "account", "last_activity")
            ]
        ),
        lambda e: F.coalesce(e["value"], F.lit("")) != shapes.ABSENT,
    )
    return flat.select(
        "owner", "app_id", F.map_from_entries(entries).alias("set_fields"),
        F.lit(None).cast(ref_functions.REFS_TYPE).alias("emails"),
    )


@query
def edits_applied(spark, sf_dir):
    apps, _ = edits.apply_edits(decorated(spark, sf_dir), edit_table(spark, sf_dir), AS_OF + dt.timedelta(days=1))
    return apps.select(
        "app_id", "status", "role", "interview_step", "notes", "notes_source", "account", "last_activity_ts",
        day("last_activity"), as_flag("reached_interview"), as_flag("edited"),
    )


@query
def edits_refused(spark, sf_dir):
    _, refused = edits.apply_edits(decorated(spark, sf_dir), edit_table(spark, sf_dir), AS_OF)
    return refused.select("app_id", "reason")


@query
def refs_edited(spark, sf_dir):
    """References replaced where an edit carries some, an empty list among them."""
    lists = source(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").selectExpr(
        "concat('u', o_custkey) AS owner", "concat('t', o_orderkey) AS app_id", "CAST(NULL AS MAP<STRING, STRING>) AS set_fields",
        f"{shapes.RAW_REFS} AS cell")
    asked = lists.withColumn("emails", ref_functions.decode_refs(F.col("cell"))).drop("cell")
    out = edits.apply_ref_edits(thread_refs(spark, sf_dir), asked, thread_applications(spark, sf_dir))
    return out.select("owner", "app_id", "position", "message_id", "category")


@query
def model_answers(spark, sf_dir):
    """A user's model called once for every message that needs one; its raw texts."""

    def measure(asked):
        return (f'{{"category": "applied", "seen": {len(subject)} {len(body)}}} {sender}' for sender, subject, body in asked)

    wanted = classify.needs_model(classify.extract_templates(derive(spark, sf_dir, "messages")))
    return classify.run_model(wanted, measure)


@query
def applications_deleted(spark, sf_dir):
    ids = source(spark, sf_dir, "orders").selectExpr(f"{shapes.DELETED_ID} AS app_id").filter("app_id IS NOT NULL")
    left, asked = select.drop_applications(decorated(spark, sf_dir), ids)
    kept = left.select("app_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(
        asked.select("app_id", F.when(F.col("found"), F.lit("deleted")).otherwise(F.lit("not found")).alias("outcome"))
    )


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = decorated(spark, sf_dir)
    return apps.join(rollup.collect_refs(thread_refs(spark, sf_dir)), ["owner", "app_id"], "left")


@query
def sheet_written(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    sheets.write_applications_csv(exported(spark, sf_dir), path)
    cells = spark.read.options(**sheets.FORMAT, header="true", multiLine="true").csv(path)
    return cells.select(
        *[F.coalesce(F.col(h), F.lit("")).alias(h.lower().replace(" ", "_")) for h in cells.columns]
    )


@query
def sheet_imported(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    sheets.write_applications_csv(exported(spark, sf_dir), path)
    rows = sheets.read_applications_csv(spark, path)
    return rows.select(
        "company", "role", "status", "interview_step", as_flag("reached_interview"), "date_applied", "last_activity",
        "job_url", "notes", "company_domain", "external_id", "account", "source",
        ref_functions.encode_refs(F.col("emails")).alias("emails"),
    )


def board_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, shapes.board_refs("{orders}"), orders=source(spark, sf_dir, "orders"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed sheet: one row per order, some without references, some repeating others."""
    rows = shaped(spark, shapes.sheet_rows("{orders}", "spark"), orders=source(spark, sf_dir, "orders"))
    return rows.withColumn("emails", ref_functions.decode_refs(F.col("cell")))


@query
def sheet_new_rows(spark, sf_dir):
    marked = edits.new_from_csv(sheet_rows(spark, sf_dir), decorated(spark, sf_dir), board_refs(spark, sf_dir))
    return marked.select("owner", "position", as_flag("is_new"))


@query
def import_summary(spark, sf_dir):
    marked = edits.new_from_csv(sheet_rows(spark, sf_dir), decorated(spark, sf_dir), board_refs(spark, sf_dir))
    return edits.import_summary(marked)


@query
def board_with_new_rows(spark, sf_dir):
    accepted, _ = edits.prepare_new(new_rows(spark, sf_dir), AS_OF)
    return decorated(spark, sf_dir).select("app_id", "company", "source").unionByName(
        accepted.select("app_id", "company", "source")
    )


# --- small scalar jobs -----------------------------------------------------------------


@query
def dates_coerced(spark, sf_dir):
    cells = source(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{shapes.date_cell('spark')} AS cell")
    return cells.select("o_orderkey", "cell", ref_functions.iso_date(F.col("cell")).alias("iso"))


@query
def durations_formatted(spark, sf_dir):
    spans = source(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{shapes.DURATION_MS} AS ms")
    return spans.select("o_orderkey", ref_functions.format_duration(F.col("ms")).alias("duration"))


@query
def message_ids_extracted(spark, sf_dir):
    pasted = source(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{shapes.PASTED_LINK} AS pasted")
    return pasted.select("o_orderkey", ref_functions.extract_message_id(F.col("pasted")).alias("message_id"))


# --- incremental -------------------------------------------------------------------------


ARRIVALS = 3
WINDOW_AS_OF = dt.datetime(2000, 6, 30)


def kept_board(make: Callable[[SparkSession, str], Board]) -> Callable[[SparkSession, str], Board]:
    """Boards that several queries look at are made once a session and table folder."""
    made: dict[tuple[str, str], Board] = {}

    def board(spark: SparkSession, sf_dir: str) -> Board:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = make(spark, sf_dir)
        return made[key]

    return board


def dumps_by_arrival(spark: SparkSession, sf_dir: str) -> str:
    """Dumps cut into three arrivals by receipt time; mail without one comes last."""
    root = scratch_path(spark, "synced")
    raw = raw_messages(spark, sf_dir)
    year = F.year(F.timestamp_millis(F.col("internal_date").cast("bigint")))
    arrival = F.when(year < 1997, 0).when(year < 1999, 1).otherwise(ARRIVALS - 1)
    raw.withColumn("arrival", arrival).write.partitionBy("arrival").json(f"{root}/in", compression="gzip")
    return root


def run_stream(board: Board, root: str, arrival: int, outputs: DataFrame):
    stream = message_source.stream_messages(board.spark, f"{root}/in/arrival={arrival}")
    query = incremental_sync(board, stream, f"{root}/cp{arrival}", lambda: AS_OF, lambda _: outputs)
    query.awaitTermination()
    return query


@kept_board
def synced_board(spark: SparkSession, sf_dir: str) -> Board:
    """Three arrivals streamed into an empty board; progress of the streams as ``board.seen``."""
    root = dumps_by_arrival(spark, sf_dir)
    board = Board(spark, f"{root}/board")
    outputs = settle(derive(spark, sf_dir, "outputs"), "outputs")  # every run reads them
    board.seen = [p for k in range(ARRIVALS) for p in progress(run_stream(board, root, k, outputs))]
    return board


@query
def ledger_after_sync(spark, sf_dir):
    return synced_board(spark, sf_dir).ledger().select("owner", "message_id", "thread_id")


@query
def applications_after_sync(spark, sf_dir):
    return application_view(synced_board(spark, sf_dir).applications())


@query
def blocks_after_sync(spark, sf_dir):
    """Labels merged run by run, of names and domains that are linked to others."""
    labels = synced_board(spark, sf_dir).blocks()
    linked = labels.groupBy("owner", "component").agg(F.count("*").alias("n")).filter("n > 1")
    return labels.join(linked, ["owner", "component"]).select("owner", "node", "component")


@query
def sync_totals(spark, sf_dir):
    """Per run: rows that arrived as the stream saw them, what the run did, and totals so far."""
    board = synced_board(spark, sf_dir)
    seen = spark.createDataFrame([(k, p["arrived"], p["unreadable"]) for k, p in enumerate(board.seen)],
                                 "version BIGINT, arrived BIGINT, unreadable BIGINT")
    totals = running_totals(board)
    return totals.join(seen, "version").select("version", "arrived", "unreadable", "processed", "added", "updated", "skipped", "failed",
                                               "total_processed", "total_added", "total_updated")


class CutBoard(Board):
    """A board whose next commit can end between writing its rows and making them visible."""

    cut = False

    def _publish(self, *args):
        if self.cut:
            self.cut = False
            raise InterruptedError("cut between the two writes")
        super()._publish(*args)


@query
def applications_after_replay(spark, sf_dir):
    """The second of three batches is cut short, replayed, and delivered once more after it was committed."""
    root = dumps_by_arrival(spark, sf_dir)
    outputs = settle(derive(spark, sf_dir, "outputs"), "outputs")  # every run reads them
    board = CutBoard(spark, f"{root}/board")
    for k in range(ARRIVALS):
        raw = message_source.read_messages(spark, f"{root}/in/arrival={k}")
        board.cut = k == 1
        for _ in range(3 if k == 1 else 1):
            try:
                sync_batch(board, raw, AS_OF, None, outputs, batch=f"arrival {k}", select=False)
            except InterruptedError:
                continue
    return application_view(board.applications())


@kept_board
def widened_board(spark: SparkSession, sf_dir: str) -> Board:
    """All mail lands at once; one run over 30 days, then one over 180 with no new mail."""
    path = scratch_path(spark, "dumps")
    raw_messages(spark, sf_dir).write.mode("overwrite").json(path, compression="gzip")
    board = Board(spark, scratch_path(spark, "widened"))
    outputs = settle(derive(spark, sf_dir, "outputs"), "outputs")  # every run reads them
    sync_batch(board, message_source.read_messages(spark, path), WINDOW_AS_OF, 30, outputs, batch="narrow")
    sync_landed(board, WINDOW_AS_OF, 180, outputs, batch="wide")
    return board


@query
def ledger_after_widening(spark, sf_dir):
    return widened_board(spark, sf_dir).ledger().select("owner", "message_id", "thread_id", F.col("classified_as"))


@query
def applications_after_widening(spark, sf_dir):
    return application_view(widened_board(spark, sf_dir).applications())


@query
def applications_rebuilt(spark, sf_dir):
    """The canonical result over the same window as the widened board."""
    board = widened_board(spark, sf_dir)
    return application_view(rebuilt(board, WINDOW_AS_OF, 180, derive(spark, sf_dir, "outputs")).applications)


@query
def unreadable_mail_retried(spark, sf_dir):
    """Broken lines and receipt times that are no numbers, then the same mail repaired; counters of both runs."""
    root = scratch_path(spark, "repaired")
    raw = raw_messages(spark, sf_dir).filter(F.col("internal_date").isNotNull())
    pick = F.pmod(F.length("id") + F.length("thread_id"), F.lit(5))
    damaged = raw.withColumn("internal_date", F.when(pick == 0, F.lit("yesterday")).otherwise(F.col("internal_date")))
    line = F.to_json(F.struct(*raw.columns))
    damaged.select(F.when(pick == 1, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(f"{root}/first", compression="gzip")
    raw.filter(pick < 2).write.json(f"{root}/second", compression="gzip")
    board = Board(spark, f"{root}/board")
    for name in ("first", "second"):
        sync_batch(board, message_source.read_messages(spark, f"{root}/{name}"), AS_OF, batch=name, select=False)
    held = Landing(spark, board.root).quarantine().agg(F.count("*").alias("quarantined"))
    in_ledger = board.ledger().agg(F.count("*").alias("in_ledger"))
    return board.counters().select("version", "processed", "failed").crossJoin(held).crossJoin(in_ledger)
