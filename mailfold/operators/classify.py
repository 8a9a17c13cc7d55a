"""Messages to classified events."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold import fixed, schemas
from mailfold.functions.identity import company_domain, normalize_company, sender_address
from mailfold.functions.requisition import canonical_requisition, extract_requisition
from mailfold.functions.roles import tidy_role
from mailfold.functions.templates import (
    PROSE,
    RIGID,
    Message,
    Template,
    first_hit,
    is_fast_apply,
    looks_confirmation,
    looks_update,
    read_prose,
)
from mailfold.functions.text import blank_to_null, let, matches
from mailfold.operators.select import mark_noise
from mailfold.session import settle


def extract_templates(
    messages: DataFrame, rigid: Sequence[Template] = RIGID, prose: Sequence[Template] = PROSE
) -> DataFrame:
    """Adds ``noise_reason``, ``prose`` and ``hit``: the first template that fires, or null.

    Noise is not extracted, and the sentence patterns run only where no rigid format
    fired.  Each stage is a column of its own, so nothing is computed twice.
    """
    text = tuple(F.col(c) for c in ("subject", "sender", "address", "body"))
    wanted = F.col("noise_reason").isNull()
    return (
        mark_noise(messages)
        .withColumn("address", sender_address(F.col("sender")))
        .withColumn("rigid", F.when(wanted, first_hit(Message(*text), rigid)))
        .withColumn("prose", F.when(wanted & F.col("rigid").isNull(), read_prose(text[0], text[3])))
        .withColumn(
            "hit",
            F.coalesce("rigid", F.when(wanted, first_hit(Message(*text, F.col("prose")), prose))),
        )
        .drop("rigid", "address")
    )


def read_signals(extracted: DataFrame) -> DataFrame:
    """Everything else that needs the text, after which subject and ids are all that remain.

    Runs before the model join, so that bodies never cross a shuffle.
    """
    subject, sender, body = F.col("subject"), F.col("sender"), F.col("body")
    wanted = F.col("noise_reason").isNull()
    return extracted.select(
        "owner",
        "account",
        "message_id",
        "thread_id",
        "subject",
        "internal_ms",
        "msg_date",
        "noise_reason",
        "hit",
        "prose",
        F.when(wanted, extract_requisition(subject, body)).alias("text_req"),
        F.when(wanted, company_domain(sender)).alias("sender_domain"),
        F.when(wanted, looks_confirmation(subject, body)).alias("confirms"),
        matches(sender, fixed.ASSESSMENT_HOST).alias("assessment_sender"),
    )


def _wants_model() -> Column:
    hit = F.col("hit")
    no_title = (hit["category"] != "ignored") & blank_to_null(hit["role"]).isNull()
    return F.col("noise_reason").isNull() & (hit.isNull() | no_title)


def needs_model(extracted: DataFrame) -> DataFrame:
    """The messages to send to batch inference.

    Extraction is written first: a filter on ``hit`` would otherwise be pushed through the
    staged columns and repeat their expressions many times over.
    """
    marked = settle(extracted.withColumn("wanted", _wants_model()), "extracted")
    return marked.filter("wanted").drop("wanted")


def run_model(messages: DataFrame, model: Callable[[Iterable[tuple[str, str, str]]], Iterable[str]]) -> DataFrame:
    """Call a user model on (sender, subject, body) batches; one raw text per message."""

    def call(batches: Iterator) -> Iterator:
        for batch in batches:
            answers = model(zip(batch["sender"], batch["subject"], batch["body"], strict=True))
            yield batch[["owner", "message_id"]].assign(raw_text=list(answers))

    return messages.select("owner", "message_id", "sender", "subject", "body").mapInPandas(
        call, schema=schemas.MODEL_OUTPUTS
    )


def parse_model_outputs(raw: DataFrame) -> DataFrame:
    """``model``: struct<category, company, role, req_id>, null when the answer is malformed.

    The object runs from the first brace to the last, so code fences and remarks around
    it do not matter.  Employer and title count only as strings, the number may be either.
    """

    def text_field(v: Column, name: str) -> Column:
        return F.when(
            F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant")) == "STRING",
            F.try_variant_get(v, f"$.{name}", "string"),
        )

    def req_field(v: Column) -> Column:
        kind = F.schema_of_variant(F.variant_get(v, "$.req_id", "variant"))
        scalar = (kind == "STRING") | (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        return F.when(scalar, F.try_variant_get(v, "$.req_id", "string"))

    def read(v: Column) -> Column:
        category = text_field(v, "category")
        return F.when(
            category.isin(*fixed.CATEGORIES),
            F.struct(
                category.alias("category"),
                text_field(v, "company").alias("company"),
                text_field(v, "role").alias("role"),
                canonical_requisition(req_field(v)).alias("req_id"),
            ),
        )

    keys = answer_keys(raw)
    one_each = raw.groupBy(*keys).agg(F.min("raw_text").alias("raw_text"))
    parsed = F.try_parse_json(blank_to_null(F.regexp_extract("raw_text", r"(?s)\{.*\}", 0)))
    return one_each.select(*keys, parsed.alias("v")).select(*keys, read(F.col("v")).alias("model"))


def answer_keys(raw: DataFrame) -> list[str]:
    """Message ids are unique within a mailbox: answers of several owners carry the owner."""
    return [c for c in ("owner", "message_id") if c in raw.columns]


def join_model(extracted: DataFrame, outputs: DataFrame | None) -> DataFrame:
    """Attach parsed answers; without a table every unresolved message stays unresolved."""
    empty = F.lit(None).cast("struct<category:string,company:string,role:string,req_id:string>")
    if outputs is None:
        return extracted.withColumn("model", empty)
    return extracted.join(parse_model_outputs(outputs), answer_keys(outputs), "left")


def resolve_classification(joined: DataFrame) -> DataFrame:
    """Combine ``hit``, ``model`` and ``prose`` into one ``answer``.

    A template is authoritative for employer and stage; the model only fills its missing
    title and number.  Without a template the model is the truth and prose patterns fill
    its gaps.  Neither: ignored.
    """
    hit, model, prose = F.col("hit"), F.col("model"), F.col("prose")
    asked = blank_to_null(hit["role"]).isNull()
    used = model["category"] != "ignored"

    def answer(category: Column, company: Column, role: Column, req_id: Column) -> Column:
        return F.struct(
            category.alias("category"), company.alias("company"), role.alias("role"), req_id.alias("req_id")
        )

    from_hit = answer(
        hit["category"],
        hit["company"],
        F.when(asked, blank_to_null(model["role"])).otherwise(hit["role"]),
        F.when(asked, model["req_id"]),
    )
    from_model = answer(
        model["category"],
        F.coalesce(blank_to_null(model["company"]), F.when(used, prose["company"])),
        F.coalesce(blank_to_null(model["role"]), F.when(used, prose["role"])),
        model["req_id"],
    )
    return joined.withColumns(
        {
            "answer": F.when(hit.isNotNull(), from_hit).when(
                F.col("noise_reason").isNull() & model.isNotNull(), from_model
            ),
            "detected_by": F.when(hit.isNotNull(), F.lit("parser")).otherwise(F.lit("llm")),
            "classifier_code": hit["code"],
        }
    ).drop("hit", "model", "prose")


def finalise_events(resolved: DataFrame) -> DataFrame:
    """Normalised fields, the merge/skip decision and the message signals."""
    answer = F.col("answer")

    def employer(name: Column) -> Column:
        assessment = matches(name, fixed.ASSESSMENT_NAME) & F.col("assessment_sender")
        return F.when((name != "") & ~assessment, name)

    staged = resolved.withColumns(
        {
            "category": F.coalesce(answer["category"], F.lit("ignored")),
            "company": let(normalize_company(answer["company"]), employer),
            "role": blank_to_null(tidy_role(answer["role"])),
            "model_req": answer["req_id"],
        }
    ).withColumn("merge", (F.col("category") != "ignored") & F.col("company").isNotNull())
    confirmation = (F.col("category") == "applied") & (F.col("confirms") | ~looks_update(F.col("subject")))

    def kept(value: Column | str, name: str) -> Column:
        return F.when(F.col("merge"), F.col(value) if isinstance(value, str) else value).alias(name)

    return staged.select(
        "owner",
        "account",
        "message_id",
        "thread_id",
        "subject",
        F.when(F.col("merge"), F.lit("merge")).otherwise(F.lit("skip")).alias("kind"),
        F.when(F.col("merge"), F.col("category")).otherwise(F.lit("ignored")).alias("category"),
        kept("company", "company"),
        kept("role", "role"),
        kept(F.coalesce("text_req", "model_req"), "external_id"),
        kept("sender_domain", "company_domain"),
        F.coalesce(F.col("merge") & confirmation, F.lit(False)).alias("is_confirmation"),
        (F.col("merge") & is_fast_apply(F.col("classifier_code"))).alias("is_fast_apply"),
        kept("detected_by", "detected_by"),
        "classifier_code",
        "internal_ms",
        "msg_date",
    )


def classify_messages(
    messages: DataFrame,
    outputs: DataFrame | None = None,
    rigid: Sequence[Template] = RIGID,
    prose: Sequence[Template] = PROSE,
) -> DataFrame:
    """Every message as one event row, noise and unresolved mail as skips."""
    signals = read_signals(extract_templates(messages, rigid, prose))
    return finalise_events(resolve_classification(join_model(signals, outputs)))
