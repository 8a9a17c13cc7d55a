"""Deterministic classification templates.

A template is a function ``(Message) -> nullable struct Column`` with the fields of
``HIT``.  ``TEMPLATES`` is the ordered registry; users may pass their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.identity import title_key
from mailfold.functions.roles import clean_role, recover_role
from mailfold.functions.text import WHITE, blank_to_null, grab, jvm, let, matches, strip


@dataclass(frozen=True)
class Message:
    """The columns a template may read; ``prose`` is what the sentence patterns found."""

    subject: Column
    sender: Column
    address: Column
    body: Column
    prose: Column | None = None


Template = Callable[[Message], Column]

HIT = "struct<category:string,company:string,role:string,code:string>"


def hit(category: Column | str, company: Column, role: Column, code: str) -> Column:
    stage = F.lit(category) if isinstance(category, str) else category
    return F.struct(
        stage.alias("category"), company.alias("company"), role.alias("role"), F.lit(code).alias("code")
    )


# --- message signals ---------------------------------------------------------------


def looks_confirmation(subject: Column, body: Column) -> Column:
    text = F.concat(subject, F.lit("\n"), body)
    return let(
        text, lambda t: let(F.lower(t), lambda low: matches(t, fixed.CONFIRMATION_PHRASES, low))
    )


def looks_update(subject: Column) -> Column:
    return matches(subject, fixed.UPDATE_SUBJECT)


def is_fast_apply(code: Column) -> Column:
    return F.coalesce(code.isin(*fixed.FAST_CODES), F.lit(False))


def general_status(body: Column) -> Column:
    """rejected if an unconditional sentence says so, else applied, else null."""
    unconditional = F.exists(
        F.split(body, jvm(fixed.SENTENCE_BREAK)),
        lambda s: matches(s, fixed.REJECT_PHRASES) & ~matches(s, fixed.CONDITIONAL),
    )
    return let(
        F.lower(body),
        lambda low: F.when(matches(body, fixed.REJECT_PHRASES, low) & unconditional, F.lit("rejected")).when(
            matches(body, fixed.APPLIED_PHRASES, low), F.lit("applied")
        ),
    )


# --- employer sentences ------------------------------------------------------------


def clean_company(raw: Column) -> Column:
    """The leading proper-noun run of a capture, unless it is a number or too long."""
    low, high = fixed.COMPANY_LENGTH
    return let(
        strip(grab(strip(raw), fixed.COMPANY_RUN, 0)),
        lambda run: F.when(
            F.length(run).between(low, high)
            & ~matches(run, fixed.COMPANY_REQ_SHAPE)
            & ~matches(run, fixed.COMPANY_REQ_WORD),
            run,
        ),
    )


def _raw_capture(source: Column, pattern: str, company_group: int, role_group: int, low: Column) -> Column:
    """Both groups of the first match, or null; the text is scanned once."""
    return let(
        grab(source, pattern, 0, low),
        lambda m: F.when(
            m.isNotNull(),
            F.struct(
                F.regexp_extract(m, jvm(pattern), company_group).alias("company"),
                F.regexp_extract(m, jvm(pattern), role_group).alias("role"),
            ),
        ),
    )


def read_prose(subject: Column, body: Column) -> Column:
    """struct<company, role> from the sentence structures of acknowledgements.

    The first employer-and-title structure that matches is final, even if its employer
    fails cleaning; the employer-only structures are tried until one survives it.  An
    employer the body calls a position, or that equals the title, is dropped.  Without an
    employer, ``role`` is what the recovery patterns find, a last resort for callers.
    """

    def employer(text: Column) -> Column:
        lowered = F.struct(*[F.lower(t).alias(f) for f, t in (("text", text), ("subject", subject), ("body", body))])
        return let(lowered, lambda low: employer_of(text, low))

    def employer_of(text: Column, low: Column) -> Column:
        source = {"text": text, "subject": subject}
        both = F.coalesce(*[_raw_capture(source[f], p, c, r, low[f]) for f, p, c, r in fixed.EMPLOYER_AND_TITLE])
        only = F.coalesce(*[clean_company(grab(text, p, low=low["text"])) for p in fixed.EMPLOYER_ONLY])
        excluded = matches(text, fixed.NOT_APPLICATION, low["text"]) | matches(
            body, fixed.DRAFT_REMINDER, low["body"]
        )
        return F.when(
            ~excluded,
            let(
                both,
                lambda b: F.when(
                    b.isNotNull(),
                    F.struct(clean_company(b["company"]).alias("company"), b["role"].alias("role")),
                ).otherwise(F.struct(only.alias("company"), F.lit(None).cast("string").alias("role"))),
            ),
        )

    def called_title(company: Column) -> Column:
        pattern = F.concat(
            F.lit(r"(?i)(?<![0-9A-Za-z_])\Q"), company, F.lit(r"\E" + jvm(fixed.TITLE_NOUNS))
        )
        # the pattern is made anew for every employer: only where white space follows the name
        spaced = let(
            F.lower(body),
            lambda text: text.contains(F.concat(F.lower(company), F.lit(" ")))
            | (text.contains(F.lower(company)) & text.rlike(f"[{WHITE}&&[^ ]]")),
        )
        return spaced & F.rlike(body, pattern)

    def pair(company: Column, role: Column) -> Column:
        return F.struct(company.alias("company"), role.alias("role"))

    def judge(found: Column) -> Column:
        company = found["company"]

        def with_title(title: Column) -> Column:
            differs = title_key(company) != title_key(title)
            return F.when(company.isNotNull() & title.isNotNull() & differs, pair(company, title)).otherwise(
                let(
                    recover_role(body, subject),
                    lambda r: F.when(
                        company.isNotNull()
                        & title.isNull()
                        & (r.isNull() | (title_key(company) != title_key(r))),
                        pair(company, r),
                    ).otherwise(pair(F.lit(None).cast("string"), r)),
                )
            )

        return let(clean_role(found["role"]), with_title)

    def without_titles(found: Column) -> Column:
        company = found["company"]
        return F.struct(
            F.when(company.isNotNull() & ~called_title(company), company).alias("company"),
            found["role"].alias("role"),
        )

    text = F.concat(subject, F.lit("\n"), body)
    return let(let(let(text, employer), without_titles), judge)


def extract_company_role(subject: Column, body: Column) -> Column:
    """struct<company, role>, or null without an employer."""
    return let(read_prose(subject, body), lambda p: F.when(p["company"].isNotNull(), p))


# --- templates ---------------------------------------------------------------------


def board_a_applied(m: Message) -> Column:
    lines = F.filter(F.transform(F.split(m.body, "\n"), strip), lambda l: l != "")

    def read_card(card: Column) -> Column:
        heading = F.array_position(
            F.transform(card, lambda l: matches(l, fixed.BOARD_A_HEADING)), F.lit(True)
        ).cast("int")

        def read_below(heading: Column) -> Column:
            role, company = F.get(card, heading), F.get(card, heading + 1)
            intact = (
                (heading > 0)
                & role.isNotNull()
                & company.isNotNull()
                & ~matches(role, fixed.BOARD_A_MARKER)
                & ~matches(company, fixed.BOARD_A_MARKER)
            )
            return F.when(intact, hit("applied", company, role, fixed.CODE_A_APPLIED))

        return let(heading, read_below)

    return F.when(
        m.address.endswith(fixed.BOARD_A_SENDER) & matches(m.subject, fixed.BOARD_A_SUBJECT),
        let(lines, read_card),
    )


def board_a_rejected(m: Message) -> Column:
    rest = F.regexp_replace(m.subject, fixed.BOARD_A_REJECT_SUBJECT, "")
    split_last = r"(?s)^(.*) at (.*)\z"
    return F.when(
        m.address.endswith(fixed.BOARD_A_SENDER)
        & matches(m.subject, fixed.BOARD_A_REJECT_SUBJECT)
        & matches(m.body, fixed.BOARD_A_REJECT_BODY)
        & rest.contains(" at "),
        hit(
            "rejected",
            strip(F.regexp_extract(rest, split_last, 2)),
            strip(F.regexp_extract(rest, split_last, 1)),
            fixed.CODE_A_REJECTED,
        ),
    )


def board_b_applied(m: Message) -> Column:
    role = strip(grab(m.subject, fixed.BOARD_B_SUBJECT))
    company = blank_to_null(strip(grab(m.body, fixed.BOARD_B_EMPLOYER)))
    return F.when(
        m.address.contains(fixed.BOARD_B_SENDER) & role.isNotNull() & company.isNotNull(),
        hit("applied", company, role, fixed.CODE_B_APPLIED),
    )


def general_template(m: Message) -> Column:
    """Fires only when the prose names an employer and the status is clear-cut."""
    company = m.prose["company"]
    return F.when(
        company.isNotNull(),
        let(
            general_status(m.body),
            lambda status: F.when(
                status.isNotNull(), hit(status, company, m.prose["role"], fixed.CODE_GENERAL)
            ),
        ),
    )


# Rigid formats first; prose templates see only what those leave open.
RIGID: tuple[Template, ...] = (board_a_applied, board_a_rejected, board_b_applied)
PROSE: tuple[Template, ...] = (general_template,)


def first_hit(message: Message, templates: Sequence[Template]) -> Column:
    """The first template that fires, as a ``HIT`` struct, or null."""
    return F.coalesce(*[t(message).cast(HIT) for t in templates])
