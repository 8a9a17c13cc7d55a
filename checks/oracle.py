"""The registered queries as SQL for the checking engine.

Written from the rules rather than from the Spark plans: naive joins and ordered
aggregates where Spark uses lookups, consuming groups where it uses lookahead.
"""

from __future__ import annotations

from itertools import count

from checks import shapes
from mailfold import fixed
from mailfold.functions.identity import SHARED_BRANDS
from mailfold.sources.bridge import derived_sql

_names = count()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Trailing lookahead becomes a consuming group; captures do not change."""
    return pattern.replace("(?=", "(?:")


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(re2(pattern))})"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(re2(pattern))}, {group}), '')"


def sub(x: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def squash(x: str) -> str:
    return strip(sub(x, r"\s+", " "))


def let(x: str, body) -> str:
    name = f"v{next(_names)}"
    return f"list_transform([{x}], lambda {name}: {body(name)})[1]"


def items(values) -> str:
    return ", ".join(q(v) for v in values)


def digits(x: str) -> str:
    return f"length({sub(x, '[^0-9]')})"


MESSAGES = f"messages AS ({derived_sql('messages')})"
OUTPUTS = f"outputs AS ({derived_sql('outputs')})"
EVENTS = f"mail AS ({derived_sql('events')})"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


# --- text ------------------------------------------------------------------------------


def strip_html(x: str) -> str:
    return squash(sub(sub(sub(x, fixed.STYLE_BLOCK), fixed.SCRIPT_BLOCK), fixed.ANY_TAG, " "))


def decode(x: str) -> str:
    for pattern, replacement in fixed.ENTITIES:
        x = sub(x, pattern, replacement)
    return sub(x, fixed.INVISIBLE)


def markup_free(x: str) -> str:
    return f"CASE WHEN {has(x, fixed.MARKUP_SEEN)} THEN {strip_html(x)} ELSE {x} END"


def clean_body(x: str) -> str:
    def rest(text: str) -> str:
        out = decode(text)
        out = sub(sub(out, fixed.ARTIFACT_TEMPLATE), fixed.ARTIFACT_NUMBER)
        out = sub(sub(out, fixed.LINK_MARKER), fixed.URL)
        out = sub(out, fixed.DIVIDER, " ")
        for notice in fixed.REPLY_NOTICES:
            out = sub(out, notice, " ")
        footer = fixed.FOOTER.removeprefix("(?i)")
        return let(
            out,
            lambda t: squash(
                f"CASE WHEN {has(t, '(?i)^(?:' + footer + ')')} THEN {t} ELSE "
                + sub(t, r"(?i)^([\s\S]+?)(?:" + footer + r")[\s\S]*$", r"\1") + " END"
            ),
        )

    return let(markup_free(x), rest)


def clean_card(x: str) -> str:
    def rest(text: str) -> str:
        out = sub(decode(text), r"(?i)(?:Now, take these next steps|View similar jobs you may)[\s\S]*$")
        out = sub(sub(out, fixed.URL), fixed.DIVIDER, " ")
        lines = f"list_transform(string_split({out}, chr(10)), lambda l: {strip(sub('l', '[ ' + chr(9) + ']+', ' '))})"
        return f"array_to_string(list_filter({lines}, lambda l: l <> '' AND NOT {has('l', fixed.CARD_LINK_LINE)}), chr(10))"

    return let(markup_free(x), rest)


def select_body(plain: str, html: str) -> str:
    return (
        f"CASE WHEN {plain} <> '' AND NOT {has(plain, fixed.TEMPLATE_MARKERS)} THEN {plain} "
        f"WHEN {html} <> '' THEN {strip_html(html)} ELSE {plain} END"
    )


# --- identity --------------------------------------------------------------------------


def address(x: str) -> str:
    return f"lower(coalesce({ext(x, '<([^>]+)>')}, {ext(x, r'[^[:space:]]+@[^[:space:]]+', 0)}, ''))"


def domain(x: str) -> str:
    def from_host(host: str) -> str:
        two = f"array_to_string(string_split({host}, '.')[-2:], '.')"
        three = f"array_to_string(string_split({host}, '.')[-3:], '.')"
        registrable = (
            f"CASE WHEN len(string_split({host}, '.')) >= 3 AND {has(two, fixed.SECOND_LEVEL_TLD)} "
            f"THEN {three} ELSE {two} END"
        )
        own = let(
            registrable,
            lambda r: f"CASE WHEN {r} NOT IN ({items(fixed.SHARED_HOSTS)}) AND split_part({r}, '.', 1) NOT IN "
            f"({items(SHARED_BRANDS)}) THEN {r} END",
        )
        return f"CASE WHEN {host} NOT IN ({items(fixed.SHARED_HOSTS)}) THEN {own} END"

    return let(f"nullif(split_part({address(x)}, '@', 2), '')", from_host)


def company(x: str) -> str:
    out = strip(sub(x, fixed.TRADE_NAME_PREFIX))
    out = strip(sub(out, fixed.PAGE_QUALIFIER))
    return strip(sub(out, fixed.LEGAL_SUFFIX.replace(r"(?<=\w)", r"(\w)"), r"\1"))


def words(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex(lower({x}), '\\s+'), "
        f"lambda w: {sub('w', '[^a-z0-9]')}), lambda w: w <> '')"
    )


def same_entity(a: str, b: str) -> str:
    """``a`` and ``b`` are word-list columns."""
    short = f"CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END"
    long = f"CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END"
    return (
        f"(len({short}) > 0 AND ({long})[1:len({short})] = ({short}) AND len(list_filter(({long})[len({short}) + 1:], "
        f"lambda w: w NOT IN ({items(fixed.DESCRIPTORS)}))) = 0)"
    )


def key(x: str) -> str:
    return sub(f"lower(coalesce({x}, ''))", "[^a-z0-9]")


# --- requisitions and titles -------------------------------------------------------------


def long_enough(x: str) -> str:
    return let(x, lambda t: f"CASE WHEN {digits(t)} >= 5 THEN {t} END")


def requisition(subject: str, body: str) -> str:
    text = f"({subject} || chr(10) || {body})"
    return (
        f"coalesce({long_enough(ext(text, fixed.REQ_LABELLED))}, {long_enough(ext(text, fixed.REQ_ID_LABEL))}, "
        f"{ext(text, fixed.REQ_MIXED)}, {long_enough(ext(subject, fixed.REQ_DASHED))})"
    )


def canonical_requisition(x: str) -> str:
    bare = sub(strip(x), r"^#\s*")
    label = fixed.REQ_LABEL_PREFIX.replace("(?=[0-9A-Za-z])", "([0-9A-Za-z])")
    return let(
        strip(sub(bare, label, r"\1")),
        lambda t: f"CASE WHEN {has(t, fixed.REQ_VALID)} AND {digits(t)} >= 5 THEN {t} END",
    )


LEAD = r"^#?[A-Za-z]{0,4}[-_]?[0-9][0-9A-Za-z-]*\s+"


def tidy(x: str) -> str:
    def without_lead(s: str) -> str:
        lead = f"regexp_extract({s}, {q(LEAD)}, 0)"
        return f"CASE WHEN {digits(lead)} >= 5 THEN {strip(f'substr({s}, length({lead}) + 1)')} ELSE {s} END"

    out = let(strip(x), without_lead)
    for pattern, replacement in (*fixed.ROLE_ID_STRIPS, *fixed.ROLE_TAIL_STRIPS):
        out = strip(sub(out, pattern, replacement))
    return out


def clean_role(x: str) -> str:
    def accept(t: str) -> str:
        return (
            f"CASE WHEN length({t}) BETWEEN 2 AND 80 AND NOT {has(t, fixed.ROLE_OVERRUN)} AND NOT "
            f"{has(t, fixed.ROLE_PROSE)} AND NOT {has(t, fixed.ROLE_COUNTRY)} THEN {t} END"
        )

    bare = strip(sub(strip(sub(x, fixed.ROLE_ARTICLE)), fixed.ROLE_POSSESSIVE))
    return let(bare, lambda a: f"CASE WHEN {has(a, fixed.ROLE_START)} THEN {let(tidy(a), accept)} END")


def recover(body: str, subject: str) -> str:
    source = {"body": body, "subject": subject}
    return "coalesce(" + ", ".join(clean_role(ext(source[f], p)) for f, p in fixed.ROLE_RECOVERY) + ")"


def clean_company(x: str) -> str:
    return let(
        strip(ext(strip(x), fixed.COMPANY_RUN, 0)),
        lambda c: f"CASE WHEN length({c}) BETWEEN 2 AND 50 AND NOT {has(c, fixed.COMPANY_REQ_SHAPE)} "
        f"AND NOT {has(c, fixed.COMPANY_REQ_WORD)} THEN {c} END",
    )


def prose_ctes(source: str) -> str:
    """CTEs ending in ``prose``: message_id, p_company, p_role and the fallback p_recovered."""
    fields = {"text": "text", "subject": "subject"}
    raw_company = "CASE " + " ".join(
        f"WHEN {has(fields[f], p)} THEN {ext(fields[f], p, c)}" for f, p, c, _ in fixed.EMPLOYER_AND_TITLE
    ) + " END"
    raw_role = "CASE " + " ".join(
        f"WHEN {has(fields[f], p)} THEN {ext(fields[f], p, r)}" for f, p, _, r in fixed.EMPLOYER_AND_TITLE
    ) + " END"
    both = " OR ".join(has(fields[f], p) for f, p, _, _ in fixed.EMPLOYER_AND_TITLE)
    only = "coalesce(" + ", ".join(clean_company(ext("text", p)) for p in fixed.EMPLOYER_ONLY) + ")"
    return f"""
p1 AS MATERIALIZED (SELECT *, subject || chr(10) || body AS text FROM {source}),
p2 AS MATERIALIZED (SELECT *, {both} AS both_found, {raw_company} AS raw_company, {raw_role} AS raw_role FROM p1),
p3 AS MATERIALIZED (SELECT *, CASE WHEN {has('text', fixed.NOT_APPLICATION)} OR {has('body', fixed.DRAFT_REMINDER)} THEN NULL
         WHEN both_found THEN {clean_company('raw_company')} ELSE {only} END AS c0 FROM p2),
p4 AS MATERIALIZED (SELECT *, {recover('body', 'subject')} AS recovered, {clean_role('raw_role')} AS titled,
         CASE WHEN c0 IS NOT NULL AND NOT regexp_matches(body, '(?i)\\b' || regexp_escape(c0) || {q(fixed.TITLE_NOUNS)})
              THEN c0 END AS c1 FROM p3),
prose AS MATERIALIZED (SELECT message_id, recovered AS p_recovered,
            CASE WHEN c1 IS NOT NULL AND ({key('coalesce(titled, recovered)')} <> {key('c1')}) THEN c1 END AS p_company,
            CASE WHEN c1 IS NOT NULL AND ({key('coalesce(titled, recovered)')} <> {key('c1')})
                 THEN coalesce(titled, recovered) END AS p_role FROM p4)"""


def status(body: str) -> str:
    sentences = f"string_split(regexp_replace({body}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    rejected = f"len(list_filter({sentences}, lambda s: {has('s', fixed.REJECT_PHRASES)} AND NOT {has('s', fixed.CONDITIONAL)})) > 0"
    return f"CASE WHEN {rejected} THEN 'rejected' WHEN {has(body, fixed.APPLIED_PHRASES)} THEN 'applied' END"


def noise(subject: str, sender: str, body: str) -> str:
    plain = "(?i)" + "|".join(p for p in fixed.NOISE_SUBJECTS if "(?!" not in p)
    form = "jacobs - application update"
    guarded = f"({has(subject, '(?i)' + form + '(?:[^,]|$)')})"
    return (
        f"CASE WHEN {has(subject, plain)} OR {guarded} THEN 'subject' WHEN {has(sender, fixed.NOISE_SENDER)} "
        f"THEN 'sender' WHEN {has(body, fixed.NOISE_BODY)} THEN 'body' END"
    )


def confirms(subject: str, body: str) -> str:
    return has(f"({subject} || chr(10) || {body})", fixed.CONFIRMATION_PHRASES)


def hit_ctes() -> str:
    """CTEs ending in ``hits``: category, company, role and code of the first template."""
    lines = f"list_filter(list_transform(string_split(body, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    at = f"list_position(list_transform(lines, lambda l: {has('l', fixed.BOARD_A_HEADING)}), true)"
    board_a = f"(addr LIKE '%{fixed.BOARD_A_SENDER}')"
    return f"""
{prose_ctes('messages')},
h1 AS MATERIALIZED (SELECT m.*, p_company, p_role, p_recovered, {noise('subject', 'sender', 'body')} AS noise_reason,
         {address('sender')} AS addr, {lines} AS lines, {status('body')} AS read_status
       FROM messages m JOIN prose USING (message_id)),
h2 AS MATERIALIZED (SELECT *, {at} AS heading, lower(subject) LIKE 'your application to %' AND
         {has('body', fixed.BOARD_A_REJECT_BODY)} AND substr(subject, 21) LIKE '% at %' AS rejects FROM h1),
h3 AS MATERIALIZED (SELECT *, {board_a} AND {has('subject', fixed.BOARD_A_SUBJECT)} AND heading > 0 AND len(lines) >= heading + 2
         AND NOT {has('lines[heading + 1]', fixed.BOARD_A_MARKER)} AND NOT {has('lines[heading + 2]', fixed.BOARD_A_MARKER)}
         AS a_card, {board_a} AND rejects AS a_reject,
         addr LIKE '%{fixed.BOARD_B_SENDER}%' AND {has('subject', fixed.BOARD_B_SUBJECT)}
         AND {strip(ext('body', fixed.BOARD_B_EMPLOYER))} IS NOT NULL AS b_card FROM h2),
h4 AS MATERIALIZED (SELECT *, CASE WHEN noise_reason IS NOT NULL THEN 'none' WHEN a_card THEN 'linkedin_applied'
         WHEN a_reject THEN 'linkedin_rejected' WHEN b_card THEN 'indeed_applied'
         WHEN p_company IS NOT NULL AND read_status IS NOT NULL THEN 'general_template' ELSE 'none' END AS rule FROM h3),
hits AS MATERIALIZED (SELECT *, nullif(rule, 'none') AS code,
         CASE rule WHEN 'linkedin_applied' THEN 'applied' WHEN 'linkedin_rejected' THEN 'rejected'
              WHEN 'indeed_applied' THEN 'applied' WHEN 'general_template' THEN read_status END AS h_category,
         CASE rule WHEN 'linkedin_applied' THEN lines[heading + 2]
              WHEN 'linkedin_rejected' THEN {strip("regexp_extract(substr(subject, 21), '^(.*) at (.*)$', 2)")}
              WHEN 'indeed_applied' THEN {strip(ext('body', fixed.BOARD_B_EMPLOYER))}
              WHEN 'general_template' THEN p_company END AS h_company,
         CASE rule WHEN 'linkedin_applied' THEN lines[heading + 1]
              WHEN 'linkedin_rejected' THEN {strip("regexp_extract(substr(subject, 21), '^(.*) at (.*)$', 1)")}
              WHEN 'indeed_applied' THEN {strip(ext('subject', fixed.BOARD_B_SUBJECT))}
              WHEN 'general_template' THEN p_role END AS h_role FROM h4)"""


def model_ctes() -> str:
    def text_field(name: str) -> str:
        return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN json_extract_string(j, '$.{name}') END"

    req = "CASE WHEN json_type(j, '$.req_id') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(j, '$.req_id') END"
    return f"""
o1 AS MATERIALIZED (SELECT message_id, nullif(regexp_extract(raw_text, '\\{{[\\s\\S]*\\}}', 0), '') AS j FROM outputs),
o2 AS MATERIALIZED (SELECT message_id, CASE WHEN json_valid(j) THEN j END AS j FROM o1),
o3 AS MATERIALIZED (SELECT message_id, {text_field('category')} AS category, {text_field('company')} AS company,
         {text_field('role')} AS role, {canonical_requisition(req)} AS req_id FROM o2),
parsed AS MATERIALIZED (SELECT message_id, CASE WHEN ok THEN category END AS category, CASE WHEN ok THEN company END AS company,
             CASE WHEN ok THEN role END AS role, CASE WHEN ok THEN req_id END AS req_id
           FROM (SELECT *, coalesce(category IN ({items(fixed.CATEGORIES)}), false) AS ok FROM o3) o4)"""


def event_ctes() -> str:
    """CTEs ending in ``classified``, the event table."""
    asked = "nullif(h_role, '') IS NULL"
    return f"""
{hit_ctes()}, {model_ctes()},
c1 AS MATERIALIZED (SELECT h.*, p.category AS m_category, nullif(p.company, '') AS m_company, nullif(p.role, '') AS m_role,
         p.req_id AS m_req FROM hits h LEFT JOIN parsed p USING (message_id)),
c2 AS MATERIALIZED (SELECT *,
   CASE WHEN code IS NOT NULL THEN h_category WHEN noise_reason IS NULL THEN m_category END AS a_category,
   CASE WHEN code IS NOT NULL THEN h_company
        WHEN noise_reason IS NULL AND m_category IS NOT NULL THEN coalesce(m_company, CASE WHEN m_category <> 'ignored' THEN p_company END)
   END AS a_company,
   CASE WHEN code IS NOT NULL THEN CASE WHEN {asked} THEN m_role ELSE h_role END
        WHEN noise_reason IS NULL AND m_category IS NOT NULL
        THEN coalesce(m_role, CASE WHEN m_category <> 'ignored' THEN CASE WHEN p_company IS NULL THEN p_recovered ELSE p_role END END)
   END AS a_role,
   CASE WHEN code IS NOT NULL THEN CASE WHEN {asked} THEN m_req END WHEN noise_reason IS NULL THEN m_req END AS a_req FROM c1),
c3 AS MATERIALIZED (SELECT *, {company('a_company')} AS n_company, nullif({tidy('a_role')}, '') AS n_role FROM c2),
c4 AS MATERIALIZED (SELECT *, CASE WHEN n_company <> '' AND NOT ({has('n_company', fixed.ASSESSMENT_NAME)} AND
         {has('sender', fixed.ASSESSMENT_HOST)}) THEN n_company END AS f_company FROM c3),
c5 AS MATERIALIZED (SELECT *, coalesce(a_category, 'ignored') <> 'ignored' AND f_company IS NOT NULL AS merge FROM c4),
classified AS MATERIALIZED (SELECT owner, account, message_id, thread_id, subject, internal_ms, msg_date,
   CASE WHEN merge THEN 'merge' ELSE 'skip' END AS kind,
   CASE WHEN merge THEN a_category ELSE 'ignored' END AS category,
   CASE WHEN merge THEN f_company END AS company, CASE WHEN merge THEN n_role END AS role,
   CASE WHEN merge THEN coalesce({requisition('subject', 'body')}, a_req) END AS external_id,
   CASE WHEN merge THEN {domain('sender')} END AS company_domain,
   CASE WHEN merge THEN CASE WHEN code IS NOT NULL THEN 'parser' ELSE 'llm' END END AS detected_by, code AS classifier_code,
   CAST(merge AND a_category = 'applied' AND ({confirms('subject', 'body')} OR NOT {has('subject', fixed.UPDATE_SUBJECT)}) AS BIGINT) AS is_confirmation,
   CAST(merge AND coalesce(code IN ('linkedin_applied', 'indeed_applied'), false) AS BIGINT) AS is_fast_apply
  FROM c5)"""


# --- rollup -----------------------------------------------------------------------------

ORDER = "ORDER BY internal_ms, message_id"


def rollup(source: str, group: str = "owner, thread_id", app_id: str = "thread_id") -> str:
    return rolled(source, group, app_id, ORDER, ORDER, "role IS NOT NULL")


RUNS, RECENT = "ORDER BY arrival, internal_ms, message_id", "ORDER BY internal_ms, arrival, message_id"


def rolled(source: str, group: str, app_id: str, ORDER: str, RECENT: str, known: str) -> str:
    """``ORDER`` is that in which messages were merged, ``RECENT`` that of their age; a note
    warns unless ``known`` holds for a message of the record."""
    first_known = lambda c: f"first({c} {ORDER}) FILTER (WHERE {c} IS NOT NULL)"
    return f"""
SELECT owner, {app_id} AS app_id, first(company {ORDER}) AS company,
  coalesce({first_known('role')}, 'Unknown Role') AS role,
  coalesce(first(category {ORDER}) FILTER (WHERE category IN ('offer', 'rejected')),
           CASE WHEN bool_or(category = 'interview') THEN 'interview' ELSE 'applied' END) AS status,
  bool_or(category IN ('interview', 'offer')) AS reached_interview,
  min(msg_date) AS date_applied, last(msg_date {RECENT}) AS last_activity, max(internal_ms) AS last_activity_ts,
  CAST('Auto-detected from Gmail: ' || last(subject {RECENT}) ||
    CASE WHEN NOT bool_or({known}) THEN {q(fixed.NOTE_WARNING)} ELSE '' END AS VARCHAR) AS notes, 'auto' AS notes_source,
  {first_known('external_id')} AS external_id, last(detected_by {RECENT}) AS detected_by,
  {first_known('company_domain')} AS company_domain,
  NOT bool_or(is_confirmation) AS awaiting_application, bool_or(is_fast_apply) AS fast_apply,
  bool_or(is_confirmation AND NOT is_fast_apply) AS confirmed, first(thread_id {ORDER}) AS thread_id,
  first(account {ORDER}) AS account, first(internal_ms {ORDER}) AS first_ms, TIMESTAMP '2002-01-01 00:00:00' AS created_at
FROM {source} GROUP BY {group}"""


APPS = f"{EVENTS}, apps AS ({rollup('mail')})"
DECORATED = f"{APPS}, shown AS ({shapes.decorate('apps', 'duckdb')})"

VIEW = """owner, app_id, company, role, status, last_activity_ts, notes, external_id, detected_by, company_domain,
  thread_id, account, first_ms, CAST(reached_interview AS BIGINT) AS reached_interview,
  CAST(awaiting_application AS BIGINT) AS awaiting_application, CAST(fast_apply AS BIGINT) AS fast_apply,
  CAST(confirmed AS BIGINT) AS confirmed, strftime(date_applied, '%Y-%m-%d') AS date_applied,
  strftime(last_activity, '%Y-%m-%d') AS last_activity"""


# --- matching ------------------------------------------------------------------------------

def pairs(apps: str, met_by: str) -> str:
    """CTEs up to ``same_posting`` for the records ``apps`` (a CTE) and the mail that meets them."""
    return f"""
{apps},
e AS (SELECT *, {words('company')} AS e_words, string_split_regex(company, '\\s+')[1] AS first_word,
        {key('role')} AS m_title FROM mail WHERE {met_by}),
r AS (SELECT *, CAST(substr(app_id, 2) AS BIGINT) AS seq, {words('company')} AS r_words,
        CASE WHEN role = 'Unknown Role' THEN '' ELSE {key('role')} END AS r_title FROM apps),
met AS (SELECT e.owner, e.message_id, e.company AS e_company, e.company_domain AS e_domain, e.external_id AS e_req,
          e.m_title, e.role AS e_role, e.msg_date, e.is_confirmation, e.is_fast_apply,
          r.app_id, r.seq, r.company AS r_company, r.company_domain AS r_domain, r.external_id AS r_req, r.r_title,
          r.role AS r_role, r.date_applied, r.awaiting_application, r.fast_apply, r.confirmed,
          coalesce(e.company_domain = r.company_domain, false) AS same_domain,
          {same_entity('e_words', 'r_words')} AS same_name,
          lower(left(r.company, length(first_word))) = lower(first_word)
            AND NOT regexp_matches(lower(substr(r.company, length(first_word) + 1, 1)), '[a-z0-9]') AS same_start
        FROM e JOIN r ON e.owner = r.owner),
cand AS (SELECT *, CASE WHEN same_domain THEN 0 ELSE 1 END AS priority FROM met
         WHERE same_domain OR (same_name AND same_start AND (e_domain IS NULL OR r_domain IS NULL))),
posting AS (SELECT *, bool_or(m_title = r_title) OVER (PARTITION BY owner, message_id) AS has_exact,
              count(*) OVER (PARTITION BY owner, message_id) AS n_related
            FROM cand WHERE m_title <> '' AND r_title <> '' AND (contains(m_title, r_title) OR contains(r_title, m_title))),
same_posting AS (SELECT * FROM posting WHERE (has_exact AND m_title = r_title) OR (NOT has_exact AND n_related = 1))"""


PAIRS = pairs(APPS, "true")
HALF = f"{EVENTS}, half AS (SELECT * FROM mail WHERE internal_ms % 2 = 0), apps AS ({rollup('half')})"
HELD_OUT = pairs(HALF, "internal_ms % 2 = 1")

def counted(condition: str) -> str:
    return f"""WITH {PAIRS} SELECT owner, message_id, count(*) AS n_candidates, first(app_id ORDER BY seq) AS first_app_id
FROM met WHERE {condition} GROUP BY owner, message_id"""


LATEST = """
latest AS (SELECT owner, message_id, first(app_id ORDER BY date_applied DESC, priority, seq) AS app_id, max(date_applied) AS date_applied
  FROM same_posting WHERE NOT is_confirmation AND e_role IS NOT NULL AND (date_applied <= msg_date OR awaiting_application)
  GROUP BY owner, message_id)"""

BLOCKS = f"""
RECURSIVE {EVENTS},
b1 AS (SELECT *, {words('company')} AS w FROM mail),
b2 AS (SELECT *, CASE WHEN len(w) = 0 THEN NULL ELSE array_to_string(w[1:greatest(1, coalesce(list_max(list_transform(w,
         lambda x, i: CASE WHEN x NOT IN ({items(fixed.DESCRIPTORS)}) THEN i ELSE 1 END)), 1))], ' ') END AS core FROM b1),
b3 AS (SELECT *, 'n:' || core AS name_node, 'd:' || company_domain AS domain_node FROM b2),
edges AS (SELECT DISTINCT owner, name_node AS u, domain_node AS v FROM b3 WHERE company_domain IS NOT NULL),
ways AS (SELECT owner, u, v FROM edges UNION SELECT owner, v, u FROM edges),
reach(owner, node, label) AS (
  SELECT owner, u, u FROM ways
  UNION
  SELECT w.owner, w.v, reach.label FROM reach JOIN ways w ON w.owner = reach.owner AND w.u = reach.node),
components AS (SELECT owner, node, min(label) AS component FROM reach GROUP BY owner, node)"""



# --- the fold --------------------------------------------------------------------------------

RECORD = ("STRUCT(app_id VARCHAR, company VARCHAR, words VARCHAR[], title VARCHAR, req VARCHAR, dom VARCHAR, day DATE, "
          "awaiting BOOLEAN, fast BOOLEAN, confirmed BOOLEAN)")


def fold(source: str, ORDER: str = ORDER) -> str:
    """CTEs ``turn`` and ``fold``: one message of every owner a round, in order of arrival.

    The state of an owner is the list of records so far; no blocking, so all records are
    looked at.  Choices are numbers made of sort keys, with the record's place in the list
    as the last six digits.
    """
    rec = "recs[c.i]"
    starts = lambda r: (
        f"lower(left({r}.company, length(first_word))) = lower(first_word) AND NOT "
        f"regexp_matches(lower(substr({r}.company, length(first_word) + 1, 1)), '[a-z0-9]')"
    )
    number = lambda r: f"({r}.day - DATE '1970-01-01')"
    least = lambda pool, test, by: f"list_min(list_transform(list_filter({pool}, lambda c: {test}), lambda c: {by})) % 1000000"
    claim = (f"NOT (CASE WHEN fast THEN {rec}.fast ELSE {rec}.confirmed END) AND "
             f"(CASE WHEN {rec}.awaiting THEN day <= {rec}.day ELSE abs(day - {rec}.day) <= 4 END)")
    nearest = lambda pool: least(pool, claim, f"abs(day - {rec}.day) * 1000000 + c.i")
    oldest = lambda pool, test: least(pool, test, f"{number(rec)} * 1000000 + c.i")
    latest = lambda pool, test: least(pool, test, f"(1000000 - {number(rec)}) * 10000000 + c.h * 1000000 + c.i")
    past = f"{rec}.day <= day"
    return f"""
turn AS MATERIALIZED (SELECT owner, row_number() OVER (PARTITION BY owner {ORDER}) AS n, message_id, company, {words('company')} AS words,
  string_split_regex(company, '\\s+')[1] AS first_word, CASE WHEN nullif(nullif(role, ''), 'Unknown Role') IS NOT NULL THEN {key('role')} END AS title,
  nullif(external_id, '') AS req, company_domain AS dom, msg_date AS day, CAST(is_confirmation AS BOOLEAN) AS conf,
  CAST(is_fast_apply AS BOOLEAN) AS fast FROM {source}),
fold(owner, n, recs, message_id, app_id, is_new, bridged) AS (
  SELECT owner, CAST(0 AS BIGINT), CAST([] AS {RECORD}[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, false FROM turn GROUP BY owner
  UNION ALL
  SELECT owner, n,
    CASE WHEN chosen IS NULL THEN list_append(recs, CAST(row('app-' || message_id, company, words, title, req, dom, day, NOT conf, fast, conf AND NOT fast) AS {RECORD}))
    ELSE list_transform(recs, lambda r, i: CASE WHEN i <> chosen THEN r ELSE CAST(row(r.app_id, r.company, r.words, coalesce(r.title, title),
      coalesce(r.req, req), coalesce(r.dom, dom), least(r.day, day), r.awaiting AND NOT conf, r.fast OR fast, r.confirmed OR (conf AND NOT fast)) AS {RECORD}) END) END,
    message_id, CASE WHEN chosen IS NULL THEN 'app-' || message_id ELSE recs[chosen].app_id END, chosen IS NULL,
    coalesce(recs[chosen].dom = dom AND NOT {same_entity('words', 'recs[chosen].words')}, false)
  FROM (
    SELECT *, coalesce(shared, CASE
      WHEN title IS NULL THEN CASE WHEN conf THEN {nearest('pool')} ELSE {oldest('pool', f"({past} OR {rec}.awaiting)")} END
      WHEN conf THEN coalesce({nearest('posting')}, {nearest('untitled')})
      ELSE coalesce({latest('posting', f"({past} OR {rec}.awaiting)")}, {oldest('untitled', past)}) END) AS chosen
    FROM (
      SELECT *, list_filter(pool, lambda c: {rec}.title IS NULL) AS untitled,
        CASE WHEN len(list_filter(pool, lambda c: {rec}.title = title)) > 0 THEN list_filter(pool, lambda c: {rec}.title = title)
             WHEN len(list_filter(pool, lambda c: {rec}.title <> '' AND (contains({rec}.title, title) OR contains(title, {rec}.title)))) = 1
             THEN list_filter(pool, lambda c: {rec}.title <> '' AND (contains({rec}.title, title) OR contains(title, {rec}.title)))
             ELSE list_filter(pool, lambda c: false) END AS posting
      FROM (
        SELECT *, {least('met', f"{rec}.req = req", "c.h * 1000000 + c.i")} AS shared,
          list_filter(met, lambda c: req IS NULL OR {rec}.req IS NULL) AS pool
        FROM (
          SELECT t.*, f.recs, list_filter(list_transform(range(1, len(f.recs) + 1), lambda i: {{'i': i, 'h': CASE
              WHEN dom = f.recs[i].dom THEN 0 WHEN dom IS NOT NULL AND f.recs[i].dom IS NOT NULL THEN NULL
              WHEN {starts('f.recs[i]')} AND {same_entity('words', 'f.recs[i].words')} THEN 1 END}}), lambda c: c.h IS NOT NULL) AS met
          FROM fold f JOIN turn t ON t.owner = f.owner AND t.n = f.n + 1) m0) m1) m2) m3)"""


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


SENT = "CASE WHEN internal_ms % 35 = 0 THEN 1009843200000 WHEN internal_ms % 5 = 0 THEN internal_ms - internal_ms % 1000 ELSE internal_ms END"
oracle("messages_read", f"""WITH {MESSAGES} SELECT owner, message_id, thread_id,
  CASE WHEN internal_ms % 11 = 0 THEN '' ELSE subject END AS subject, sender, {SENT} AS internal_ms,
  strftime(make_timestamp(({SENT}) * 1000), '%Y-%m-%d') AS msg_date FROM messages""")
DUMP = f"{MESSAGES}, dump AS (SELECT *, {shapes.PLAIN_TEXT} AS plain, {shapes.HTML_TEXT} AS html FROM messages)"
oracle("message_bodies_selected", f"WITH {DUMP} SELECT message_id, {select_body('plain', 'html')} AS body FROM dump")
RICH = "nullif(rich, '')"
oracle("message_bodies_built", f"""WITH {DUMP},
chosen AS (SELECT message_id, sender, {select_body('plain', 'html')} AS picked, {strip_html('html')} AS from_html FROM dump),
forms AS (SELECT message_id, sender, {clean_card('picked')} AS card, {clean_body('picked')} AS plain,
            {clean_body("coalesce(nullif(from_html, ''), picked)")} AS rich FROM chosen)
SELECT message_id, CASE WHEN contains(sender, '{fixed.BOARD_A_SENDER}') THEN card
  WHEN contains(sender, '{fixed.BOARD_B_SENDER}') THEN CASE WHEN {ext('rich', fixed.BOARD_B_SENT_TO)} IS NOT NULL
    THEN 'Employer: ' || {strip(ext('rich', fixed.BOARD_B_SENT_TO))} || chr(10) || chr(10) || rich ELSE rich END
  ELSE plain END AS body FROM forms""")


def phrases(values) -> str:
    body = "|".join(_escape(v) for v in values)
    return r"(?i)(?:^|[^0-9A-Za-z_])(?:" + body + r")(?:$|[^0-9A-Za-z_])"


def _escape(phrase: str) -> str:
    return "".join(r"\s+" if ch == " " else ("\\" + ch if ch in "!.'" else ch) for ch in phrase)


oracle("candidates_selected", f"""WITH {MESSAGES}, m AS (SELECT *, subject || chr(10) || body AS anywhere FROM messages)
SELECT owner, message_id, {day('msg_date')} AS msg_date FROM m
WHERE msg_date >= DATE '1999-06-30' - 180 AND internal_ms % 23 <> 0
  AND {has('anywhere', phrases(fixed.WANTED_PHRASES))} AND NOT {has('subject', phrases(fixed.EXCLUDED_SUBJECTS))}
  AND NOT {has('anywhere', phrases(fixed.EXCLUDED_ANYWHERE))}
  AND NOT contains(lower(sender), lower(account))
  AND {' AND '.join(f"NOT contains(lower(sender), '{a}')" for a in fixed.EXCLUDED_SENDERS)}""")
oracle("scan_window_counts", f"""WITH {MESSAGES} SELECT CAST(requested AS BIGINT) AS requested, CAST(days AS BIGINT) AS days,
  count(msg_date) AS n FROM (VALUES (30, 30), (60, 60), (90, 90), (180, 180), (45, 30)) w(requested, days)
LEFT JOIN messages ON msg_date >= DATE '1999-06-30' - CAST(days AS INTEGER) GROUP BY requested, days""")
oracle("messages_unprocessed", f"""WITH {MESSAGES} SELECT owner, message_id, thread_id FROM messages m WHERE NOT EXISTS
  (SELECT 1 FROM messages l WHERE l.msg_date < DATE '1998-01-01' AND l.message_id = m.message_id AND l.owner = m.owner)""")
oracle("ledger_appended", f"""WITH {MESSAGES} SELECT owner, message_id, thread_id,
  CASE WHEN msg_date < DATE '1998-01-01' THEN 'applied' ELSE 'rejected' END AS classified_as FROM messages""")
oracle("board_reset", f"""WITH {APPS}, {MESSAGES} SELECT (SELECT count(*) FROM apps) AS saved, (SELECT count(*) FROM apps) AS applications,
  (SELECT count(*) FROM messages WHERE msg_date < DATE '1998-01-01') AS messages, CAST(0 AS BIGINT) AS applications_left""")
oracle("noise_marked", f"""WITH {MESSAGES}, m AS (SELECT message_id, sender, body, {shapes.NOISY_SUBJECT} AS noisy FROM messages)
SELECT message_id, {noise('noisy', 'sender', 'body')} AS noise_reason FROM m""")
oracle("messages_kept", f"""WITH {MESSAGES} SELECT owner, count(*) AS n_kept FROM messages
WHERE {noise('subject', 'sender', 'body')} IS NULL GROUP BY owner""")
oracle("pages_stripped", f"SELECT page_id, {strip_html('html')} AS body FROM pages")
oracle("pages_decoded", f"WITH p AS (SELECT page_id, {shapes.ENTITY_TEXT} AS t FROM pages) SELECT page_id, {decode('t')} AS body FROM p")
oracle("documents_cleaned", f"WITH d AS (SELECT doc_id, {shapes.NOISY_DOCUMENT} AS raw FROM documents) SELECT doc_id, {clean_body('raw')} AS body FROM d")
oracle("cards_cleaned", f"""WITH {MESSAGES}, c AS (SELECT message_id, {shapes.CARD_TEXT} AS raw FROM messages
  WHERE contains(sender, '{fixed.BOARD_A_SENDER}')) SELECT message_id, {clean_card('raw')} AS body FROM c""")
oracle("sender_addresses", f"WITH {MESSAGES} SELECT sender, count(*) AS n, {address('sender')} AS address FROM messages GROUP BY sender")
oracle("document_addresses", f"SELECT doc_id, {address('text')} AS address FROM documents")
oracle("company_domains", f"WITH {MESSAGES} SELECT sender, count(*) AS n, {domain('sender')} AS company_domain FROM messages GROUP BY sender")
oracle("shared_host_messages", f"""WITH {MESSAGES}, m AS (SELECT split_part({address('sender')}, '@', 2) AS host FROM messages)
SELECT host, count(*) AS n, CASE WHEN host IN ({items(fixed.SHARED_HOSTS)}) THEN 'yes' ELSE 'no' END AS shared FROM m GROUP BY host""")
oracle("companies_normalized", f"""WITH {EVENTS}, c AS (SELECT {shapes.LEGAL_NAME} AS raw FROM mail)
SELECT raw, count(*) AS n, {company('raw')} AS company FROM c GROUP BY raw""")
oracle("requisitions_extracted", f"""WITH {MESSAGES}, m AS (SELECT message_id, body, {shapes.REQ_SUBJECT} AS s FROM messages)
SELECT message_id, {requisition('s', 'body')} AS external_id FROM m""")
oracle("document_requisitions", f"SELECT doc_id, {requisition(q(''), 'text')} AS external_id FROM documents")
oracle("requisitions_canonical", f"""WITH o AS (SELECT o_orderkey, {shapes.RAW_REQ} AS raw FROM orders)
SELECT o_orderkey, raw, {canonical_requisition('raw')} AS external_id FROM o""")
oracle("roles_tidied", f"""WITH {EVENTS}, t AS (SELECT message_id, {shapes.RAW_ROLE} AS raw FROM mail WHERE role IS NOT NULL)
SELECT message_id, raw, {tidy('raw')} AS role FROM t""")
oracle("roles_recovered", f"WITH {MESSAGES} SELECT message_id, {recover('body', 'subject')} AS role FROM messages")
oracle("employer_sentences", f"WITH {MESSAGES}, {prose_ctes('messages')} SELECT message_id, p_company AS company, p_role AS role FROM prose")
oracle("statuses_read", f"WITH {MESSAGES} SELECT message_id, {status('body')} AS status FROM messages")
oracle("message_signals", f"""WITH {MESSAGES} SELECT message_id, CAST({confirms('subject', 'body')} AS BIGINT) AS confirms,
  CAST({has('subject', fixed.UPDATE_SUBJECT)} AS BIGINT) AS updates FROM messages""")
oracle("templates_extracted", f"""WITH {MESSAGES}, {hit_ctes()} SELECT message_id, noise_reason, h_category AS category,
  h_company AS company, h_role AS role, code FROM hits""")
oracle("model_outputs_parsed", f"WITH {OUTPUTS}, {model_ctes()} SELECT * FROM parsed")
oracle("model_needed", f"""WITH {MESSAGES}, {hit_ctes()} SELECT owner, message_id FROM hits
WHERE noise_reason IS NULL AND (code IS NULL OR nullif(h_role, '') IS NULL)""")
CLASSIFIED = f"{MESSAGES}, {OUTPUTS}, {event_ctes()}"
oracle("events_classified", f"""WITH {CLASSIFIED} SELECT owner, message_id, kind, category, company, role, external_id,
  company_domain, detected_by, classifier_code, is_confirmation, is_fast_apply FROM classified""")
oracle("candidates_by_domain", counted("same_domain"))
oracle("candidates_by_first_word", counted("same_start"))
oracle("candidates_same_entity", counted("same_name"))
oracle("candidates_gathered", f"""WITH {PAIRS} SELECT owner, message_id, count(*) FILTER (WHERE priority = 0) AS n_domain,
  count(*) FILTER (WHERE priority = 1) AS n_name, first(app_id ORDER BY priority, seq) AS first_app_id FROM cand GROUP BY owner, message_id""")
oracle("requisitions_matched", f"""WITH {PAIRS} SELECT owner, message_id,
  first(app_id ORDER BY priority, seq) FILTER (WHERE r_req = e_req) AS same_req_app_id,
  CASE WHEN any_value(e_req) IS NULL THEN count(*) WHEN bool_or(coalesce(r_req = e_req, false)) THEN 1
       ELSE count(*) FILTER (WHERE r_req IS NULL) END AS n_eligible FROM cand GROUP BY owner, message_id""")
oracle("postings_matched", f"""WITH {PAIRS} SELECT owner, message_id, count(*) AS n_postings, CAST(bool_or(has_exact) AS BIGINT) AS is_exact,
  first(app_id ORDER BY priority, seq) AS first_app_id FROM same_posting GROUP BY owner, message_id""")
oracle("unique_variants", f"WITH {HELD_OUT} SELECT owner, message_id, app_id AS first_app_id FROM same_posting WHERE NOT has_exact")
oracle("nearest_paired", f"""WITH {HELD_OUT}, tiers AS (SELECT *, 0 AS tier FROM same_posting
  UNION ALL SELECT * EXCLUDE (priority), priority, NULL, NULL, 1 FROM cand WHERE m_title <> '' AND r_role = 'Unknown Role'
  UNION ALL SELECT * EXCLUDE (priority), priority, NULL, NULL, 0 FROM cand WHERE e_role IS NULL),
near AS (SELECT *, abs(msg_date - date_applied) AS gap FROM tiers WHERE is_confirmation
  AND NOT (CASE WHEN is_fast_apply THEN fast_apply ELSE confirmed END)
  AND CASE WHEN awaiting_application THEN msg_date <= date_applied ELSE abs(msg_date - date_applied) <= 4 END)
SELECT owner, message_id, first(app_id ORDER BY tier, gap, seq) AS app_id, CAST(first(gap ORDER BY tier, gap, seq) AS BIGINT) AS gap_days
FROM near GROUP BY owner, message_id""")
oracle("latest_asof", f"WITH {PAIRS}, {LATEST} SELECT owner, message_id, app_id, {day('date_applied')} AS date_applied FROM latest")
oracle("oldest_asof", f"""WITH {PAIRS} SELECT owner, message_id, first(app_id ORDER BY date_applied, seq) AS app_id FROM cand
WHERE NOT is_confirmation AND e_role IS NULL AND (date_applied <= msg_date OR awaiting_application) GROUP BY owner, message_id""")
oracle("roleless_asof", f"""WITH {PAIRS}, {LATEST} SELECT owner, message_id, first(app_id ORDER BY date_applied, seq) AS app_id FROM cand
WHERE NOT is_confirmation AND e_role IS NOT NULL AND r_role = 'Unknown Role' AND date_applied <= msg_date
  AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.message_id = cand.message_id) GROUP BY owner, message_id""")
oracle("messages_assigned", f"WITH RECURSIVE {EVENTS}, {fold('mail')} SELECT owner, message_id, app_id, CAST(is_new AS BIGINT) AS is_new FROM fold WHERE n > 0")
oracle("domain_bridges", f"WITH RECURSIVE {EVENTS}, {fold('mail')} SELECT owner, message_id, app_id FROM fold WHERE bridged")
oracle("applications_matched", f"""WITH RECURSIVE {CLASSIFIED},
merges AS (SELECT * REPLACE (CAST(is_confirmation AS BOOLEAN) AS is_confirmation, CAST(is_fast_apply AS BOOLEAN) AS is_fast_apply) FROM classified WHERE kind = 'merge'),
{fold('merges')}, j AS (SELECT m.*, f.app_id FROM merges m JOIN fold f ON f.owner = m.owner AND f.message_id = m.message_id AND f.n > 0),
apps AS ({rollup('j', 'owner, app_id', 'app_id')}) SELECT {VIEW} FROM apps""")
oracle("employer_components", f"WITH {BLOCKS} SELECT owner, node, component FROM components")
oracle("employer_block_sizes", f"""WITH {BLOCKS} SELECT b3.owner, coalesce(component, name_node, domain_node) AS block, count(*) AS n_rows
FROM b3 LEFT JOIN components c ON c.owner = b3.owner AND c.node = coalesce(name_node, domain_node) GROUP BY 1, 2""")
oracle("applications_rolled_up", f"WITH {APPS} SELECT {VIEW} FROM apps")
oracle("applications_merged", f"WITH {APPS} SELECT {VIEW} FROM apps")
oracle("statuses_forward", f"""WITH s AS (SELECT user_id, event_id, {shapes.EVENT_STAGE} AS stage FROM events)
SELECT user_id, coalesce(first(stage ORDER BY event_id) FILTER (WHERE stage IN ('offer', 'rejected')),
  CASE WHEN bool_or(stage = 'interview') THEN 'interview' ELSE 'applied' END) AS status FROM s GROUP BY user_id""")
oracle("statuses_stepwise", ORACLES["statuses_forward"])
ENTRY = "category || '|' || message_id || '|' || strftime(msg_date, '%Y-%m-%d') || CASE WHEN is_fast_apply THEN '|fast' ELSE '' END"
oracle("refs_collected", f"""WITH {EVENTS} SELECT owner, thread_id AS app_id, string_agg({ENTRY}, ' ; ' {ORDER}) AS emails
FROM mail GROUP BY owner, thread_id""")
oracle("sync_counters", f"""WITH {CLASSIFIED}, t AS (SELECT count(DISTINCT owner || thread_id) AS added, count(*) AS merged FROM classified WHERE kind = 'merge')
SELECT count(*) AS processed, any_value(added) AS added, any_value(merged - added) AS updated, count(*) FILTER (WHERE kind = 'skip') + 7 AS skipped,
  CAST(3 AS BIGINT) AS failed, count(*) FILTER (WHERE classifier_code = 'linkedin_applied') AS board_a_applied,
  count(*) FILTER (WHERE classifier_code = 'linkedin_rejected') AS board_a_rejected,
  count(*) FILTER (WHERE classifier_code = 'indeed_applied') AS board_b_applied,
  count(*) FILTER (WHERE classifier_code = 'general_template') AS general_template FROM classified, t""")

STATS = """count(*) AS total, count(*) FILTER (WHERE status <> 'rejected') AS active, count(*) FILTER (WHERE status = 'offer') AS offers,
  count(*) FILTER (WHERE status IN ('interview', 'offer') OR reached_interview) AS interviewed,
  CASE WHEN count(*) = 0 THEN '0.0' ELSE
    CAST((2000 * (count(*) FILTER (WHERE status IN ('interview', 'offer') OR reached_interview)) + count(*)) // (2 * count(*)) // 10 AS VARCHAR) || '.' ||
    CAST((2000 * (count(*) FILTER (WHERE status IN ('interview', 'offer') OR reached_interview)) + count(*)) // (2 * count(*)) % 10 AS VARCHAR)
  END AS interview_rate"""
oracle("stats_overall", f"WITH {DECORATED} SELECT {STATS} FROM shown")
oracle("stats_by_owner", f"WITH {DECORATED} SELECT owner, {STATS} FROM shown GROUP BY owner")
oracle("stats_of_search", f"WITH {DECORATED} SELECT {STATS} FROM shown WHERE contains(lower(company), '(backend)') OR contains(lower(role), '(backend)')")
oracle("status_counts", f"""WITH {DECORATED} SELECT CAST(position AS BIGINT) AS position, c.status, label, count(app_id) AS n
FROM (VALUES (0, 'applied', 'Applied'), (1, 'interview', 'Interview'), (2, 'offer', 'Offer'), (3, 'rejected', 'Rejected')) c(position, status, label)
LEFT JOIN shown s ON s.status = c.status GROUP BY ALL""")
oracle("board_columns", f"""WITH {DECORATED}, k AS (SELECT owner, status, app_id,
  row_number() OVER (PARTITION BY owner, status ORDER BY last_activity DESC NULLS LAST, updated_at DESC, app_id) AS rank,
  count(*) OVER (PARTITION BY owner, status) AS n_status FROM shown)
SELECT *, greatest(n_status - 3, 0) AS hidden FROM k WHERE rank <= 3""")
oracle("applications_default_order", f"WITH {DECORATED} SELECT owner, app_id, row_number() OVER (ORDER BY updated_at DESC, app_id) AS rank FROM shown")
oracle("table_by_role_descending", f"""WITH {DECORATED} SELECT owner, app_id, role, row_number() OVER (PARTITION BY owner
  ORDER BY CASE WHEN role = 'Unknown Role' THEN 1 ELSE 0 END, role DESC, updated_at DESC, app_id) AS rank FROM shown""")
oracle("table_by_company", f"WITH {DECORATED} SELECT app_id, company, row_number() OVER (ORDER BY company, updated_at DESC, app_id) AS rank FROM shown")
oracle("table_page", f"""WITH {DECORATED}, k AS (SELECT owner, app_id, row_number() OVER (PARTITION BY owner
    ORDER BY coalesce(CAST(last_activity AS VARCHAR), '') DESC, updated_at DESC, app_id) AS rank, count(*) OVER (PARTITION BY owner) AS n_total FROM shown),
 p AS (SELECT *, least(1, (n_total + 4) // 5 - 1) AS page FROM k)
SELECT owner, app_id, rank, CAST(page AS BIGINT) AS page, n_total FROM p WHERE rank > page * 5 AND rank <= page * 5 + 5""")
oracle("merge_order", f"WITH {EVENTS} SELECT owner, message_id, row_number() OVER (PARTITION BY owner {ORDER}) AS rank FROM mail")
oracle("applications_searched", f"WITH {DECORATED} SELECT owner, app_id, company, role FROM shown WHERE regexp_matches(company, '(?i)kids') OR regexp_matches(role, '(?i)kids')")
oracle("applications_with_status", f"""WITH {DECORATED} SELECT app_id, 'interview' AS asked FROM shown WHERE status = 'interview'
UNION ALL SELECT app_id, 'archived' FROM shown""")


def label(x: str, labels: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + " END"


oracle("application_labels", f"""WITH {DECORATED} SELECT app_id, {label('status', fixed.STATUS_LABELS)} AS status_label,
  {label('interview_step', fixed.STEP_LABELS)} AS step_label,
  concat_ws(' + ', CASE WHEN source = 'csv' THEN {q(fixed.BADGE_IMPORTED)} END, CASE WHEN NOT edited THEN {label('detected_by', fixed.BADGES)} END) AS badges,
  CAST(role = 'Unknown Role' AS BIGINT) AS unknown_role FROM shown""")
oracle("message_links", f"""WITH {DECORATED} SELECT s.owner, s.app_id, {day('msg_date')} AS date, internal_ms AS position, message_id,
  CASE WHEN is_fast_apply THEN {q(fixed.LINK_FAST)} ELSE {q(fixed.LINK_STAGE)} || {label('category', fixed.STATUS_LABELS)} END AS label,
  {q(fixed.MESSAGE_URL)} || coalesce('?authuser=' || url_encode(s.account), '') || '#all/' || message_id AS link
FROM mail m JOIN shown s ON s.app_id = m.thread_id AND s.owner = m.owner""")
oracle("changed_applications", f"""WITH {DECORATED}, old AS ({shapes.earlier('shown', 'duckdb')})
SELECT s.owner, s.app_id FROM shown s LEFT JOIN old ON old.app_id = s.app_id AND old.owner = s.owner WHERE s.updated_at IS DISTINCT FROM old.updated_at""")
oracle("refs_by_date", f"""WITH {EVENTS} SELECT thread_id AS app_id,
  string_agg({ENTRY}, ' ; ' ORDER BY strftime(msg_date, '%Y-%m-%d'), internal_ms DESC, message_id DESC) AS emails FROM mail GROUP BY owner, thread_id""")


def decoded(cell: str) -> str:
    """List of {c, i, d, f} structs of the well-formed entries of a cell."""
    part = lambda n: strip(f"split_part(e, '|', {n})")
    entries = f"list_transform(string_split({cell}, ';'), lambda e: {{'c': {part(1)}, 'i': {part(2)}, 'd': {part(3)}, 'f': {part(4)} = 'fast'}})"
    return f"list_filter({entries}, lambda s: s.i <> '' AND s.c IN ({items(fixed.STATUSES)}))"


def encoded(entries: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({entries}, lambda s: s.c || '|' || s.i || '|' || s.d || "
        "CASE WHEN s.f THEN '|fast' ELSE '' END), ' ; '), '')"
    )


CELLS = f"cells AS (SELECT o_orderkey, {shapes.RAW_REFS} AS cell FROM orders)"
oracle("refs_decoded", f"WITH {CELLS} SELECT o_orderkey, cell, {encoded(decoded('cell'))} AS encoded FROM cells")
LOOSE = (
    "list_filter(list_transform(string_split(cell, ';'), lambda e: {'c': trim(split_part(e, '|', 1)), 'i': "
    f"{strip('''split_part(e, '|', 2)''')}, 'd': split_part(e, '|', 3), 'f': split_part(e, '|', 4) = 'fast'}}), "
    f"lambda s: s.i <> '' AND s.c IN ({items(fixed.STATUSES)}))"
)
oracle("refs_sanitized", f"""WITH {CELLS}, l AS (SELECT o_orderkey, {LOOSE} AS refs FROM cells),
k AS (SELECT o_orderkey, list_filter(refs, lambda s, i: list_position(list_transform(refs, lambda t: t.i), s.i) = i) AS refs FROM l)
SELECT o_orderkey, {encoded('refs')} AS encoded FROM k""")
oracle("refs_edited", f"""WITH {EVENTS}, asked AS (SELECT 'u' || o_custkey AS owner, 't' || o_orderkey AS app_id,
    {decoded(shapes.RAW_REFS)} AS refs FROM orders WHERE o_orderkey % 3 = 0),
once AS (SELECT owner, app_id, list_filter(refs, lambda s, i: list_position(list_transform(refs, lambda t: t.i), s.i) = i) AS refs FROM asked)
SELECT owner, thread_id AS app_id, internal_ms AS position, message_id, category FROM mail m
WHERE NOT EXISTS (SELECT 1 FROM once o WHERE o.owner = m.owner AND o.app_id = m.thread_id)
UNION ALL SELECT owner, app_id, CAST(unnest(range(len(refs))) AS BIGINT), unnest(refs).i, unnest(refs).c FROM once o
WHERE EXISTS (SELECT 1 FROM mail m WHERE o.owner = m.owner AND o.app_id = m.thread_id)""")
oracle("model_answers", f"""WITH {MESSAGES}, {hit_ctes()} SELECT owner, message_id,
  '{{"category": "applied", "seen": ' || length(subject) || ' ' || length(body) || '}} ' || sender AS raw_text FROM hits
WHERE noise_reason IS NULL AND (code IS NULL OR nullif(h_role, '') IS NULL)""")
NEW = f"n AS ({shapes.new_rows('orders', 'duckdb')}), bad AS (SELECT * FROM n WHERE coalesce(company, '') = '' OR coalesce(role, '') = ''), good AS (SELECT * FROM n WHERE coalesce(company, '') <> '' AND coalesce(role, '') <> '')"
oracle("applications_prepared", f"""WITH {NEW}, g AS (SELECT *, reached_interview OR coalesce(status IN ('interview', 'offer'), false) AS reached,
  try_cast(nullif(last_activity, '') AS DATE) AS act FROM good)
SELECT app_id, company, role, CASE WHEN reached AND coalesce(status, 'applied') = 'applied' THEN 'interview' ELSE coalesce(status, 'applied') END AS status,
  nullif(interview_step, '') AS interview_step, CAST(reached AS BIGINT) AS reached_interview, nullif(date_applied, '') AS date_applied,
  {day('act')} AS last_activity, coalesce(epoch_ms(CAST(act AS TIMESTAMP)), 0) AS last_activity_ts, nullif(notes, '') AS notes, 'manual' AS notes_source,
  CASE WHEN source = 'csv' THEN 'csv' ELSE 'manual' END AS source, nullif(trim(account), '') AS account FROM g""")
oracle("applications_rejected", f"WITH {NEW} SELECT app_id, 'company and role are required' AS reason FROM bad")
EDITS = f"""edits AS (SELECT *, CASE WHEN e_status = 'archived' THEN 'invalid status' WHEN e_interview_step = 'party' THEN 'invalid interview_step' END AS reason
  FROM ({shapes.flat_edits('orders', 'duckdb')}) f)"""


def edited(column: str, new: str | None = None) -> str:
    given = f"e_{column}"
    return f"CASE WHEN g.app_id IS NULL OR {given} = '{shapes.ABSENT}' THEN s.{column} ELSE {new or given} END"


def was_set(column: str) -> str:
    return f"(g.app_id IS NOT NULL AND e_{column} IS DISTINCT FROM '{shapes.ABSENT}')"


oracle("edits_applied", f"""WITH {DECORATED}, {EDITS}, g AS (SELECT * FROM edits WHERE reason IS NULL)
SELECT s.app_id, {edited('status')} AS status, {edited('role')} AS role, {edited('interview_step')} AS interview_step, {edited('notes')} AS notes,
  CASE WHEN {was_set('notes')} THEN 'manual' ELSE s.notes_source END AS notes_source,
  {edited('account', "nullif(trim(e_account), '')")} AS account,
  CASE WHEN {was_set('last_activity')} THEN coalesce(epoch_ms(CAST(try_cast(e_last_activity AS DATE) AS TIMESTAMP)), 0) ELSE s.last_activity_ts END AS last_activity_ts,
  {day(edited('last_activity', "try_cast(e_last_activity AS DATE)"))} AS last_activity,
  CAST(s.reached_interview OR (g.app_id IS NOT NULL AND e_status IN ('interview', 'offer')) AS BIGINT) AS reached_interview,
  CAST(s.edited OR {was_set('role')} AS BIGINT) AS edited FROM shown s LEFT JOIN g ON g.app_id = s.app_id""")
oracle("edits_refused", f"""WITH {DECORATED}, {EDITS} SELECT e.app_id, coalesce(reason, 'not found') AS reason FROM edits e
LEFT JOIN shown s ON s.app_id = e.app_id WHERE reason IS NOT NULL OR s.app_id IS NULL""")
oracle("applications_deleted", f"""WITH {DECORATED}, d AS (SELECT DISTINCT {shapes.DELETED_ID} AS app_id FROM orders)
SELECT app_id, 'kept' AS outcome FROM shown WHERE app_id NOT IN (SELECT app_id FROM d WHERE app_id IS NOT NULL)
UNION ALL SELECT app_id, CASE WHEN app_id IN (SELECT app_id FROM shown) THEN 'deleted' ELSE 'not found' END FROM d WHERE app_id IS NOT NULL""")
NESTED = f"nested AS (SELECT owner AS n_owner, thread_id AS n_id, string_agg({ENTRY}, ' ; ' {ORDER}) AS emails FROM mail GROUP BY owner, thread_id)"
JOINED = "shown LEFT JOIN nested ON n_id = app_id AND n_owner = owner"
oracle("sheet_written", f"""WITH {DECORATED}, {NESTED} SELECT company, role, {label('status', fixed.STATUS_LABELS)} AS status,
  coalesce({label('interview_step', fixed.STEP_LABELS)}, '') AS stage, CASE WHEN reached_interview THEN 'Yes' ELSE 'No' END AS reached_interview,
  coalesce({day('date_applied')}, '') AS date_applied, coalesce({day('last_activity')}, '') AS last_response, coalesce(job_url, '') AS job_url,
  coalesce(notes, '') AS notes, source, coalesce(company_domain, '') AS company_domain, coalesce(external_id, '') AS job_id,
  coalesce(account, '') AS gmail_account, coalesce(emails, '') AS emails FROM {JOINED}""")
oracle("sheet_imported", f"""WITH {DECORATED}, {NESTED} SELECT company, role,
  CASE WHEN reached_interview AND status = 'applied' THEN 'interview' ELSE status END AS status, interview_step,
  CAST(reached_interview OR status IN ('interview', 'offer') AS BIGINT) AS reached_interview, {day('date_applied')} AS date_applied,
  {day('last_activity')} AS last_activity, job_url, notes, company_domain, external_id, account, 'csv' AS source, emails FROM {JOINED}""")
WALK = f"""RECURSIVE {EVENTS}, apps AS ({rollup('mail')}),
s AS ({shapes.sheet_rows('orders', 'duckdb')}), refs AS ({shapes.board_refs('orders')}),
s2 AS (SELECT *, list_transform({decoded('cell')}, lambda x: x.i) AS ids, lower(trim(company)) || '|||' || lower(trim(role)) AS k FROM s),
boards AS (SELECT owner, list(message_id) AS seen FROM refs GROUP BY owner),
long AS (SELECT owner, position, ids, row_number() OVER (PARTITION BY owner ORDER BY position) AS rn FROM s2 WHERE len(ids) > 0),
walk(owner, rn, position, seen, is_new) AS (
  SELECT l.owner, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), coalesce(any_value(b.seen), CAST([] AS VARCHAR[])), false FROM long l LEFT JOIN boards b ON b.owner = l.owner GROUP BY l.owner
  UNION ALL
  SELECT l.owner, l.rn, l.position, CASE WHEN list_has_any(w.seen, l.ids) THEN w.seen ELSE list_concat(w.seen, l.ids) END, NOT list_has_any(w.seen, l.ids)
  FROM walk w JOIN long l ON l.owner = w.owner AND l.rn = w.rn + 1),
known AS (SELECT DISTINCT owner, lower(trim(company)) || '|||' || lower(trim(role)) AS k FROM apps),
plain AS (SELECT s2.owner, s2.position, row_number() OVER (PARTITION BY s2.owner, s2.k ORDER BY position) = 1 AND known.k IS NULL AS is_new
          FROM s2 LEFT JOIN known ON known.owner = s2.owner AND known.k = s2.k WHERE len(ids) = 0),
marked AS (SELECT owner, position, is_new FROM walk WHERE rn > 0 UNION ALL SELECT owner, position, is_new FROM plain)"""
oracle("sheet_new_rows", f"WITH {WALK} SELECT owner, position, CAST(is_new AS BIGINT) AS is_new FROM marked")
oracle("import_summary", f"""WITH {WALK} SELECT count(*) FILTER (WHERE is_new) AS imported, count(*) FILTER (WHERE NOT is_new) AS duplicates,
  CAST(0 AS BIGINT) AS failed, 'success' AS tone, 'Import complete' AS title FROM marked""")
oracle("board_with_new_rows", f"""WITH {DECORATED}, {NEW} SELECT app_id, company, source FROM shown UNION ALL
SELECT app_id, company, CASE WHEN source = 'csv' THEN 'csv' ELSE 'manual' END FROM good""")
DATES = f"d AS (SELECT o_orderkey, {shapes.date_cell('duckdb')} AS cell FROM orders)"
oracle("dates_coerced", f"""WITH {DATES}, t AS (SELECT *, trim(cell) AS s FROM d), u AS (SELECT *,
  try_cast(regexp_extract(s, '^(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}})$', 1) AS INTEGER) AS a,
  try_cast(regexp_extract(s, '^(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}})$', 2) AS INTEGER) AS b,
  regexp_extract(s, '^(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}})$', 3) AS y FROM t),
v AS (SELECT *, CASE WHEN a > 12 THEN b ELSE a END AS mo, CASE WHEN a > 12 THEN a ELSE b END AS da FROM u)
SELECT o_orderkey, cell, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(s, 1, 10)
  WHEN regexp_matches(s, '^\\d{{4}}[/.]\\d{{1,2}}[/.]\\d{{1,2}}$') THEN array_to_string(list_transform(string_split_regex(s, '[/.]'), lambda x: lpad(x, CAST(greatest(2, length(x)) AS INTEGER), '0')), '-')
  WHEN mo BETWEEN 1 AND 12 AND da BETWEEN 1 AND 31 THEN y || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(da AS VARCHAR), 2, '0')
  ELSE coalesce(strftime(try_strptime(s, '%B %d, %Y'), '%Y-%m-%d'), strftime(try_strptime(s, '%d %b %Y'), '%Y-%m-%d')) END AS iso FROM v""")
oracle("durations_formatted", f"""WITH s AS (SELECT o_orderkey, (({shapes.DURATION_MS}) + 500) // 1000 AS t FROM orders)
SELECT o_orderkey, CASE WHEN t = 0 THEN '0s' ELSE trim(concat(CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' ELSE '' END,
  CASE WHEN t % 3600 >= 60 THEN (t % 3600 // 60) || 'm ' ELSE '' END, CASE WHEN t % 60 > 0 THEN (t % 60) || 's' ELSE '' END)) END AS duration FROM s""")
oracle("message_ids_extracted", f"""WITH p AS (SELECT o_orderkey, trim({shapes.PASTED_LINK}) AS s FROM orders),
c AS (SELECT o_orderkey, CASE WHEN contains(s, '#') THEN split_part(list_last(string_split(list_last(string_split(s, '#')), '/')), '?', 1) ELSE s END AS c FROM p)
SELECT o_orderkey, CASE WHEN regexp_matches(c, '^[A-Za-z0-9_-]+$') THEN c END AS message_id FROM c""")

# --- incremental -----------------------------------------------------------------------------

#: Messages as a dump delivers them: header, receipt time and body are those of the dump.
DELIVERED = f"""derived AS ({derived_sql('messages')}),
dump AS (SELECT *, {shapes.PLAIN_TEXT} AS plain, {shapes.HTML_TEXT} AS html FROM derived),
chosen AS (SELECT *, {select_body('plain', 'html')} AS picked, {strip_html('html')} AS from_html FROM dump),
forms AS (SELECT *, {clean_card('picked')} AS card, {clean_body('picked')} AS flat,
            {clean_body("coalesce(nullif(from_html, ''), picked)")} AS rich FROM chosen),
delivered AS MATERIALIZED (SELECT owner, account, message_id, thread_id, CASE WHEN internal_ms % 11 = 0 THEN '' ELSE subject END AS subject, sender,
  CASE WHEN contains(sender, '{fixed.BOARD_A_SENDER}') THEN card
    WHEN contains(sender, '{fixed.BOARD_B_SENDER}') THEN CASE WHEN {ext('rich', fixed.BOARD_B_SENT_TO)} IS NOT NULL
      THEN 'Employer: ' || {strip(ext('rich', fixed.BOARD_B_SENT_TO))} || chr(10) || chr(10) || rich ELSE rich END
    ELSE flat END AS body, internal_ms AS own_ms, (@SENT@) AS internal_ms,
  CAST(make_timestamp((@SENT@) * 1000) AS DATE) AS msg_date FROM forms)"""


def delivered(as_of_ms: int) -> str:
    sent = SENT.replace("1009843200000", str(as_of_ms))
    return DELIVERED.replace("@SENT@", sent)


def runs(arrival: str, as_of_ms: int = 1009843200000, which: str = "true") -> str:
    """CTEs up to ``ran`` (classified mail with the run that takes it) and ``apps``: the fold, run after run."""
    return f"""{delivered(as_of_ms)},
messages AS MATERIALIZED (SELECT DISTINCT * EXCLUDE (own_ms) FROM delivered WHERE {which}), {OUTPUTS}, {event_ctes()},
ran AS MATERIALIZED (SELECT c.* REPLACE (CAST(is_confirmation AS BOOLEAN) AS is_confirmation, CAST(is_fast_apply AS BOOLEAN) AS is_fast_apply),
  {arrival} AS arrival FROM classified c JOIN (SELECT DISTINCT owner, message_id, own_ms FROM delivered) d USING (owner, message_id)),
merges AS (SELECT * FROM ran WHERE kind = 'merge'),
{fold('merges', RUNS)},
placed AS (SELECT m.*, f.app_id, f.is_new FROM merges m JOIN fold f ON f.owner = m.owner AND f.message_id = m.message_id AND f.n > 0),
joined AS (SELECT *, last_value(arrival) OVER (PARTITION BY owner, app_id {RECENT}
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS noted FROM placed),
apps AS ({rolled('joined', 'owner, app_id', 'app_id', RUNS, RECENT, 'role IS NOT NULL AND arrival <= noted')})"""


BY_YEAR = "CASE WHEN own_ms % 5 = 0 THEN 2 WHEN year(make_timestamp(own_ms * 1000)) < 1997 THEN 0 WHEN year(make_timestamp(own_ms * 1000)) < 1999 THEN 1 ELSE 2 END"
SYNCED = runs(BY_YEAR)
oracle("ledger_after_sync", f"WITH {MESSAGES} SELECT DISTINCT owner, message_id, thread_id FROM messages")
oracle("applications_after_sync", f"WITH RECURSIVE {SYNCED} SELECT {VIEW} FROM apps")
oracle("applications_after_replay", ORACLES["applications_after_sync"])
oracle("sync_totals", f"""WITH RECURSIVE {SYNCED},
run AS (SELECT arrival AS version, count(*) AS processed, count(*) FILTER (WHERE kind = 'skip') AS skipped FROM ran GROUP BY arrival),
came AS (SELECT {BY_YEAR} AS version, count(*) AS arrived FROM delivered GROUP BY 1),
did AS (SELECT arrival AS version, count(*) FILTER (WHERE is_new) AS added, count(*) FILTER (WHERE NOT is_new) AS updated FROM joined GROUP BY arrival)
SELECT CAST(version AS BIGINT) AS version, arrived, CAST(0 AS BIGINT) AS unreadable, processed, added, updated, skipped, CAST(0 AS BIGINT) AS failed,
  CAST(sum(processed) OVER w AS BIGINT) AS total_processed, CAST(sum(added) OVER w AS BIGINT) AS total_added,
  CAST(sum(updated) OVER w AS BIGINT) AS total_updated
FROM run JOIN did USING (version) JOIN came USING (version) WINDOW w AS (ORDER BY version)""")
oracle("blocks_after_sync", f"""WITH RECURSIVE {delivered(1009843200000)}, messages AS MATERIALIZED (SELECT DISTINCT * EXCLUDE (own_ms) FROM delivered), {OUTPUTS}, {event_ctes()},
{BLOCKS.split("RECURSIVE", 1)[1].replace(EVENTS + ",", "").replace("FROM mail", "FROM (SELECT * FROM classified WHERE kind = 'merge') k")},
linked AS (SELECT owner, component FROM components GROUP BY owner, component HAVING count(*) > 1)
SELECT owner, node, component FROM components JOIN linked USING (owner, component)""")
WINDOW_MS = 962323200000  # 2000-06-30
CANDIDATE = f"""own_ms % 23 <> 0 AND {has("subject || chr(10) || body", phrases(fixed.WANTED_PHRASES))} AND NOT {has('subject', phrases(fixed.EXCLUDED_SUBJECTS))}
  AND NOT {has("subject || chr(10) || body", phrases(fixed.EXCLUDED_ANYWHERE))} AND NOT contains(lower(sender), lower(account))
  AND {' AND '.join(f"NOT contains(lower(sender), '{a}')" for a in fixed.EXCLUDED_SENDERS)}"""
WIDE = f"msg_date >= DATE '2000-06-30' - 180 AND {CANDIDATE}"
WIDENED = runs("CASE WHEN msg_date >= DATE '2000-06-30' - 30 THEN 0 ELSE 1 END", WINDOW_MS, WIDE)
oracle("ledger_after_widening", f"WITH RECURSIVE {WIDENED} SELECT owner, message_id, thread_id, category AS classified_as FROM ran")
oracle("applications_after_widening", f"WITH RECURSIVE {WIDENED} SELECT {VIEW} FROM apps")
oracle("applications_rebuilt", f"WITH RECURSIVE {runs('0', WINDOW_MS, WIDE)} SELECT {VIEW} FROM apps")
oracle("unreadable_mail_retried", f"""WITH {MESSAGES}, m AS (SELECT DISTINCT owner, message_id, (length(message_id) + length(thread_id)) % 5 AS pick FROM messages WHERE internal_ms % 5 <> 0),
a AS (SELECT count(*) FILTER (WHERE (length(message_id) + length(thread_id)) % 5 < 2) AS broken FROM messages WHERE internal_ms % 5 <> 0)
SELECT CAST(version AS BIGINT) AS version, count(*) FILTER (WHERE (pick < 2) = (version = 1)) AS processed,
  CASE WHEN version = 0 THEN (SELECT broken FROM a) ELSE 0 END AS failed,
  (SELECT broken FROM a) AS quarantined, (SELECT count(*) FROM m) AS in_ledger FROM m, (VALUES (0), (1)) v(version) GROUP BY version""")
