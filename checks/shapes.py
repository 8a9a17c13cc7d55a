"""SQL expressions that dress up table columns; the same text runs on both engines."""

from __future__ import annotations

ABSENT = "~absent~"
TEXT = {"spark": "STRING", "duckdb": "VARCHAR"}


def cases(selector: str, *values: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {whens} ELSE {otherwise} END"


# --- messages ------------------------------------------------------------------------

CARD_TEXT = (
    "concat(' ', body, '  ', chr(10), chr(10), 'View job: https://jobs.example/view/1?x=2', chr(10), '--------', chr(10),"
    " 'Ask &amp; learn', chr(10), 'Now, take these next steps', chr(10), 'Other Role', chr(10), 'Other Employer')"
)
PLAIN_TEXT = (
    "CASE WHEN sender LIKE '%jobs-noreply%' AND internal_ms % 9 <> 1 THEN " + CARD_TEXT + " ELSE "
    + cases(
        "internal_ms % 9",
        "concat(body, ' If you reply to this email nothing happens. Kind regards')",
        "concat('<% render %> ', body)",
        "''",
        "concat('<p>', body, '</p><style>a{}</style> <B>bye</B>')",
        "concat('RTF Template ', body, ' https://x.example/a?b=1 [3] ====== it&rsquo;s &amp; more. All rights reserved here')",
        "concat('96  ', body, ' - - - - - do not reply to this message, thanks. Connect with our team on LinkedIn')",
        "concat('Copyright (c) 2031 ', body, ' Facebook | Twitter')",
        otherwise="concat(body, ' Replies will not be read by anyone! This message was sent to a@b.example yesterday')",
    ) + " END"
)
HTML_TEXT = (
    "concat('<html><style>p {color: red}</style><body><p class=\"a\">', body,"
    " '</p><script>var a = 1 < 2;</script>&nbsp;<b>end</b></body></html>')"
)
NOISY_SUBJECT = cases(
    "internal_ms % 31",
    "concat('Automatic reply: ', subject)",
    "'Jacobs - Application Update'",
    "'Jacobs - Application Update, Data Engineer'",
    "'12 new jobs for today'",
    "'Your one-time code'",
    "'Your interview has been scheduled'",
    "'Sign in link'",
    "'New job alert'",
    "'Auto: away'",
    "'Re: auto: away'",
    "concat('Reminder about ', subject)",
    otherwise="subject",
)
REQ_SUBJECT = cases(
    "internal_ms % 9",
    "concat(subject, ' - 40927718')",
    "concat(subject, ' Job ID# 2031-0044321')",
    "concat(subject, ' 618204BR')",
    "concat(subject, ' REQ907155')",
    "concat(subject, ' (ID: 5518046)')",
    "concat(subject, ' call 212-555-0100')",
    "concat(subject, ' Grade 8 req 5')",
    otherwise="subject",
)

# --- events ----------------------------------------------------------------------------

LEGAL_NAME = cases(
    "internal_ms % 11",
    "concat(company, ', Inc.')",
    "concat(company, ' LLC')",
    "concat('Old Name, LLC dba ', company)",
    "concat(company, ' - HQ')",
    "concat(company, ' & Co.')",
    "concat('X d/b/a ', company, ' Corp.')",
    "concat(company, ' – Global')",
    "concat(company, ' Company Inc')",
    "concat('  ', company, ' Incorporated ')",
    otherwise="company",
)
RAW_ROLE = cases(
    "internal_ms % 17",
    "concat('R', 800000 + internal_ms % 99999, ' ', role)",
    "concat('2031 ', role)",
    "concat(role, ' {X', internal_ms % 999999, '}')",
    "concat(role, ' [Remote]')",
    "concat(role, ' [', internal_ms % 999999, ']')",
    "concat(role, ' (Req ID: ', internal_ms % 999999, ')')",
    "concat(role, ' (', internal_ms % 999999, 'BR)')",
    "concat(role, ' - 2031-60418')",
    "concat(role, ' R0417326')",
    "concat(role, ' Remote in Marlow')",
    "concat(role, ' - Lake Town, NY')",
    "concat(role, ', Rivertown, TX 75001')",
    "concat(role, ' United States (US)')",
    "concat(role, ' - ,')",
    "concat(role, ' (Remote)')",
    otherwise="role",
)
EVENT_STAGE = (
    "CASE WHEN event_type = 'purchase' AND value > 60 THEN 'offer' WHEN event_type = 'error' AND value > 70"
    " THEN 'rejected' WHEN event_type = 'click' THEN 'interview' ELSE 'applied' END"
)

# --- pages and documents ---------------------------------------------------------------

ENTITY_TEXT = (
    "concat(html, '&nbsp;&amp;lt;b&amp;gt; don&#39;t &#x27;x&#x0027; &#x201C;q&#x201d; &#8217;&#X41; &quot; &hellip; &ZWNJ;',"
    " chr(160), 'joined', chr(173), '&rsquo;')"
)
NOISY_DOCUMENT = cases(
    "doc_id % 7",
    "concat('RTF Template ', text, ' https://x.example/a?b=1 [3] tail')",
    "concat('  96 ', text, ' *---*---*---* please do not respond to this email or call. more')",
    "concat('All rights reserved ', text, ' copyright (c) 2031 rest')",
    "concat('<div>', text, '</div> &amp; tail')",
    "concat(text, ' references   visible links 1 2')",
    "concat(text, ' if you no longer want to receive news')",
    otherwise="text",
)

# --- orders ----------------------------------------------------------------------------

RAW_REQ = cases(
    "o_orderkey % 10",
    "concat('Req ', 50000 + o_orderkey)",
    "concat('# Job Number: ', 70000 + o_orderkey)",
    "concat('REQ', 907000 + o_orderkey)",
    "concat('R_', 514000 + o_orderkey)",
    "'2031'",
    "'see desk 36912 upstairs'",
    "concat(' job id - ref: ', 90000 + o_orderkey, 'BR ')",
    "concat('Requisition#', 40000 + o_orderkey)",
    "'HOFFICE-EU-Hybrid'",
    otherwise="concat('R.', 100000 + o_orderkey)",
)
RAW_REFS = cases(
    "o_orderkey % 7",
    "concat('applied|a', o_orderkey, '|2031-02-01 ; rejected|b', o_orderkey, '|2031-04-02|fast')",
    "concat('applied|a', o_orderkey, ' ; interview|a', o_orderkey, '|2031-03-01')",
    "concat('ignored|a', o_orderkey, '|2031-02-01;offer| b', o_orderkey, ' |2031-02-02|me@mail.example')",
    "'applied||2031-01-01;;offer'",
    "''",
    "concat(' interview | c', o_orderkey, ' | 2031-05-05 | fast ')",
    otherwise="concat('offer|d', o_orderkey, '|')",
)
DELETED_ID = (
    "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('t', o_orderkey)"
    " WHEN o_totalprice > 400000 THEN concat('gone', o_orderkey) END"
)
DURATION_MS = "CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 40) * 3600000 ELSE (o_orderkey * 7919) % 9000000 END"
PASTED_LINK = cases(
    "o_orderkey % 7",
    "concat('https://mail.google.com/mail/u/0/#all/m', o_orderkey)",
    "concat('https://mail.google.com/mail/u/1/#search/q/m', o_orderkey, '?x=1')",
    "concat('  m', o_orderkey, '  ')",
    "concat('not an id ', o_orderkey)",
    "''",
    "concat('https://mail.google.com/#inbox/')",
    otherwise="concat('m-', o_orderkey, '_z')",
)


def date_cell(dialect: str) -> str:
    y, m, d = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
    mm, dd = f"lpad(concat('', {m}), 2, '0')", f"lpad(concat('', {d}), 2, '0')"
    return cases(
        "o_orderkey % 11",
        f"concat({y}, '-', {mm}, '-', {dd}, ' 10:00')",
        f"concat({m}, '/', {d}, '/', {y})",
        f"concat({d}, '/', {m}, '/', {y})",
        f"concat({y}, '/', {m}, '.', {d})",
        "'soon'",
        "'  '",
        f"concat({d}, '.', {m}, '.', {y})",
        f"concat('May ', {d}, ', ', {y})",
        f"concat({d}, ' Aug ', {y})",
        f"concat('45/', {d}, '/', {y})",
        otherwise=f"concat(' ', {mm}, '-', {dd}, '-', {y}, ' ')",
    )


# --- tables ----------------------------------------------------------------------------

STAMP = {
    "spark": "timestampadd(MINUTE, CAST(t % 1000 AS INT), TIMESTAMP '2002-01-01 00:00:00')",
    "duckdb": "(TIMESTAMP '2002-01-01 00:00:00' + to_minutes(t % 1000))",
}


def decorate(apps: str, dialect: str) -> str:
    text = TEXT[dialect]
    return f"""
SELECT owner, app_id, company, role, status,
  CAST(CASE t % 5 WHEN 1 THEN 'technical' WHEN 2 THEN 'onsite' WHEN 3 THEN 'final' WHEN 4 THEN 'phone_screen' END AS {text}) AS interview_step,
  reached_interview, date_applied,
  CASE WHEN t % 29 = 0 THEN NULL ELSE last_activity END AS last_activity, last_activity_ts,
  CAST(CASE WHEN t % 3 = 0 THEN concat('https://jobs.example/', t, '?a="b",c') END AS {text}) AS job_url,
  CAST(CASE WHEN t % 6 = 0 THEN concat('line one', chr(10), 'said "yes", twice') ELSE notes END AS {text}) AS notes,
  notes_source, external_id, t % 11 = 0 AS edited, detected_by, company_domain, awaiting_application, fast_apply,
  confirmed, CAST(CASE WHEN t % 7 = 0 THEN 'csv' ELSE 'gmail' END AS {text}) AS source, thread_id,
  CAST(CASE WHEN t % 4 = 0 THEN NULL WHEN t % 4 = 1 THEN concat('a b+', t, '@mail.example') ELSE account END AS {text}) AS account,
  first_ms, created_at, {STAMP[dialect]} AS updated_at
FROM (SELECT *, CAST(substr(app_id, 2) AS BIGINT) AS t FROM {apps}) numbered"""


def earlier(apps: str, dialect: str) -> str:
    """An older snapshot: offers are missing and interviewed applications had another stamp."""
    return f"""
SELECT owner, app_id, CASE WHEN reached_interview THEN created_at ELSE updated_at END AS updated_at
FROM {apps} WHERE status <> 'offer'"""


def new_rows(orders: str, dialect: str) -> str:
    return f"""
SELECT concat('u', o_custkey) AS owner, concat('n', o_orderkey) AS app_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Employer ', o_custkey) END AS company,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Data Engineer' END AS role,
  CASE o_orderkey % 5 WHEN 0 THEN 'interview' WHEN 1 THEN 'offer' WHEN 2 THEN 'rejected' WHEN 3 THEN 'applied' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'onsite' ELSE '' END AS interview_step,
  o_orderkey % 4 = 0 AS reached_interview,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2001-03-04' END AS date_applied,
  CASE WHEN o_orderkey % 6 = 0 THEN 'junk' WHEN o_orderkey % 6 = 1 THEN NULL ELSE '2001-05-06' END AS last_activity,
  '' AS job_url, CASE WHEN o_orderkey % 2 = 0 THEN 'note' ELSE '' END AS notes, '' AS external_id, '' AS company_domain,
  CASE o_orderkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'gmail' END AS source,
  CASE WHEN o_orderkey % 2 = 0 THEN '  me@mail.example ' ELSE ' ' END AS account,
  concat('applied|n', o_orderkey, '|2001-03-04') AS cell
FROM {orders}"""


def flat_edits(orders: str, dialect: str) -> str:
    text = TEXT[dialect]
    return f"""
SELECT concat('u', CAST(o_custkey AS {text})) AS owner, CAST(CASE WHEN o_orderkey % 10 = 9 THEN concat('gone', o_orderkey) ELSE concat('t', o_orderkey) END AS {text}) AS app_id,
  CAST(CASE o_orderkey % 8 WHEN 0 THEN 'interview' WHEN 1 THEN 'archived' WHEN 2 THEN 'rejected' WHEN 3 THEN 'offer' ELSE '{ABSENT}' END AS {text}) AS e_status,
  CAST(CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'party' WHEN 2 THEN 'final' ELSE '{ABSENT}' END AS {text}) AS e_interview_step,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 'my note' WHEN 1 THEN NULL ELSE '{ABSENT}' END AS {text}) AS e_notes,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 'Chief of Staff' ELSE '{ABSENT}' END AS {text}) AS e_role,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' x@mail.example ' ELSE '{ABSENT}' END AS {text}) AS e_account,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN '2001-07-08' WHEN 1 THEN NULL WHEN 2 THEN 'soon' ELSE '{ABSENT}' END AS {text}) AS e_last_activity
FROM {orders}"""


def sheet_rows(orders: str, dialect: str) -> str:
    return f"""
SELECT concat('u', o_custkey) AS owner, o_orderkey AS position,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Quenby' ELSE concat(' Sheet Co ', o_custkey % 7) END AS company,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Data Engineer' ELSE 'Unknown Role' END AS role,
  CASE WHEN o_orderkey % 3 = 0 THEN ''
       WHEN o_orderkey % 3 = 1 THEN concat('applied|x', o_custkey, '-', o_orderkey % 6, '|2001-01-01')
       ELSE concat('applied|x', o_custkey, '-', o_orderkey % 5, '|2001-01-01 ; rejected|x', o_custkey, '-', o_orderkey % 5 + 1, '|2001-02-01')
  END AS cell
FROM {orders}"""


def board_refs(orders: str) -> str:
    """References already on the board."""
    return f"""
SELECT concat('u', o_custkey) AS owner, concat('x', o_custkey, '-', o_orderkey % 6) AS message_id
FROM {orders} WHERE o_orderstatus = 'P'"""
