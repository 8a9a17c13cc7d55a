"""Mail archives derived from the order tables.

The benchmark tables hold no mail, so orders and their lines are read as one: a customer
is a mailbox owner, an order a thread, a line a message.  The SQL text is shared by Spark
and by the checking engine; three date expressions are the only difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {
        "order_day": "unix_date(CAST(o_orderdate AS DATE))",
        "day": "date_from_unix_date(CAST(floor(internal_ms / 86400000) AS INT))",
        "text": "STRING",
    },
    "duckdb": {
        "order_day": "(CAST(o_orderdate AS DATE) - DATE '1970-01-01')",
        "day": "(DATE '1970-01-01' + CAST(floor(internal_ms / 86400000) AS INTEGER))",
        "text": "VARCHAR",
    },
}

STEMS = (
    "Brillmark|Ostwell|Quenby|Tarnholt|Vexmoor|Lunaria|Pellwick|Dunmarsh|Corvane|Hathersby"
    "|Ironpeak|Sablewood|Merrigan|Norvale|Zephrin|Kestrix|Oakhallow|Farrowby|Thistlecom|Wendlow"
)
TITLES = (
    "Data Engineer|Software Engineer|Full Stack Developer|Data Engineer II|Software Engineer (Backend)"
    "|Full Stack Developer - Payments|QA Analyst|Support Lead|Product Designer|Site Reliability Engineer"
    "|Business Analyst|Android Developer"
)
CITIES = "Springfield|Rivertown|Lakeside|Hillcrest"


def base_sql(dialect: str, orders: str = "orders", lineitem: str = "lineitem") -> str:
    """One row per message with the facts every text is built from.

    Message ids join order, line, part and supplier, so they need no ranking over an
    order's lines; ``kind`` picks the text shape and follows the line number, so early
    lines of an order tend to be applications and later ones outcomes.
    """
    d = DIALECTS[dialect]
    text = d["text"]

    def pick(words: str, index: str) -> str:
        return f"split_part('{words}', '|', CAST({index} AS INT))"

    return f"""
SELECT *,
  CASE WHEN variant = 0 THEN brand
       WHEN variant = 1 THEN concat(brand, ', Inc.')
       WHEN variant = 2 THEN concat(brand, ' Technologies')
       WHEN variant = 3 THEN concat(brand, ' Kids')
       WHEN variant = 4 THEN concat(other_stem, ' Works')
       ELSE concat(brand, ' Health Group') END AS company_text,
  CASE WHEN variant = 1 THEN brand
       WHEN variant = 0 THEN brand
       WHEN variant = 2 THEN concat(brand, ' Technologies')
       WHEN variant = 3 THEN concat(brand, ' Kids')
       WHEN variant = 4 THEN concat(other_stem, ' Works')
       ELSE concat(brand, ' Health Group') END AS company_name
FROM (
  SELECT *,
    CASE WHEN employer % 20 = 7 THEN concat(stem, ' & Sons') ELSE stem END AS brand,
    (day_no * CAST(86400000 AS BIGINT)) + CAST(28800000 AS BIGINT)
      + (pk * CAST(7919 AS BIGINT)) % CAST(36000000 AS BIGINT) AS internal_ms
  FROM (
    SELECT *,
      {pick(STEMS, 'employer % 20 + 1')} AS stem,
      {pick(STEMS, '(employer + 7) % 20 + 1')} AS other_stem,
      {pick(TITLES, '(ok + (ck % 3)) % 12 + 1')} AS title,
      {pick(CITIES, 'pk % 4 + 1')} AS city,
      CASE WHEN (ck + ln) % 11 = 0 THEN 4
           WHEN (ok + ln) % 6 = 0 THEN 1
           WHEN (ok + ln) % 13 = 1 THEN 2
           WHEN ok % 17 = 3 THEN 3
           WHEN (ok + ln) % 19 = 2 THEN 5
           ELSE 0 END AS variant,
      CASE WHEN ok % 4 = 0 THEN concat('R', CAST(1000000 + ok % 900000 AS {text})) END AS req,
      {d['order_day']} + (ln - 1) * (ok % 7) AS day_no,
      CASE WHEN ln <= 3 THEN CAST(substr('000102030405060708111722',
                                         CAST((ok * 5 + ln * 3 + pk) % 12 * 2 + 1 AS INT), 2) AS INT)
           ELSE (ok * 5 + ln * 3 + pk) % 24 END AS kind
    FROM (
      SELECT o_orderkey AS ok, o_custkey AS ck, o_orderdate,
             CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk,
             (o_custkey * 7 + (o_orderkey % 3) * 11) % 120 AS employer
      FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
    ) lines
  ) named
) timed"""


MESSAGE_FIELDS = """
  concat('u', CAST(ck AS {text})) AS owner,
  concat('user', CAST(ck AS {text}), '@mail.example') AS account,
  concat('m', CAST(ok AS {text}), '-', CAST(ln AS {text}), '-', CAST(pk AS {text}), '-', CAST(sk AS {text})) AS message_id,
  concat('t', CAST(ok AS {text})) AS thread_id,
  internal_ms,
  {day} AS msg_date"""


def _fields(dialect: str) -> str:
    return MESSAGE_FIELDS.format(**DIALECTS[dialect])


def messages_sql(dialect: str, base: str) -> str:
    """Subject, sender and already cleaned body for every message."""
    text = DIALECTS[dialect]["text"]
    return f"""
SELECT {_fields(dialect)},
  CAST(CASE kind
    WHEN 0 THEN concat('Ana, your application was sent to ', company_text, ' Page')
    WHEN 1 THEN concat('Your application to ', title, ' at ', company_text)
    WHEN 2 THEN concat('Indeed Application: ', title)
    WHEN 3 THEN 'Application received'
    WHEN 4 THEN 'Your application'
    WHEN 5 THEN 'Update on your application'
    WHEN 6 THEN concat('Thanks for applying to ', company_text)
    WHEN 8 THEN concat('Your application to ', company_text, ' - ', title)
    WHEN 12 THEN 'Interview request'
    WHEN 13 THEN 'Your job offer'
    WHEN 14 THEN 'Your verification code'
    WHEN 16 THEN 'Invitation to a call'
    WHEN 17 THEN 'Application update'
    WHEN 18 THEN 'Demographic questions'
    WHEN 20 THEN concat('Thanks for applying to ', title)
    WHEN 22 THEN concat('Job Application: Ana - ', CAST(10000 + pk AS {text}), ' ', title, ' on 3 May')
    WHEN 23 THEN concat('Ana, your application was sent to ', company_text, ' Page')
    ELSE concat('Your application with ', company_text) END AS {text}) AS subject,
  CAST(CASE
    WHEN kind IN (0, 1, 23) THEN 'Board <jobs-noreply@linkedin.com>'
    WHEN kind = 2 THEN 'Board B <indeedapply@indeed.com>'
    WHEN kind = 16 THEN 'Calls <no-reply@calendly.example>'
    WHEN kind = 19 THEN 'HackerRank <support@hackerrankforwork.com>'
    WHEN (ok + ln) % 4 = 0 THEN concat(stem, ' <no-reply@us.greenhouse-mail.io>')
    WHEN (ok + ln) % 4 = 1 THEN concat('"', stem, ' Talent" <careers@mail.', lower(stem), '.co.uk>')
    WHEN (ok + ln) % 4 = 2 THEN concat('talent.icims.eu ', lower(stem), '@talent.icims.eu')
    ELSE concat(stem, ' <Jobs@', stem, '.example>') END AS {text}) AS sender,
  CAST(CASE kind
    WHEN 0 THEN concat('Your application was sent to ', company_text, ' Page', chr(10), title, chr(10),
                       company_text, chr(10), city, chr(10), 'Applied on May 3')
    WHEN 1 THEN concat('Your update from ', company_text, '. Thank you for your interest.')
    WHEN 2 THEN concat('Employer: ', company_text, chr(10), chr(10), 'The following items were sent to ',
                       company_text, '. Good luck!')
    WHEN 3 THEN concat('Thank you for applying for the ', title, ' position at ', company_text,
                       '. We have received your application and we will review it soon.')
    WHEN 4 THEN concat('We received your application to the ', title, ' opening with ', company_text,
                       '. Our team will be in touch. Req ID: ', coalesce(req, 'pending'))
    WHEN 5 THEN concat('Thank you for your interest in the ', title, ' role at ', company_text,
                       '. We regret to inform you that we chose other candidates.')
    WHEN 6 THEN 'We have received your application. If you are not selected, we keep your profile.'
    WHEN 7 THEN concat('Thank you for considering employment with ', company_text, ' in our ', title,
                       ' position. Your application is under review.')
    WHEN 8 THEN concat('You can follow the status of your application online. Job Number: ',
                       CAST(200000 + ok % 700000 AS {text}))
    WHEN 9 THEN concat('Thank you for your interest in joining the ', company_text,
                       ' team! Unfortunately the ', title, ' role has been filled.')
    WHEN 10 THEN concat('You asked about a career at ', company_text, '. We will review your profile for the ',
                        title, ' opening.')
    WHEN 11 THEN concat('Thank you for your interest in ', company_text,
                        '. Your application has been submitted (ID: ', CAST(3000000 + ok % 900000 AS {text}), ').')
    WHEN 12 THEN concat('We would like to schedule your interview with ', company_text, '. Pick a time.')
    WHEN 13 THEN concat('Welcome aboard! Your offer letter from ', company_text, ' is attached.')
    WHEN 14 THEN 'Enter 445566 to continue.'
    WHEN 15 THEN concat('We have a contract role. Ask about our referral bonus for the ', title, ' role.')
    WHEN 16 THEN 'Choose a slot.'
    WHEN 17 THEN concat('Your application to the ', title, ' role at ', company_text, ' is under review.')
    WHEN 18 THEN concat('Please fill in this survey for ', company_text, '.')
    WHEN 19 THEN concat(company_text, ' invites you to a coding test.')
    WHEN 20 THEN concat('Thank you for your interest. The ', title, ' position is under review.')
    WHEN 21 THEN concat('Thanks. If other candidates are selected at ', company_text,
                        ' we will get back to you about your interest in ', company_text, '.')
    WHEN 22 THEN concat('Your interest in ', company_text, ' was noted. It concerns the following position: ',
                        title, '. Your application was received.')
    WHEN 23 THEN concat('Your application was sent to ', company_text, ' Page', chr(10), title, chr(10),
                        'Old Name, LLC dba ', company_text, ' - HQ', chr(10), city)
    ELSE '' END AS {text}) AS body
FROM ({base}) base"""


def outputs_sql(dialect: str, base: str) -> str:
    """Raw answers of an offline model for the messages the templates leave open."""
    text = DIALECTS[dialect]["text"]
    return f"""
SELECT message_id, CAST(CASE
    WHEN kind = 12 THEN concat('{{"category":"interview","company":"', company_text, '","role":', quoted_title,
                               ',"req_id":null}}')
    WHEN kind = 13 THEN concat('```json', chr(10), '{{"category":"offer","company":"', company_text, '","role":',
                               quoted_title, ',"req_id":"Job Req ', CAST(50000 + ok % 40000 AS {text}), '"}}',
                               chr(10), '```', ' (sure)')
    WHEN kind = 18 THEN '{{"category":"ignored","company":null,"role":null,"req_id":null}}'
    WHEN kind = 19 AND ok % 3 = 0 THEN '{{"category":"interview","company":"HackerRank","role":null,"req_id":null}}'
    WHEN kind = 19 THEN '{{"category":"interview","company":'
    WHEN kind = 20 THEN concat('{{"category":"applied","company":"', company_text, '","role":"', title, ' - R',
                               CAST(70000 + ok % 20000 AS {text}), '","req_id":', CAST(70000 + ok % 20000 AS {text}), '}}')
    WHEN kind = 21 THEN '{{"category":"applied","company":17,"role":"","req_id":"II"}}'
    WHEN kind = 17 THEN '{{"category":"maybe","company":null,"role":null,"req_id":null}}'
    ELSE concat('{{"category":"applied","company":null,"role":', quoted_title, ',"req_id":"#', coalesce(req, '12'), '"}}')
    END AS {text}) AS raw_text
FROM (
  SELECT {_fields(dialect)}, kind, ok, company_text, title, req,
    CASE WHEN ok % 5 = 0 THEN 'null' ELSE concat('"', title, '"') END AS quoted_title
  FROM ({base}) base WHERE kind IN (6, 11, 12, 13, 17, 18, 19, 20, 21)
) asked"""


def events_sql(dialect: str, base: str) -> str:
    """Classified events stated directly from the facts, for the matching operators.

    Titles are missing on some shapes, requisition numbers on most, and the sender's
    domain on everything that goes through a shared host.
    """
    text = DIALECTS[dialect]["text"]
    return f"""
SELECT {_fields(dialect)},
  CAST(concat('Subject of ', company_name) AS {text}) AS subject,
  CAST('merge' AS {text}) AS kind,
  CAST(CASE WHEN kind IN (1, 5, 9) THEN 'rejected' WHEN kind IN (12, 16, 19) THEN 'interview'
       WHEN kind = 13 THEN 'offer' ELSE 'applied' END AS {text}) AS category,
  CAST(company_name AS {text}) AS company,
  CAST(CASE WHEN kind IN (6, 11, 16, 19) THEN NULL ELSE title END AS {text}) AS role,
  CAST(CASE WHEN kind IN (3, 4, 5, 11) THEN req END AS {text}) AS external_id,
  CAST(CASE WHEN kind IN (0, 1, 2, 23) THEN NULL WHEN (ok + ln) % 4 IN (1, 3) THEN concat(lower(stem), '.example')
       END AS {text}) AS company_domain,
  kind NOT IN (1, 5, 9, 12, 13, 16, 17, 19) AS is_confirmation,
  kind IN (0, 2, 23) AS is_fast_apply,
  CAST(CASE WHEN kind IN (12, 13, 18, 20) THEN 'llm' ELSE 'parser' END AS {text}) AS detected_by,
  CAST(CASE WHEN kind IN (0, 23) THEN 'linkedin_applied' WHEN kind = 1 THEN 'linkedin_rejected'
       WHEN kind = 2 THEN 'indeed_applied' WHEN kind IN (12, 13, 18, 20) THEN NULL
       ELSE 'general_template' END AS {text}) AS classifier_code
FROM ({base}) base
WHERE kind NOT IN (14, 15)"""


BUILDERS = {"messages": messages_sql, "outputs": outputs_sql, "events": events_sql}


COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in COLUMNS:
        df = df.select(*COLUMNS[name])
    return df


def derive(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """``messages``, ``outputs`` or ``events`` from the tables under ``sf_dir``.

    The four narrow key columns of the lines are spread over all tasks before any text is made:
    a file has as many tasks as row groups, and the text of a line is many times its keys.
    """
    frames = {name: table(spark, sf_dir, name) for name in ("orders", "lineitem")}
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames["lineitem"] = frames["lineitem"].repartition(width, "l_orderkey")
    base = base_sql("spark", "{orders}", "{lineitem}")
    text = BUILDERS[what]("spark", "@base@").replace("{", "{{").replace("}", "}}").replace("@base@", base)
    return spark.sql(text, **frames)


def derived_sql(what: str) -> str:
    """The same relation for the checking engine."""
    return BUILDERS[what]("duckdb", base_sql("duckdb"))
