"""Patterns run only on texts that hold one of their words, once, and with the same results."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mailfold import fixed
from mailfold.functions import identity, requisition, roles, templates
from mailfold.functions.text import WHITE, WHITE_CHARS, grab, jvm, matches
from mailfold.session import SETTINGS

TEXTS = (
    "Your interview has been SCHEDULED", "12 new jobs for you", "Sign-in link", "One time code", "auto: away",
    "W-2 or corp-to-corp", "we know of a friend", "Jobs alert", "Jacobs - Application Update", "LOG IN LINK",
    "Thank you for applying for the Data Engineer position at Quenby. We'll review it.",
    "Your application to the QA Analyst opening with Brillmark, Inc.", "Apply at Vexmoor", "a career at Ostwell",
    "Thank you for your interest in the Support Lead role at Quenby.", "joining the Corvane team",
    "employment with Norvale in our Product Designer position", "Application to Merrigan - Data Engineer II",
    "We regret to inform you", "It IS filled.", "won't be moving forward", "if there's a match", "no longer hiring",
    "Your application was received and has been submitted", "thanks for submitting", "an UPDATE", "Job No. 2031-44",
    "demographic SURVEY", "following position(s): Data Engineer", "the role of 12345 Data Engineer at X",
    "Req ID: R1234567", "ID# 5518046", "618204BR", "x - 40927718", "İF you ſee KnoK of a friend", "", "  \n", None,
)
PATTERNS = [p for p in fixed.NEEDED_WORDS if isinstance(p, str)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i INT, t STRING")


def test_words_spare_no_match(texts):
    """Every pattern finds with its words what it finds without them."""
    low = F.lower("t")
    got = texts.select(
        "i",
        *[F.struct(matches(F.col("t"), p, low).alias("m"), grab(F.col("t"), p, 0, low).alias("g")).alias(f"a{k}") for k, p in enumerate(PATTERNS)],
        *[F.struct(F.rlike("t", F.lit(jvm(p))).alias("m"), F.nullif(F.regexp_extract("t", jvm(p), 0), F.lit("")).alias("g")).alias(f"b{k}") for k, p in enumerate(PATTERNS)],
    ).collect()
    for row in got:
        for k, pattern in enumerate(PATTERNS):
            assert row[f"a{k}"] == row[f"b{k}"], (TEXTS[row["i"]], pattern)


def test_subject_number_without_body(spark):
    rows = spark.createDataFrame([("x - 40927718", None), (None, "Req 1234567"), ("a", "Req 1234567")], "s STRING, b STRING")
    got = [r[0] for r in rows.select(requisition.extract_requisition(F.col("s"), F.col("b"))).collect()]
    assert got == ["40927718", None, "1234567"]


def test_names_and_titles_keep_their_cleaning(spark):
    rows = spark.createDataFrame([(" Acme, Inc. ", " QA Lead Remote in X "), ("\nX dba Y", "Boss - ,"), ("Plain ", " Plain ")], "c STRING, r STRING")
    got = rows.select(identity.normalize_company(F.col("c")), roles.tidy_role(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("Acme", "QA Lead"), ("X dba Y", "Boss"), ("Plain", "Plain")]


def test_captures_are_scanned_once(texts):
    """A capture's pattern stands once in the plan, not once for its test and once for its value."""
    out = texts.select(F.transform(F.array("t"), lambda t: grab(t, r"(needle)")).alias("g"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract\(", plan)) == 1


def test_company_followed_by_title_noun(spark):
    rows = spark.createDataFrame(
        [("Thank you for your interest in Data Engineer.\tThe Data Engineer\tposition is open",),
         ("Thank you for your interest in Quenby. Quenby writes",)], "b STRING")
    got = [r[0] for r in rows.select(templates.extract_company_role(F.lit("Hello"), F.col("b"))["company"]).collect()]
    assert got == [None, "Quenby"]


def test_mail_queries_run_no_method_too_long_to_compile(spark, tmp_path):
    spark.range(3).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    limit = __spark_entry__.METHOD_LIMIT
    spark.conf.set(limit, "65535")
    try:
        assert __spark_entry__.queries()["requisitions_canonical"](spark, str(tmp_path)).count() == 3
        assert int(spark.conf.get(limit)) <= 8000
    finally:
        spark.conf.set(limit, SETTINGS[limit])


def test_white_space_is_what_trimming_takes(spark):
    """The class by properties holds the very characters that are listed for trimming."""
    codes = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8")
    found = codes.filter(char.rlike(f"^[{WHITE}]$")).collect()
    assert {chr(r.id) for r in found} == set(WHITE_CHARS)
    assert codes.filter(char.rlike(jvm(r"^\S$"))).count() == codes.count() - len(found)
    assert len(WHITE) < len(repr(WHITE_CHARS))
