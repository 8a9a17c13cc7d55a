"""Golden tables of the scalar operators; every value is invented."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailfold import schemas
from mailfold.functions import identity, refs, requisition, roles, templates
from mailfold.operators import classify, edits, reports, select
from mailfold.sources.messages import project_messages, split_corrupt


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("Job Req 81234", "81234"), ("R_812345", "R_812345"), ("2031", None), ("II", None), ("Level 3", None),
])
def test_canonical_requisition(spark, raw, want):
    assert one(spark, requisition.canonical_requisition, raw) == want


@pytest.mark.parametrize("subject, want", [
    ("Your application, Req 81234", "81234"), ("Analyst REQ812345", "REQ812345"), ("call 212-555-0199", None), ("Level 3", None),
])
def test_extract_requisition(spark, subject, want):
    assert one(spark, requisition.extract_requisition, subject, "") == want


@pytest.mark.parametrize("raw, want", [
    ("R812345 Data Engineer", "Data Engineer"), ("Analyst {X812345}", "Analyst"), ("Analyst [Remote]", "Analyst [Remote]"),
    ("2031 Graduate Analysts", "2031 Graduate Analysts"), ("3D Artist", "3D Artist"),
])
def test_tidy_role(spark, raw, want):
    assert one(spark, roles.tidy_role, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("Contoso, Inc.", "Contoso"), ("Foo & Co.", "Foo & Co."), ("Old Name, LLC dba Newname", "Newname"), ("Adatum - HQ", "Adatum"),
])
def test_normalize_company(spark, raw, want):
    assert one(spark, identity.normalize_company, raw) == want


@pytest.mark.parametrize("sender, want", [
    ("x@careers.contoso.com", "contoso.com"), ("x@jobs.fabrikam.co.uk", "fabrikam.co.uk"), ("nobody", None),
])
def test_company_domain(spark, sender, want):
    assert one(spark, identity.company_domain, sender) == want


@pytest.mark.parametrize("a, b, want", [
    ("Contoso", "Contoso Technologies", True), ("Contoso", "Contoso Kids", False), ("Lila", "Lilac", False), ("", "Contoso", False),
])
def test_same_entity(spark, a, b, want):
    assert one(spark, identity.same_entity, a, b) is want


@pytest.mark.parametrize("ms, want", [("0", "0s"), ("60000", "1m"), ("3661000", "1h 1m 1s"), ("500", "1s")])
def test_format_duration(spark, ms, want):
    assert one(spark, lambda c: refs.format_duration(c.cast("bigint")), ms) == want


@pytest.mark.parametrize("cell, want", [
    ("2031-05-01", "2031-05-01"), ("5/1/2031", "2031-05-01"), ("25/12/2031", "2031-12-25"), ("May 1, 2031", "2031-05-01"), ("junk", None),
])
def test_iso_date(spark, cell, want):
    assert one(spark, refs.iso_date, cell) == want


def test_signals_of_a_rejection_and_a_receipt(spark):
    body = "Thank you for your interest. We have decided to move forward with other candidates."
    assert one(spark, templates.general_status, body) == "rejected"
    assert one(spark, templates.looks_update, "Update on your application") is True


def test_noise_by_subject(spark):
    rows = [("m1", "Your verification code", "a@b.example", "x"), ("m2", "Your interview with Tailspin", "a@b.example", "hello")]
    frame = spark.createDataFrame(rows, "message_id string, subject string, sender string, body string")
    assert [r.message_id for r in select.drop_noise(frame).collect()] == ["m2"]


def test_scan_window_has_no_upper_bound(spark):
    frame = spark.createDataFrame([("early", dt.date(2031, 1, 1)), ("late", dt.date(2031, 12, 1))], "message_id string, msg_date date")
    assert [r.message_id for r in select.in_window(frame, 30, dt.date(2031, 6, 1)).collect()] == ["late"]


def test_locale_order_of_the_table(spark):
    rows = [("u", f"a{i}", company, "Analyst", dt.datetime(2031, 1, 1)) for i, company in enumerate(["Zeta", "Éclair", "eagle", "Ärger"])]
    frame = spark.createDataFrame(rows, "owner string, app_id string, company string, role string, updated_at timestamp")
    order = lambda collation: [r.company for r in reports.table_sort(frame, "company", False, collation).orderBy("rank").collect()]
    assert order("UNICODE_CI") == ["Ärger", "eagle", "Éclair", "Zeta"]
    assert order(None) == ["Zeta", "eagle", "Ärger", "Éclair"]


def test_edits_know_their_owner_and_contradictions_are_refused(spark):
    apps = spark.createDataFrame([], schemas.APPLICATIONS)
    row = {f.name: None for f in apps.schema} | {"app_id": "app-1", "company": "Contoso", "status": "applied", "edited": False, "reached_interview": False}
    apps = spark.createDataFrame([row | {"owner": "u"}, row | {"owner": "v"}, row | {"owner": "u", "app_id": "app-2"}], apps.schema)
    schema = schemas.EDITS
    asked = [("u", "app-1", {"role": "Analyst"}, None), ("u", "app-2", {"role": "A"}, None), ("u", "app-2", {"role": "B"}, None),
             ("w", "app-1", {"role": "C"}, None), ("v", "app-1", {"status": "archived"}, None)]
    after, refused = edits.apply_edits(apps, spark.createDataFrame(asked, schema), dt.datetime(2031, 1, 1))
    assert {(r.owner, r.app_id): r.role for r in after.collect()} == {("u", "app-1"): "Analyst", ("v", "app-1"): None, ("u", "app-2"): None}
    assert sorted((r.owner, r.reason) for r in refused.collect()) == [
        ("u", "several edits of one application")] * 2 + [("v", "invalid status"), ("w", "not found")]
    replaced = [("u", "app-1", {}, [("m9", "applied", "2031-02-01", False)])]
    old = spark.createDataFrame([("u", "app-1", 0, "m1", "applied", "2031-01-01", False), ("v", "app-1", 0, "m2", "applied", "2031-01-01", False)], schemas.REFS)
    left = edits.apply_ref_edits(old, spark.createDataFrame(replaced, schema), apps)
    assert sorted((r.owner, r.message_id) for r in left.collect()) == [("u", "m9"), ("v", "m2")]


def test_model_answers_stay_with_their_owner(spark):
    rows = [("u", "m1", "s", "subject", "body of u"), ("v", "m1", "s", "subject", "body of v")]
    mail = spark.createDataFrame(rows, "owner string, message_id string, sender string, subject string, body string")
    answer = lambda asked: ['{"category": "applied", "company": "%s"}' % body[-1].upper() for _, _, body in asked]
    parsed = classify.parse_model_outputs(classify.run_model(mail, answer)).collect()
    assert sorted((r.owner, r.model.company) for r in parsed) == [("u", "U"), ("v", "V")]


def test_unreadable_rows_go_to_quarantine(spark):
    fields = "id string, thread_id string, internal_date string, account string, owner string, mailbox_category string"
    schema = f"{fields}, headers array<struct<name:string,value:string>>, parts array<struct<path:string,mime_type:string,data:string>>"
    rows = [(i, "t", when, "a", "u", None, [], []) for i, when in (("m1", "1900000000000"), ("m2", "soon"), (None, "1900000000000"), ("m3", None))]
    good, bad = split_corrupt(spark.createDataFrame(rows, schema))
    assert sorted(r.id for r in good.collect()) == ["m1", "m3"] and bad.count() == 2
    dated = {r.message_id: r.msg_date for r in project_messages(good, dt.datetime(2031, 1, 1)).collect()}
    assert dated["m3"] == dt.date(2031, 1, 1) and None not in dated.values()
