"""Runs over landed mail, commits of two writers, merged labels, and the joins below them; all values are invented."""

import datetime as dt
import json
import random
import re

import pytest

from mailfold import schemas
from mailfold.operators.blocks import connected_components, employer_blocks, merged_labels
from mailfold.operators.edits import settle_chain
from mailfold.operators.titles import containing_titles
from mailfold.session import create_file
from mailfold.sources.messages import read_messages
from mailfold.sources.snapshots import TABLES, Board, CommitConflict
from mailfold.streaming.landing import Landing
from mailfold.streaming.sync import sync_batch, sync_landed

AS_OF = dt.datetime(2031, 6, 30)


def dump(path, name, mails):
    """A dump of (id, owner, days before AS_OF, subject, body)."""
    import base64

    lines = []
    for mail_id, owner, age, subject, body in mails:
        ms = int((AS_OF - dt.timedelta(days=age)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        lines.append(json.dumps({
            "id": mail_id, "thread_id": f"t{mail_id}", "internal_date": str(ms), "account": f"{owner}@mail.example", "owner": owner,
            "headers": [{"name": "Subject", "value": subject}, {"name": "From", "value": "Quenby <jobs@quenby.example>"}],
            "parts": [{"path": "0", "mime_type": "text/plain", "data": base64.urlsafe_b64encode(body.encode()).decode()}]}))
    (path / name).write_text("\n".join(lines))
    return str(path / name)


APPLIED = ("Your application with Quenby", "Thank you for applying for the Analyst position at Quenby. We have received your application and we will review it soon.")


def ids(board):
    return sorted((r.owner, r.message_id) for r in board.ledger().select("owner", "message_id").collect())


def test_a_wider_window_finds_mail_that_landed_before_it(spark, tmp_path):
    board = Board(spark, str(tmp_path / "board"))
    raw = read_messages(spark, dump(tmp_path, "in.json", [("new", "u", 3, *APPLIED), ("old", "u", 100, *APPLIED), ("noise", "u", 2, "Lunch", "At noon?")]))
    sync_batch(board, raw, AS_OF, 30, batch="one")
    assert ids(board) == [("u", "new")]
    counters = sync_landed(board, AS_OF, 180, batch="two").first()
    assert ids(board) == [("u", "new"), ("u", "old")] and (counters.processed, counters.skipped) == (1, 1)
    assert sync_landed(board, AS_OF, 180, batch="two") is None
    assert sync_landed(board, AS_OF, 180, batch="three").first().processed == 0


def test_the_earliest_of_several_copies_is_taken_once(spark, tmp_path):
    board = Board(spark, str(tmp_path / "board"))
    for name in ("a", "b"):
        path = dump(tmp_path, f"{name}.json", [("m", "u", 5, *APPLIED), ("m", "u", 5, *APPLIED), ("m", "v", 4, *APPLIED)])
        sync_batch(board, read_messages(spark, path), AS_OF, 30, batch=name)
    assert ids(board) == [("u", "m"), ("v", "m")] and Landing(spark, board.root).mail().count() == 6


class Rival(Board):
    """Another writer commits between this board's look at the head and its own commit."""

    rivals = 1

    def _publish(self, *args):
        if self.rivals:
            self.rivals -= 1
            empty = {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
            Board(self.spark, self.root).commit(empty["applications"], empty["refs"], empty["ledger"], AS_OF, blocks=empty["blocks"])
        super()._publish(*args)


def test_of_two_writers_one_starts_again(spark, tmp_path):
    board = Rival(spark, str(tmp_path / "board"))
    raw = read_messages(spark, dump(tmp_path, "in.json", [("m", "u", 3, *APPLIED)]))
    sync_batch(board, raw, AS_OF, batch="one", select=False)
    assert [c["version"] for c in board.log()] == [0, 1] and ids(board) == [("u", "m")]
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    with pytest.raises(CommitConflict):
        board.commit(empty["applications"], empty["refs"], empty["ledger"], AS_OF, blocks=empty["blocks"], after=0)
    assert board.head() == 1


def test_a_marker_is_written_once(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    assert create_file(spark, path, "first") and not create_file(spark, path, "second")
    assert (tmp_path / "log/1.json").read_text() == "first" and not list((tmp_path / "log").glob("*.draft"))


def test_a_run_reads_the_buckets_of_its_owners(spark, tmp_path):
    board = Board(spark, str(tmp_path / "board"))
    rows = [(f"u{i}", f"m{i}", "t", "applied", AS_OF) for i in range(200)]
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    board.commit(empty["applications"], empty["refs"], spark.createDataFrame(rows, schemas.LEDGER), AS_OF, blocks=empty["blocks"])
    seen = board.ledger(spark.createDataFrame([("u7",), ("u8",)], "owner STRING"))
    assert {r.message_id for r in seen.collect()} == {"m7", "m8"}
    plan = lambda df: df._jdf.queryExecution().simpleString()
    buckets = {int(b) for b in re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN \(|= )([\d,]+)", plan(seen))[1].split(",")}
    assert 1 <= len(buckets) <= 2 and "PartitionFilters: []" in plan(board.ledger())


def test_labels_merged_run_by_run_equal_labels_made_at_once(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(3)}", rng.choice(["Quenby", "Quenby Group", "Ostwell", "Vexmoor", "Pellwick", "Dunmarsh"]),
             rng.choice([None, None, "a.example", "b.example", "c.example", "d.example"])) for _ in range(60)]
    schema = "owner STRING, company STRING, company_domain STRING"
    known = spark.createDataFrame([], schemas.BLOCKS)
    for k in range(0, 60, 12):
        now = merged_labels(known, spark.createDataFrame(rows[k:k + 12], schema))
        kept = known.join(now, ["owner", "node"], "left_anti").unionByName(now)
        known = spark.createDataFrame([tuple(r) for r in kept.collect()], schemas.BLOCKS)
    whole = {(r.owner, r.node): r.component for r in employer_blocks(spark.createDataFrame(rows, schema)).collect()}
    got = {(r.owner, r.node): r.component for r in known.collect()}
    assert {k: v for k, v in got.items() if k in whole} == whole
    assert all(v == k[1] for k, v in got.items() if k not in whole)


def test_components_without_links_take_no_rounds(spark):
    edges = spark.createDataFrame([("u", "a", "a"), ("u", "b", "b")], "owner STRING, u STRING, v STRING")
    assert sorted((r.node, r.component) for r in connected_components(edges).collect()) == [("a", "a"), ("b", "b")]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_containing_titles_equal_all_pairs(spark, width):
    rng = random.Random(width)
    rows = {(rng.choice("xy"), "".join(rng.choice("abé") for _ in range(rng.randrange(9)))) for _ in range(120)} | {("x", None), ("x", "")}
    found = containing_titles(spark.createDataFrame(list(rows), "g STRING, title STRING"), ["g"], width).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {(r.g, r.part, r.title) for r in found} == {(g, a, b) for g, a in rows if a for h, b in rows if b and g == h and a in b}


def test_a_long_chain_of_copies_is_walked_in_order(spark):
    rng = random.Random(4)
    rows = [("u", p, [f"i{p}", f"i{p + 1}"]) for p in range(400)] + [("v", p, [f"i{rng.randrange(40)}" for _ in range(2)]) for p in range(80)]
    rows += [("w", 5, ["only"]), ("w", 6, ["more"])]
    long = [(o, p, i) for o, p, ids_ in rows for i in dict.fromkeys(ids_)]
    want, taken = set(), set()
    for owner, place, own in sorted(rows):
        if taken.isdisjoint((owner, i) for i in own):
            want.add((owner, place))
            taken |= {(owner, i) for i in own}
    got = settle_chain(spark.createDataFrame(long, "owner STRING, position BIGINT, id STRING")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
