"""Lifecycle streams: state against a plain fold, timers, late rows, restarts; a model and its errors."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import lifecycle as L

EVENTS = "doc_id long, event_id long, ts timestamp, status string"
START = datetime(2024, 1, 1)


def land(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def event(doc, number, seconds, status):
    return doc, number, START + timedelta(seconds=seconds), status


def states(spark, out):
    return {r.doc_id: (r.status, r.events, r.timed_out) for r in L.last_states(spark, out).collect()}


@pytest.fixture
def place(tmp_path):
    return {n: f"file://{tmp_path}/{n}" for n in ("in", "out", "state")}


def follow(spark, place, **more):
    L.run_timeline(spark, place["in"], spark.createDataFrame([], EVENTS).schema, place["out"], place["state"], **more)


def shuffled_events():
    rng = random.Random(4)
    rows = [event(rng.randrange(9), k, rng.randrange(900), rng.choice(["pending", "processing", "done", "error"])) for k in range(120)]
    want = {}
    for doc in {r[0] for r in rows}:
        mine = sorted((r[2], r[1], r[3]) for r in rows if r[0] == doc)
        newest = max(r[2] for r in rows)
        want[doc] = (mine[-1][2], len(mine), mine[-1][2] not in L.FINAL and (newest - mine[0][0]).total_seconds() > L.WAIT_S)
    twice = rows + rng.sample(rows, 40)
    rng.shuffle(twice)
    return twice, want


def test_timeline_restarts(spark, place):
    """Shuffled and repeated events, a crash after a batch was stored but not committed, and a restart."""
    rows, want = shuffled_events()
    for k in range(0, len(rows), 40):
        land(spark, place["in"], rows[k : k + 40])

    def crash(number):
        if number == 1:
            raise RuntimeError("the driver is gone")

    with pytest.raises(Exception, match="the driver is gone"):
        follow(spark, place, late="2 hours", written=crash)
    follow(spark, place, late="2 hours")
    assert {d: s[:2] for d, s in states(spark, place["out"]).items()} == {d: s[:2] for d, s in want.items()}
    newest = max((r[2] for r in rows)) - START
    land(spark, place["in"], [event(-1, -1, newest.total_seconds() + 7200, "done")])
    follow(spark, place, late="2 hours")
    assert {d: s for d, s in states(spark, place["out"]).items() if d >= 0} == want


def test_timer_and_late_rows(spark, place):
    land(spark, place["in"], [event(1, 1, 0, "pending"), event(2, 2, 0, "pending"), event(3, 3, 0, "pending"), event(3, 4, 5, "done")])
    follow(spark, place, late="10 seconds")
    assert states(spark, place["out"]) == {1: ("pending", 1, False), 2: ("pending", 1, False), 3: ("done", 2, False)}
    land(spark, place["in"], [event(9, 5, 400, "pending")])  # the watermark goes to 390 s
    follow(spark, place, late="10 seconds")
    assert states(spark, place["out"]) == {1: ("pending", 1, True), 2: ("pending", 1, True), 3: ("done", 2, False), 9: ("pending", 1, False)}
    land(spark, place["in"], [event(1, 6, 30, "done"), event(2, 7, 395, "done"), event(9, 8, 399, "processing")])
    follow(spark, place, late="10 seconds")
    # the first came too late and is dropped; the second takes the time-out back; the third is older than what is known
    assert states(spark, place["out"]) == {1: ("pending", 1, True), 2: ("done", 2, False), 3: ("done", 2, False), 9: ("pending", 2, False)}


def test_classifier_stream(spark, tmp_path):
    docs = spark.createDataFrame([("zzzz", "invoice"), ("zz zz", "invoice"), ("aaaa", "email"), ("a a a", "email"), (None, "email")], "text string, label string")
    path, source, log, state = (f"file://{tmp_path}/{n}" for n in ("model", "in", "log", "state"))
    L.train_classifier(docs, path)
    rows = [(1, b"zz za"), (2, b"aaz"), (3, b"\xff zz"), (4, None), (5, b" \n"), (6, "aaé".encode())]
    uploads = spark.createDataFrame(rows, "doc_id long, content binary")
    uploads.repartition(3, "doc_id").write.parquet(source)
    L.classify_stream(spark, source, uploads.schema, log, state, path, per_batch=1)
    got = {r.doc_id: (r.predicted_label, r.error, r.status, r.entries) for r in L.current(spark, log).collect()}
    assert got == {1: ("invoice", None, "processing", 2), 2: ("email", None, "done", 2), 3: (None, "UnicodeDecodeError", "error", 2), 4: (None, "FileNotFoundError", "error", 2), 5: (None, "ValueError", "error", 2), 6: ("email", None, "done", 2)}
    L.classify_stream(spark, source, uploads.schema, log, state, path)  # nothing new
    assert L.current(spark, log).agg(F.sum("entries")).first()[0] == 12


def test_processing_comes_first(spark, tmp_path):
    """A batch that stops while it classifies leaves its documents in processing, and is taken up again."""
    path, source, log, state = (f"file://{tmp_path}/{n}" for n in ("model", "in", "log", "state"))
    L.train_classifier(spark.createDataFrame([("zz", "invoice"), ("aa", "email")], "text string, label string"), path)
    uploads = spark.createDataFrame([(1, b"zz"), (2, b"aa")], "doc_id long, content binary")
    uploads.coalesce(1).write.parquet(source)

    class Killed(BaseException):
        pass

    def stops(content):
        raise Killed("worker lost")

    with pytest.raises(Exception, match="worker lost"):
        L.classify_stream(spark, source, uploads.schema, log, state, path, reader=stops)
    assert {r.status for r in spark.read.parquet(f"{log}/batch=0/step=0").collect()} == {"processing"}
    L.classify_stream(spark, source, uploads.schema, log, state, path)
    assert {(r.doc_id, r.status, r.entries) for r in L.current(spark, log).collect()} == {(1, "processing", 2), (2, "done", 2)}
