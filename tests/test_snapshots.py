"""Stored tables: failures before the manifest, replays, tables that move together, and writers at once."""

import pytest
from pyspark.sql import functions as F

from paperloom.sources.snapshots import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store", {"docs": "doc_id", "class": "doc_id"}, buckets=4)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("pending").alias("status"))
    made.commit("load", {"docs": docs, "class": docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("email").alias("label"), F.lit(0).alias("run"))})
    return made


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert(spark, store):
    new = spark.createDataFrame([(2, "invoice", 1), (2, "resume", 3), (2, "email", 2), (3, "paper", 1)], "doc_id long, label string, run int")
    want = sorted([(k, "email", 0) for k in range(0, 40, 2) if k != 2] + [(2, "resume", 3), (3, "paper", 1)])
    assert store.upsert("a", "class", new, "run") == 2 and rows(store.table("class")) == want
    assert rows(store.table("class", 1)) == [(k, "email", 0) for k in range(0, 40, 2)]  # the old version is there
    # a replay changes nothing, even after another run
    assert store.upsert("b", "class", new.filter("doc_id = 3").withColumn("label", F.lit("email")), "run") == 3
    assert store.upsert("a", "class", new, "run") == 2 and store.version() == 3
    assert (3, "email", 1) in rows(store.table("class"))


def test_untouched_buckets_stay(spark, store):
    before = store._manifest()["tables"]["class"]["buckets"]
    store.upsert("one", "class", spark.createDataFrame([(6, "x", 1)], "doc_id long, label string, run int"), "run")
    after = store._manifest()["tables"]["class"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)


def test_delete_moves_together(spark, store):
    assert store.delete("gone", spark.range(30).select("id")) == 2
    assert [r[0] for r in rows(store.table("docs"))] == list(range(30, 40)) and [r[0] for r in rows(store.table("class"))] == list(range(30, 40, 2))
    assert store.table("docs", 1).count() == 40 and store.table("class", 1).count() == 20
    store.delete("rest", spark.range(40).select("id"))
    assert store.table("docs").count() == 0 and store.table("docs").columns == ["doc_id", "status"]
    store.upsert("back", "docs", spark.createDataFrame([(7, "done")], "doc_id long, status string"), "status")
    assert rows(store.table("docs")) == [(7, "done")]
    assert store.delete("none", spark.range(0).select("id")) == 5 and rows(store.table("docs")) == [(7, "done")]


def test_failure_before_manifest(spark, store, monkeypatch):
    """The data of both tables are written, the manifest is not: readers see the old version, and the run can be repeated."""

    def fails(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", fails)
        with pytest.raises(OSError):
            store.delete("gone", spark.range(30).select("id"))
    assert store.version() == 1 and store.table("docs").count() == 40 and store.table("class").count() == 20
    assert store.delete("gone", spark.range(30).select("id")) == 2 and store.table("docs").count() == 10


def test_failure_within_a_table(spark, store):
    """A task that raises leaves the old version."""
    bad = lambda old, keyed: old.withColumn("status", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        store.commit("bad", {"docs": (spark.range(5).select(F.col("id").alias("doc_id")), bad)})
    assert store.version() == 1 and store.table("docs").count() == 40


def test_two_writers(spark, store, monkeypatch):
    """Of two runs that start from one version the second is refused, and passes when repeated."""
    plain, gone = store._publish, spark.range(30).select("id")

    def late(manifest):
        monkeypatch.setattr(store, "_publish", plain)
        store.upsert("first", "docs", spark.createDataFrame([(35, "done")], "doc_id long, status string"), "status")
        plain(manifest)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(Conflict):
        store.delete("second", gone)
    assert store.table("docs").count() == 40 and store.done("second") is None
    assert store.delete("second", gone) == 3
    assert (35, "done") in rows(store.table("docs")) and store.table("docs").count() == 10
