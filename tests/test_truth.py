"""Label files in both layouts, their guardrail, and the exact rank that splits them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.boxes import kth_hash, seeded_hash, split_random
from paperloom.sources import truth as J


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, records in files.items():
        body = records if isinstance(records, str) else json.dumps(records, indent=1)
        (folder / f"{name}.json").write_text(body)
    return f"file://{folder}"


def records(n, text='{"total": "1"}', start=0):
    return [{"file": f"{k}.png", "ground_truth": text} for k in range(start, start + n)]


def both(spark, folder):
    return tuple(sorted((r.file, r.ground_truth) for r in side.collect()) for side in J.scan_truth(spark, folder))


def test_layouts(spark, tmp_path):
    two = write(tmp_path / "two", labels_train=records(3), labels_val=records(2, start=3), labels=records(50))
    train, val = both(spark, two)
    assert [f for f, _ in train] == ["0.png", "1.png", "2.png"] and [f for f, _ in val] == ["3.png", "4.png"] and train[0][1] == '{"total": "1"}'
    for n, k in ((1, 0), (2, 1), (9, 7), (10, 8), (57, 45)):  # one side alone is no split
        one = write(tmp_path / f"one{n}", labels_train=records(3), labels=records(n))
        train, val = both(spark, one)
        assert (len(train), len(val)) == (k, n - k) and not set(train) & set(val) and both(spark, one) == (train, val)
    assert both(spark, write(tmp_path / "none", labels=[])) == ([], [])
    with pytest.raises(FileNotFoundError):
        J.scan_truth(spark, write(tmp_path / "empty", labels_val=records(2)))


def test_malformed(spark, tmp_path):
    """Text that is no JSON is kept by the reader and refused by the scan; nested JSON comes as text."""
    path = write(tmp_path / "bad", labels='[{"file": "a.png", ', labels_train=[{"file": "é.png", "ground_truth": {"a": 1}}, {"file": "b.png"}], labels_val="{}")
    rows = J.read_labels(spark, f"{path}/labels.json").collect()
    assert len(rows) == 1 and rows[0].file is None and rows[0].malformed.startswith('[{"file"')
    assert {(r.file, r.ground_truth and "".join(r.ground_truth.split())) for r in J.read_labels(spark, f"{path}/labels_train.json").collect()} == {("é.png", '{"a":1}'), ("b.png", None)}
    (tmp_path / "bad" / "labels_train.json").write_text("no labels")
    with pytest.raises(Exception, match="malformed labels"):
        J.scan_truth(spark, path)[0].collect()


CASES = {
    '{"total": "", "date": " \\t"}': True, "{}": True, None: True, "[1]": True, '"x"': True, "null": True, "5": True,
    '{"total": "", "date": "x"}': False, '{"total": null}': False, '{"total": 0}': False, '{"total": {}}': False, "not json": False, '{"a": ': False, "": False,
}


def test_blank(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, ground_truth string")
    assert [r[0] for r in rows.orderBy("i").select(J.is_blank()).collect()] == list(CASES.values())


def test_guardrail(spark, tmp_path):
    blank, said = '{"total": " "}', '{"total": "3"}'
    sides = lambda name, a, b: J.scan_truth(spark, write(tmp_path / name, labels_train=a, labels_val=b))
    with pytest.raises(ValueError, match="empty"):
        J.guardrail(*sides("all", records(40, blank), records(40, blank)))
    J.guardrail(*sides("val", records(40, blank), records(1, said)))
    J.guardrail(*sides("text", records(1, "not json"), []))
    J.guardrail(*sides("no", [], []))
    # what comes after the first 30 of a side is not looked at
    with pytest.raises(ValueError):
        J.guardrail(*sides("late", records(30, blank) + records(9, said), records(30, blank)))


def test_rank(spark):
    """Every place against sorting, with buckets that are passed down to one hash, and with equal hashes."""
    rng = random.Random(1)
    keys = [rng.randrange(10**6) for _ in range(300)] + [7] * 40
    df = spark.createDataFrame([(k,) for k in keys], "key long").select(seeded_hash("key").alias("h"))
    want = sorted(r.h for r in df.collect())
    for k in (1, 2, 57, 170, 339, 340):
        assert kth_hash(df, k) == want[k - 1] and kth_hash(df, k, few=1) == want[k - 1]
    alike = df.select(F.concat(F.lit("a" * 31), F.substring("h", 1, 1)).alias("h"))
    want = sorted(r.h for r in alike.collect())
    assert [kth_hash(alike, k, few=5) for k in (1, 100, 340)] == [want[k - 1] for k in (1, 100, 340)]


@pytest.mark.parametrize("n, k", [(1, 0), (2, 1), (3, 1), (11, 2), (100, 20)])
def test_split_sizes(spark, n, k):
    rows = split_random(spark.range(n).withColumnRenamed("id", "key"), "key")
    assert rows.filter("split = 'val'").count() == k and rows.count() == n
