"""Functions and operators on small cases."""

import math
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import boxes as B
from paperloom.operators import evaluate as E
from paperloom.operators import layout as L
from paperloom.streaming import lifecycle


def one(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


def test_text(spark):
    assert one(spark, X.clean_ocr_text, " a  bc 7 é x9\n") == ["bc 7 x9"]
    assert one(spark, X.normalize_text, "Éta: N° 5 | €") == ["eta: n 5"]
    assert one(spark, lambda t: X.normalize_text(t, exact=True), "ﬁn ½") == ["fin 12"]
    assert one(spark, X.find_email, "nfo@site.con x", "a @ gmailcom", "none") == ["info@site.com", "a@gmail.com", None]
    assert one(spark, X.find_phone, "+33 01 23 45 67", "nif 12345678", "1234") == ["+33 01 23 45 67", None, None]
    assert [str(d) for d in one(spark, X.parse_date, "05/03/1998", "05/03/69", "March 5, 2020", "31/02/2024")] == ["1998-03-05", "1969-03-05", "2020-03-05", "None"]
    assert [str(d) for d in one(spark, X.parse_amount_decimal, "12,50", "1,234.5", "12 EUR", "€ 3")] == ["12.50", "1234.50", "None", "3.00"]
    assert one(spark, X.parse_amount_float, "1.234,56", "1,234.56", "x") == [1234.56, 1234.56, None]
    assert one(spark, lambda t: X.last(t, X.MONEY), "VAT 20%: 24.69") == ["24.69"]
    assert one(spark, X.invoice_number, "Invoice No: INV-100042", "12 Main Street 5555") == ["inv-100042", None]


BOX = st.tuples(*(st.integers(0, 30),) * 4).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(BOX, BOX), min_size=1, max_size=30))
def test_iou(spark, pairs):
    rows = [(*map(float, a), *map(float, b)) for a, b in pairs]
    df = spark.createDataFrame(rows, ", ".join(f"{t}{c} double" for t in "ab" for c in ("x1", "y1", "x2", "y2")))
    df = df.select(*(F.struct(*(F.col(t + c).alias(c) for c in ("x1", "y1", "x2", "y2"))).alias(t) for t in "ab"))
    for there, back, inside in df.select(B.box_iou("a", "b"), B.box_iou("b", "a"), B.containment_ratio("a", "b")).collect():
        assert there == back and 0 <= there <= 1 and there <= inside + 1e-9 <= 1 + 2e-9


def test_dedup(spark):
    rows = [(1, 1, "paragraph", 0.9, 0, 0, 10, 10), (1, 2, "paragraph", 0.8, 0, 0, 10, 9), (1, 3, "table", 0.7, 0, 0, 10, 10), (1, 4, "paragraph", 0.6, 50, 0, 60, 10)]
    rows += [(2, k, "table", 0.5, 20 * k, 0, 20 * k + 10, 10) for k in range(5)]
    df = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], "image_id long, det_no long, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    kept = {(r.image_id, r.det_no): r.region_index for r in B.dedup_detections(df).collect()}
    assert kept == {(1, 1): 1, (1, 3): 2, (1, 4): 3, (2, 0): 1, (2, 1): 2, (2, 2): 3}


def test_split_grouped(spark):
    df = spark.createDataFrame([(i, f"k{i % 23}") for i in range(200)], "id long, key string")
    rows = B.split_grouped(df, "key").collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.key, set()).add(r.split)
    assert len(rows) == 200 and all(len(s) == 1 for s in sides.values()) and sum(s == {"val"} for s in sides.values()) == 4


def test_group_lines(spark):
    df = pd.DataFrame({"doc_id": [1] * 4, "tok_no": range(4), "text": ["b", "a", "far", "low"], "confidence": 1.0, "xmin": [30.0, 0.0, 400.0, 0.0], "ymin": [1.0, 0.0, 0.0, 30.0]})
    df["xmax"], df["ymax"] = df.xmin + 20, df.ymin + 10
    # a centre at 5 comes first and opens a line; the far one is more than four heights aside; `b` joins `a`
    assert [r.text for r in L.group_lines(spark.createDataFrame(df)).orderBy("line_no").collect()] == ["far", "a b", "low"]


def plain_lines(tokens):
    """Two loops over (text, xmin, ymin, xmax, ymax, tok_no)."""
    height = sorted(max(1, t[4] - t[2]) for t in tokens)[len(tokens) // 2]
    lines = []
    for t in sorted(tokens, key=lambda t: ((t[2] + t[4]) / 2, t[1], t[5])):
        for line in lines:
            centre = sum((u[2] + u[4]) / 2 for u in line) / len(line)
            if abs((t[2] + t[4]) / 2 - centre) <= max(6, height / 2) and t[1] <= max(u[3] for u in line) + 4 * height and t[3] >= min(u[1] for u in line) - 4 * height:
                line.append(t)
                break
        else:
            lines.append([t])
    box = lambda line: ((min(u[2] for u in line) + max(u[4] for u in line)) / 2, min(u[1] for u in line))
    return [" ".join(u[0] for u in sorted(line, key=lambda u: u[1])) for line in sorted(lines, key=box)]


def random_tokens(docs, n, seed=3):
    rng = random.Random(seed)
    return [(d, k, rng.choice(["a", "bb", "c d", " ", ""]), x, y, x + rng.randint(2, 60), y + rng.randint(4, 16)) for d in range(docs) for k in range(n) for x, y in [(rng.random() * 900, rng.random() * 500)]]


TOKENS = "doc_id long, tok_no long, text string, xmin double, ymin double, xmax double, ymax double"


def test_lines_in_regions(spark):
    rows = [tuple(float(v) if i > 2 else v for i, v in enumerate(r)) for r in random_tokens(12, 40)] + [(99, 0, " ", 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, TOKENS)
    region = {(r.doc_id, r.tok_no): r.region for r in L.cluster_regions(df).collect()}
    want = {}
    for r in rows:
        want.setdefault((r[0], region[r[0], r[1]]), []).append((r[2], *r[3:], r[1]))
    got = {(r.doc_id, r.region): r for r in L.region_bbox(df).collect()}
    texts = {k: [t for t in plain_lines(v) if t.strip()] for k, v in want.items()}
    assert {k for k, v in texts.items() if v} == set(got) and (99, 0) not in got
    for k, r in got.items():
        t = want[k]
        assert r.text == "\n".join(texts[k]) and r.line_count == len(texts[k]) and r.n_tokens == len(t)
        assert (r.xmin, r.ymin, r.xmax, r.ymax) == (min(u[1] for u in t), min(u[2] for u in t), max(u[3] for u in t), max(u[4] for u in t))


def test_tokens_in_boxes(spark):
    """Cells against all pairs: overlapping boxes, borders, boxes without area or turned round, negative places."""
    rng = random.Random(8)
    tokens = [(d, k, "t", float(x), float(y), float(x + 2 * rng.randint(0, 40)), float(y + 2 * rng.randint(0, 9))) for d in range(4) for k in range(200) for x, y in [(rng.randint(-200, 900), rng.randint(-200, 600))]]
    boxes = [(d, k, float(x), float(y), float(x + rng.randint(-20, 400)), float(y + rng.randint(0, 300))) for d in range(5) for k in range(9) for x, y in [(rng.randint(-200, 700), rng.randint(-200, 500))]]
    boxes += [(1, 100, 64.0, 64.0, 64.0, 64.0), (1, 101, -1000.0, -1000.0, 2000.0, 2000.0)]
    tokens.append((1, 900, "edge", 60.0, 60.0, 68.0, 68.0))
    want = sorted((d, b[1], k) for d, k, _, x0, y0, x1, y1 in tokens for b in boxes if b[0] == d and b[2] <= (x0 + x1) / 2 <= b[4] and b[3] <= (y0 + y1) / 2 <= b[5])
    for cell in (64, 7):
        got = L.tokens_in_boxes(spark.createDataFrame(boxes, "image_id long, region_index long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(tokens, TOKENS), cell)
        assert sorted((r.image_id, r.region_index, r.tok_no) for r in got.collect()) == want


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "actual string, predicted string")
    rows = {r.label: r for r in E.class_report(df).collect()}
    assert rows["accuracy"].f1 == 0.5 and rows["c"].recall == 0 and rows["a"].precision == 0.5 and math.isclose(rows["macro avg"].recall, 0.5)


def test_stream_equals_batch(spark):
    df = spark.createDataFrame([(i, "invoice" if i % 2 else None, "bad" if i % 5 == 0 else None) for i in range(40)], "doc_id long, predicted_label string, error string")
    assert sorted(map(str, lifecycle.streamed(spark, df, lifecycle.route).collect())) == sorted(map(str, lifecycle.route(df).collect()))
