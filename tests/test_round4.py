"""Findings of round 4."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import extract as E
from paperloom.operators import layout as L
from paperloom.operators import models as M
from paperloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_order(tmp_path_factory):
    """Tables of sf0.001 where one order has 17 lines, each of a price of nine characters, so that they go on on a second page."""
    path, c = tmp_path_factory.mktemp("long"), duckdb.connect()
    c.sql(f"copy (from '{SF}/region.parquet') to '{path}/region.parquet'")
    c.execute(f"copy (select * replace (case when o_orderkey = 5 then 345678.91 else o_totalprice end as o_totalprice) from '{SF}/orders.parquet') to '{path}/orders.parquet'")
    c.execute(f"create table l as from '{SF}/lineitem.parquet'")
    c.execute(f"create table long as select l.* replace (5::bigint as l_orderkey, n::int as l_linenumber, (100000.5 + n)::double as l_extendedprice) from (select * from l limit 1) l cross join range(1, 18) t(n)")
    c.execute(f"copy (from l where l_orderkey <> 5 union all from long) to '{path}/lineitem.parquet'")
    return path


def test_regions_stand_where_they_begin(spark, long_order):
    """the last lines of a region on the next page's top do not move it before the total."""
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{long_order}/{t}.parquet'")
    df = registry.queries()["extract_region_pipeline"](spark, str(long_order))
    want = c.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()['extract_region_pipeline']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert "'345678.91'" in str([r for r in want if r[1] == "Client_Phone"])


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_extraction_shuffles_lines_once(spark):
    """F8, F11: one shuffle, of lines without their values, and nothing written; labels, boxes and evidence included."""
    lines = spark.createDataFrame([(1, 0, 0, "Acme Company"), (1, 0, 1, " "), (1, 1, 2, "Total: 12.50"), (1, 1, 3, "mail a@b.com")], "doc_id long, region int, line_no int, text string")
    labels = lines.select("doc_id", "region", F.lit("table").alias("label")).distinct()
    boxes = spark.createDataFrame([(1, 0, 5.0, 90.0), (1, 1, 5.0, 9.0), (1, 7, 0.0, 0.0)], "doc_id long, region int, x1 double, y1 double")
    plain = E.extract_regions(lines, evidence=True)
    assert shuffles(plain) == 1 and "paperloom" not in plain._jdf.queryExecution().executedPlan().toString()
    assert shuffles(E.extract_regions(lines, boxes=boxes)) == 1
    got = {r["field"]: (r["value"], r["method"], r["evidence"]) for r in plain.collect()}
    assert got == {"Issuer_Name": ("Acme Company", "top_region_fallback", "Acme Company"), "Total": ("12.50", "totals_region", "Total: 12.50\nmail a@b.com"), "Client_Email": ("a@b.com", "global_scan", "mail a@b.com"), "Invoice_Number": ("12.50", "global_scan", "Total: 12.50")}
    basic = {r["field"]: r["value"] for r in E.extract_regions(lines, basic=True, labels=labels, evidence=True).collect()}
    assert basic["Products"] in ("Acme Company", "Acme Company | mail a@b.com") and basic["Total"] == "12.50"


def test_every_total_counts(spark):
    """rates are returned, and each of the six rules finds values in the corpus."""
    df = registry.queries()["extract_totals"](spark, SF).drop("doc_id", "region")
    assert set(df.columns) == {"total", "vat", "subtotal", "discount", "vat_rate", "discount_rate"}
    n = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    assert all(n[c] > 0 for c in df.columns)


def test_machines_descend_together(spark):
    """as good as MLlib's one by one, with passes that do not multiply with classes and Cs."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 6)) * [1, 3, 1, 0.2, 1, 0] + np.eye(6)[y] * 1.5
    train = spark.createDataFrame([(float(k), Vectors.dense(v)) for k, v in zip(y, x)], T.StructType([T.StructField("label", T.DoubleType()), T.StructField("scaled", VectorUDT())]))
    spark.sparkContext.setJobGroup("together", "")
    made = M.machines(train, (0.2, 50.0))
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("together")) <= 100
    deviation = x.std(0, ddof=1)
    for c, (w, b) in zip((0.2, 50.0), made):
        loss = lambda w, b, s: np.maximum(0, 1 - s * (x @ w + b)).mean() + ((w * deviation) ** 2).sum() / (2 * c * 400)
        for k in (0, 2):
            side = np.where(y == k, 1.0, -1.0)
            one = LinearSVC(regParam=1 / (c * 400), maxIter=30, labelCol="own", featuresCol="scaled").fit(train.withColumn("own", (F.col("label") == k).cast("double")))
            assert loss(w[k], b[k], side) <= 1.02 * loss(one.coefficients.toArray(), one.intercept, side)


def test_unseen_class_is_not_predicted(spark):
    """A class without training rows has an index (StringIndexer keeps one for it), and no machine of its own that could win."""
    rows = [(i, float(i % 2), Vectors.dense([i % 2 * 2.0 - 1, (i * 7 % 10) / 10]), i >= 30) for i in range(40)] + [(99, 2.0, Vectors.dense([0.0, 9.0]), True)]
    data = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("scaled", VectorUDT()), T.StructField("val", T.BooleanType())]))
    meta = {"ml_attr": {"type": "nominal", "vals": ["a", "b", "__unknown"]}}
    got = M.fit_score(data.withColumn("label", F.col("label").alias("label", metadata=meta)), "svm").collect()
    assert len(got) == 11 and all(r.prediction < 2 and len(r.probability) == 3 and r.probability[2] == 0 for r in got)
    assert all(r.prediction == r.label for r in got if r.doc_id < 99)


def test_tokens_meet_boxes_by_image(spark):
    """a shuffle of the boxes and one of the tokens, none for the groups, and no row for each cell of a grid."""
    tokens = spark.createDataFrame([(1, k, f"t{k}", 10.0 * k, 0.0, 10.0 * k + 8, 12.0) for k in range(6)], "doc_id long, tok_no int, text string, xmin double, ymin double, xmax double, ymax double")
    boxes = spark.createDataFrame([(1, k, 0.0, 0.0, 20.0 * k + 9, 50.0) for k in range(3)] + [(2, 0, 0.0, 0.0, 9.0, 9.0)], "image_id long, region_index long, x1 double, y1 double, x2 double, y2 double")
    made = L.lines_of_groups(L.tokens_in_boxes(boxes, tokens, 2), ["image_id", "region_index"])
    assert shuffles(made) == 2 and "sequence" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, 0, ["t0"]), (1, 1, ["t0 t1 t2"]), (1, 2, ["t0 t1 t2 t3 t4"])]


def test_phone_lines_are_normalised_once(spark):
    """the filter that looks for words binds the normal form; lines without seven digits are passed by."""
    lines = spark.createDataFrame([(1, 0, "Tel: +33 01 23 45 67"), (1, 1, "phone 12 34"), (1, 2, "01 23 45 67 89"), (2, 0, "virement tel 12345678")], "doc_id long, line_no int, text string")
    made = E.best_phone(lines)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2
    assert [(r["doc_id"], r["value"]) for r in made.collect()] == [(1, "+33 01 23 45 67")]
