"""Costs that must not grow faster than the input, seen in plans and in counts of calls."""

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import extract as E
from paperloom.operators import features as V
from paperloom.operators import layout as L
from paperloom.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, *texts):
    return spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], "doc_id long, region int, line_no int, text string")


def test_line_values_are_computed_once(spark):
    """Each pattern stands a few times in the plan, not once for each place that reads its match."""
    made = plan(E.line_values(lines(spark, "a")))
    assert made.count("regexp_extract(") <= 10 and made.count("translate(") <= 2
    number = plan(lines(spark, "a").select(X.invoice_number(F.col("text"))))
    assert number.count("regexp_extract(") <= 6 and number.count("translate(") <= 2


def test_line_values_without_digits_or_signs(spark):
    texts = ("Bill to", "nfo@site.con", "a @ gmailcom", "nif 12345678", "VAT 20 %: 1 234,56 EUR", "Invoice No: ١٢٣٤٥٦٧٨", "INV-42 12 Main Street", "no. 00123 é", "Tel +33 01 23 45 67")
    rows = E.line_values(lines(spark, *texts)).orderBy("line_no").collect()
    assert [r["email"] for r in rows] == [None, "info@site.com", "a@gmail.com", *[None] * 6]
    assert [r["phone"] for r in rows] == [None, None, None, None, None, "١٢٣٤٥٦٧٨", None, None, "+33 01 23 45 67"]
    assert [r["percent"] for r in rows] == [*[None] * 4, "20 %", *[None] * 4]
    assert [r["number"] for r in rows] == [None] * len(texts)
    assert [r["norm"] for r in rows][7] == "no. 00123 e"


def test_lines_of_groups_cut_by_batches(spark):
    """Groups are not sent one by one, and one that runs over several Arrow batches stays whole; null keys are a group."""
    rows = [(d, r, i, f"t{i}", 10.0 * i, 0.0, 10.0 * i + 8, 12.0) for d, r, n in ((1, 0, 7), (1, 1, 1), (2, None, 3), (None, None, 4), (3, 0, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, region int, tok_no int, text string, xmin double, ymin double, xmax double, ymax double")
    blank = df.filter("doc_id = 3").withColumn("doc_id", F.lit(4)).withColumn("text", F.lit(" "))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        made = L.lines_within(df.unionByName(blank), ["doc_id", "region"])
        assert "FlatMapGroups" not in plan(made)
        got = {(r["doc_id"], r["region"]): (r["n_tokens"], r["xmax"], r["lines"]) for r in made.collect()}
    finally:
        spark.conf.set(size, before)
    line = lambda n: (n, 10.0 * n - 2, [" ".join(f"t{i}" for i in range(n))])
    assert got == {(1, 0): line(7), (1, 1): line(1), (2, None): line(3), (None, None): line(4), (3, 0): line(2)}


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Tables of sf0.001 whose keys are as large as those of bigger ones: five digits and more, "54270" among them."""
    path, c = tmp_path_factory.mktemp("large"), duckdb.connect()
    shift = lambda key, k: f"case when {key} % 3 = 0 then {key} when {key} % 3 = 1 then {54270 - k} + {key} else {9_900_000 - k} + {key} end"
    orders = {"o_orderkey": shift("o_orderkey", 3), "o_custkey": shift("o_custkey", 100)}
    items = {"l_orderkey": shift("l_orderkey", 3), "l_partkey": shift("l_partkey", 100), "l_suppkey": shift("l_suppkey", 4)}
    c.sql(f"copy (from '/root/testdata/sf0.001/region.parquet') to '{path}/region.parquet'")
    for name, made in (("customer", {"c_custkey": f"{shift('c_custkey', 100)} + case when c_custkey % 6 = 0 then 10000000 else 0 end"}), ("orders", orders), ("lineitem", items)):
        c.sql(f"copy (select * replace ({', '.join(f'{v} as {k}' for k, v in made.items())}) from '/root/testdata/sf0.001/{name}.parquet') to '{path}/{name}.parquet'")
    return path


@pytest.mark.parametrize("name", ["best_contact_block", "best_phone", "job_extract_invoices", "extract_region_pipeline"])
def test_sql_on_large_keys(spark, large_keys, name):
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{large_keys}/{t}.parquet'")
    df = registry.queries()[name](spark, str(large_keys))
    want = c.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and want
    if name != "best_contact_block":
        assert "54270" in str(c.sql("from lineitem").fetchall())


def test_anchor_and_legacy_values_are_computed_once(spark):
    """Values that an expression reads in several places are bound, not repeated."""
    made = plan(E.anchored_lines(lines(spark, "a").select("doc_id", "line_no", "text")))
    assert made.count("translate(") <= 2 and made.count("concat(") <= 2
    text = F.col("text")
    assert plan(lines(spark, "a").select(E.legacy_total(text))).count("regexp_extract(") <= 12
    assert plan(lines(spark, "a").select(E.legacy_due(text))).count("regexp_extract(") <= 30


def test_terms_are_counted_within_documents(spark):
    """Pairs of document and term are not shuffled; rows of one document count together, but no pair of words spans two."""
    docs = spark.createDataFrame([(1, "Red car, red car"), (1, "car"), (2, None), (3, "the"), (4, "solo"), (None, "ab ab")], "doc_id long, text string")
    made = V.terms(docs, ["the"], 2)
    assert "Aggregate [doc_id" in plan(made) and ", term" not in plan(made).split("Aggregate [")[1].split("]")[0]
    got = sorted(((r["doc_id"], r["term"], r["tf"]) for r in made.collect()), key=str)
    assert got == sorted([(1, "red", 2), (1, "car", 3), (1, "red car", 2), (1, "car red", 1), (4, "solo", 1), (None, "ab", 2), (None, "ab ab", 1)], key=str)
    assert {(r["doc_id"], r["term"], r["tf"]) for r in V.terms(docs, [], 1).collect()} == {(1, "red", 2), (1, "car", 3), (3, "the", 1), (4, "solo", 1), (None, "ab", 2)}
