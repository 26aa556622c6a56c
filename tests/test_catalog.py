"""Golden cases: two owners' documents, their lists and their summary."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.operators import catalog as C

NOW = datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(1, 1, "invoice-a", "done", 4), (2, 1, "invoice-b", "done", 3), (3, 1, "resume", "error", 2), (4, 1, "invoice-c", "pending", 1), (5, 1, "draft", "pending", 0), (6, 2, "other", "done", 5)]
    docs = spark.createDataFrame([(i, o, f, s, NOW - timedelta(minutes=m)) for i, o, f, s, m in docs], "doc_id long, owner_id long, filename string, status string, created_at timestamp")
    classes = spark.createDataFrame([(1, "invoice", 0.91), (2, "invoice", 0.97), (3, "resume", 0.88), (4, "invoice", 0.73), (6, "invoice", 0.99)], "doc_id long, predicted_label string, confidence double")
    extracts = spark.createDataFrame([(1, Decimal("100.00")), (2, Decimal("105.50")), (6, Decimal("999.99"))], "doc_id long, total_amount decimal(14,2)")
    return docs, classes, extracts


def test_summary(tables):
    row = C.summary(*tables).filter("owner_id = 1").first()
    assert (row.uploads, row.processed, row.errors, row.invoices) == (5, 2, 1, 3)
    assert (row.dominant_label, row.recent_invoice_total) == ("invoice", "205.50")
    assert row.recent_activity == "draft,invoice-c,resume,invoice-b,invoice-a"


def test_lists(tables):
    rows = C.with_children(*tables).filter("owner_id = 1")
    names = lambda df: [r.filename for r in df.collect()]
    listed = lambda o: names(rows.filter("doc_id <> 4").orderBy(*C.order_by(o)))
    assert names(C.search(rows, " INVOICE-A ", "filename")) == ["invoice-a"]
    assert names(C.filter_status(rows, "error")) == ["resume"]
    assert names(C.filter_label(rows.filter("doc_id <> 4"), "invoice").orderBy(F.desc("created_at"))) == ["invoice-b", "invoice-a"]
    assert listed("oldest") == ["invoice-a", "invoice-b", "resume", "draft"]
    assert listed("newest") == ["draft", "resume", "invoice-b", "invoice-a"]
    assert listed("confidence") == ["invoice-b", "invoice-a", "resume", "draft"]
    assert C.filter_status(rows, "nonsense").count() == 5
    assert C.paginate(rows, 2, 2).orderBy("place").select("filename", "count", "next", "previous").collect() == [("resume", 5, 3, 1), ("invoice-b", 5, 3, 1)]


def test_sniff(spark):
    rows = spark.createDataFrame([(b"%PDF-1.7",), (b"\x89PNG\r\n\x1a\n",), (b"\xff\xd8\xff\xe0",), (b"plain",), (b"\x00\x01",)], "content binary")
    assert [r[0] for r in rows.select(C.sniff_mime(F.col("content"))).collect()] == ["application/pdf", "image/png", "image/jpeg", "text/plain", None]
