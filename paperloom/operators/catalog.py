"""Catalog queries: owner-scoped filters, searches, orders, pages, joins and dashboard sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.register import Registry
from ..plans.views import view

STATUSES = ("pending", "processing", "done", "error")
LABELS = ("invoice", "email", "scientific_publication", "resume", "unknown")
MAX_BYTES = 20 * 1024 * 1024
MIMES = ("application/pdf", "image/png", "image/jpeg", "text/plain")
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "txt")


def with_children(docs: DataFrame, classes: DataFrame, extracts: DataFrame) -> DataFrame:
    """Both 1:1 children by left join; AQE picks the strategy from the sizes it meets."""
    return docs.join(classes, "doc_id", "left").join(extracts, "doc_id", "left")


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    """Unknown values are ignored."""
    return df.filter(F.col("status") == status) if status in STATUSES else df


def filter_label(df: DataFrame, label: str | None) -> DataFrame:
    return df.filter(F.col("predicted_label") == label) if label in LABELS else df


def contains_ci(col: str, query: str) -> Column:
    """Case-insensitive substring, free of LIKE's escapes."""
    return F.lower(col).contains(query.strip().lower())


def search(df: DataFrame, query: str | None, *cols: str) -> DataFrame:
    if not query or not query.strip():
        return df
    return df.filter(reduce(lambda a, b: a | b, (contains_ci(c, query) for c in cols)))


def filter_sentinel(df: DataFrame, **values: str) -> DataFrame:
    """'all' stands for no predicate; the query q is trimmed and dropped when blank."""
    df = filter_status(df, values.get("status") if values.get("status") != "all" else None)
    df = filter_label(df, values.get("label") if values.get("label") != "all" else None)
    return search(df, values.get("q"), "filename")


def order_by(ordering: str = "newest") -> list[Column]:
    """Ties go by doc_id, so pages are stable."""
    if ordering == "oldest":
        return [F.asc("created_at"), F.asc("doc_id")]
    if ordering == "confidence":
        return [F.desc_nulls_last("confidence"), F.desc("created_at"), F.asc("doc_id")]
    return [F.desc("created_at"), F.asc("doc_id")]


def ranked(df: DataFrame, ordering: str) -> DataFrame:
    """Place of each document within its owner's list."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(*order_by(ordering))))


def paginate(df: DataFrame, page: int, size: int = 20, ordering: str = "newest") -> DataFrame:
    """Rows of a page of each owner's list with count, next and previous; at most 100 a page."""
    size = max(1, min(size, 100))
    listed = ranked(df, ordering).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("owner_id")))
    listed = listed.filter(F.col("place").between((page - 1) * size + 1, page * size))
    after = F.when(F.col("count") > page * size, F.lit(page + 1))
    return listed.withColumn("next", after).withColumn("previous", F.lit(page - 1 if page > 1 else None).cast("int"))


def validate_upload() -> Column:
    """The first check that fails: missing file, size, type."""
    return F.when(F.col("filename").isNull(), "VALIDATION_ERROR").when(F.col("file_size") > MAX_BYTES, "FILE_TOO_LARGE").when(~F.coalesce(F.col("content_type").isin(*MIMES), F.lit(False)), "UNSUPPORTED_MEDIA_TYPE")


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes; printable ASCII counts as plain text."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(F.decode(content, "ISO-8859-1").rlike(r"^[\t\n\r\x20-\x7e]*$"), "text/plain")


def validate_extension() -> Column:
    suffix = F.lower(F.element_at(F.split("filename", "[.]"), -1))
    return F.coalesce(F.col("content_type").isin(*MIMES), F.lit(False)) | F.coalesce(suffix.isin(*EXTENSIONS), F.lit(False))


def summary(docs: DataFrame, classes: DataFrame, extracts: DataFrame, recent: int = 5) -> DataFrame:
    """One row per owner: totals, dominant label, invoice sum and newest documents.

    The joined rows are read once: counts by owner and label, then sums and the commonest label of an
    owner from those, so a hot owner is summed before the second shuffle. The newest documents come
    from a window over the documents alone.
    """
    label = F.col("predicted_label")
    counted = with_children(docs, classes, extracts).groupBy("owner_id", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.sum("total_amount").alias("amount"),
    )
    totals = counted.groupBy("owner_id").agg(
        F.sum("n").alias("uploads"),
        F.sum("done").alias("processed"),
        F.sum("error").alias("errors"),
        F.sum(F.when(label == "invoice", F.col("n")).otherwise(0)).alias("invoices"),
        F.sum("amount").cast("string").alias("recent_invoice_total"),
        F.min_by(label, F.when(label.isNotNull(), F.struct(-F.col("n"), label))).alias("dominant_label"),
        F.max(F.when(label.isNotNull(), F.col("n"))).alias("dominant_count"),
    )
    newest = ranked(docs, "newest").filter(F.col("place") <= recent).groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "filename"))), lambda r: r["filename"]), ",").alias("recent_activity"))
    return totals.join(newest, "owner_id", "left")


def dominant_label(rows: DataFrame) -> DataFrame:
    """Commonest label of each owner, ties by label; owners without labels are absent."""
    counted = rows.filter(F.col("predicted_label").isNotNull()).groupBy("owner_id", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("n"), "predicted_label"))
    return counted.withColumn("k", best).filter("k = 1").select("owner_id", F.col("predicted_label").alias("dominant_label"), F.col("n").alias("dominant_count"))


def _children(spark, sf):
    return with_children(view(spark, sf, "v_docs"), view(spark, sf, "v_class"), view(spark, sf, "v_extract"))


def _docs(spark, sf):
    return view(spark, sf, "v_docs")


OWNER = 7
ALL = "v_docs d left join v_class c on c.doc_id = d.doc_id left join v_extract e on e.doc_id = d.doc_id"
register = Registry()


@register("scan_catalog", f"select d.doc_id, owner_id, filename, content_type, file_size, status, created_at, predicted_label, confidence, total_amount from {ALL}")
def scan_catalog(spark, sf):
    return _children(spark, sf).select("doc_id", "owner_id", "filename", "content_type", "file_size", "status", "created_at", "predicted_label", "confidence", "total_amount")


@register("filter_owner", f"select doc_id, filename from v_docs where owner_id = {OWNER}")
def filter_owner(spark, sf):
    return _docs(spark, sf).filter(F.col("owner_id") == OWNER).select("doc_id", "filename")


@register("filter_status", "select doc_id, status from v_docs where status = 'error'")
def q_filter_status(spark, sf):
    return filter_status(filter_status(_docs(spark, sf), "no-such"), "error").select("doc_id", "status")


@register("filter_sentinel", "select d.doc_id, filename from v_docs d left join v_class c on c.doc_id = d.doc_id where predicted_label = 'resume' and contains(lower(filename), '12')")
def q_filter_sentinel(spark, sf):
    return filter_sentinel(_children(spark, sf), status="all", label="resume", q=" 12 ").select("doc_id", "filename")


@register("filter_label", "select d.doc_id, predicted_label from v_docs d join v_class c on c.doc_id = d.doc_id where predicted_label = 'invoice'")
def q_filter_label(spark, sf):
    return filter_label(filter_label(_children(spark, sf), "no-such"), "invoice").select("doc_id", "predicted_label")


@register("search_filename", "select doc_id, filename from v_docs where contains(lower(filename), 'invoice-1')")
def search_filename(spark, sf):
    return search(_docs(spark, sf), "  INVOICE-1 ", "filename").select("doc_id", "filename")


@register("admin_filter", "select d.doc_id from v_docs d join v_class c on c.doc_id = d.doc_id where status = 'done' and content_type = 'image/png' and predicted_label = 'email' and model_version = 'v1'")
def admin_filter(spark, sf):
    rows = _docs(spark, sf).join(view(spark, sf, "v_class"), "doc_id")
    return rows.filter((F.col("status") == "done") & (F.col("content_type") == "image/png") & (F.col("predicted_label") == "email") & (F.col("model_version") == "v1")).select("doc_id")


@register("admin_search", f"select d.doc_id, username, invoice_number from {ALL} join v_users u on u.owner_id = d.owner_id where contains(lower(filename), '77') or contains(lower(username), '77') or contains(lower(coalesce(invoice_number, '')), '77') or contains(lower(coalesce(issuer_name, '')), '77')")
def admin_search(spark, sf):
    rows = _children(spark, sf).join(view(spark, sf, "v_users"), "owner_id")
    return search(rows, "77", "filename", "username", "invoice_number", "issuer_name").select("doc_id", "username", "invoice_number")


@register("not_null_child", f"select d.doc_id from {ALL} where predicted_label is not null and total_amount is not null")
def not_null_child(spark, sf):
    return _children(spark, sf).filter("predicted_label is not null and total_amount is not null").select("doc_id")


@register("lookup_by_key", "select doc_id, owner_id, filename, status from v_docs where doc_id = 42 and owner_id = (select o_custkey from orders where o_orderkey = 42)")
def lookup_by_key(spark, sf):
    """The (id, owner) pairs to look up come as a table; a wrong owner finds nothing."""
    keys = view(spark, sf, "orders").filter("o_orderkey = 42").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner_id"))
    return _docs(spark, sf).filter("doc_id = 42").join(keys, ["doc_id", "owner_id"], "left_semi").select("doc_id", "owner_id", "filename", "status")


@register("validate_upload", f"select doc_id, case when filename is null then 'VALIDATION_ERROR' when file_size > {MAX_BYTES} then 'FILE_TOO_LARGE' when content_type not in {MIMES} then 'UNSUPPORTED_MEDIA_TYPE' end as error_code from v_uploads")
def q_validate_upload(spark, sf):
    return view(spark, sf, "v_uploads").select("doc_id", validate_upload().alias("error_code"))


@register("validate_extension", f"select doc_id, coalesce(content_type in {MIMES}, false) or coalesce(lower(list_extract(string_split(filename, '.'), -1)) in {EXTENSIONS}, false) as accepted from v_uploads")
def q_validate_extension(spark, sf):
    return view(spark, sf, "v_uploads").select("doc_id", validate_extension().alias("accepted"))


@register("project_list", "select d.doc_id, filename, content_type, file_size, status, predicted_label as label, confidence, created_at, created_at as updated_at from v_docs d left join v_class c on c.doc_id = d.doc_id")
def project_list(spark, sf):
    rows = _docs(spark, sf).join(view(spark, sf, "v_class"), "doc_id", "left")
    return rows.select("doc_id", "filename", "content_type", "file_size", "status", F.col("predicted_label").alias("label"), "confidence", "created_at", F.col("created_at").alias("updated_at"))


@register("project_detail", f"select d.doc_id, filename, case when c.doc_id is not null then concat(predicted_label, '/', cast(round(confidence * 100) as bigint)) end as classification, case when e.doc_id is not null then concat(invoice_number, '/', cast(total_amount as varchar)) end as invoice_data from {ALL}")
def project_detail(spark, sf):
    """Children as structs or null; shown here as text, for oracles compare plain columns."""
    c = view(spark, sf, "v_class").select("doc_id", F.struct("predicted_label", "confidence").alias("classification"))
    e = view(spark, sf, "v_extract").select("doc_id", F.struct("invoice_number", "total_amount").alias("invoice_data"))
    rows = _docs(spark, sf).join(c, "doc_id", "left").join(e, "doc_id", "left")
    shown = F.concat("classification.predicted_label", F.lit("/"), F.round(F.col("classification.confidence") * 100).cast("long").cast("string"))
    return rows.select("doc_id", "filename", shown.alias("classification"), F.concat("invoice_data.invoice_number", F.lit("/"), F.col("invoice_data.total_amount").cast("string")).alias("invoice_data"))


@register("project_status", "select d.doc_id, status, cast(null as timestamp) as started_at, case when c.doc_id is not null then created_at end as completed_at from v_docs d left join v_class c on c.doc_id = d.doc_id")
def project_status(spark, sf):
    rows = _docs(spark, sf).join(view(spark, sf, "v_class").withColumn("seen", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", "status", F.lit(None).cast("timestamp").alias("started_at"), F.when(F.col("seen"), F.col("created_at")).alias("completed_at"))


@register("project_report_row", f"select d.doc_id, filename, coalesce(predicted_label, 'unknown') as label, coalesce(confidence, 0.8) as confidence, case when total_amount is not null then concat_ws(' ', nullif(currency, ''), cast(total_amount as varchar)) end as amount, created_at as reported_at from {ALL}")
def project_report_row(spark, sf):
    amount = F.when(F.col("total_amount").isNotNull(), F.concat_ws(" ", F.nullif("currency", F.lit("")), F.col("total_amount").cast("string")))
    return _children(spark, sf).select("doc_id", "filename", F.coalesce("predicted_label", F.lit("unknown")).alias("label"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), amount.alias("amount"), F.col("created_at").alias("reported_at"))


@register("join_doc_children", f"select d.doc_id, predicted_label, invoice_number from {ALL}")
def join_doc_children(spark, sf):
    return _children(spark, sf).select("doc_id", "predicted_label", "invoice_number")


@register("join_implicit_inner", "select d.doc_id, predicted_label, total_amount from v_docs d join v_class c on c.doc_id = d.doc_id join v_extract e on e.doc_id = d.doc_id")
def join_implicit_inner(spark, sf):
    return _docs(spark, sf).join(view(spark, sf, "v_class"), "doc_id").join(view(spark, sf, "v_extract"), "doc_id").select("doc_id", "predicted_label", "total_amount")


@register("join_profile_default", "select u.owner_id, coalesce(display_name, '') as display_name, coalesce(avatar_url, '') as avatar_url, p.owner_id is null as created from v_users u left join v_profiles p on p.owner_id = u.owner_id")
def join_profile_default(spark, sf):
    rows = view(spark, sf, "v_users").join(view(spark, sf, "v_profiles"), "owner_id", "left")
    return rows.select("owner_id", F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("avatar_url", F.lit("")).alias("avatar_url"), F.col("display_name").isNull().alias("created"))


@register("summary_totals", "select owner_id, count(*) as uploads, count(*) filter (status = 'done') as processed, count(*) filter (status = 'error') as errors, count(*) filter (predicted_label = 'invoice') as invoices from v_docs d left join v_class c on c.doc_id = d.doc_id group by owner_id")
def summary_totals(spark, sf):
    return summary(*(view(spark, sf, v) for v in ("v_docs", "v_class", "v_extract"))).select("owner_id", "uploads", "processed", "errors", "invoices")


_DOMINANT = "select owner_id, predicted_label as dominant_label, n as dominant_count from (select owner_id, predicted_label, count(*) as n, row_number() over (partition by owner_id order by count(*) desc, predicted_label) as k from v_docs d join v_class c on c.doc_id = d.doc_id group by owner_id, predicted_label) where k = 1"


@register("summary_dominant_label", _DOMINANT)
def summary_dominant_label(spark, sf):
    return dominant_label(_docs(spark, sf).join(view(spark, sf, "v_class"), "doc_id"))


@register("summary_invoice_total", "select owner_id, cast(sum(total_amount) as varchar) as recent_invoice_total from v_docs d left join v_extract e on e.doc_id = d.doc_id group by owner_id")
def summary_invoice_total(spark, sf):
    return _docs(spark, sf).join(view(spark, sf, "v_extract"), "doc_id", "left").groupBy("owner_id").agg(F.sum("total_amount").cast("string").alias("recent_invoice_total"))


_NEWEST = "select owner_id, filename, row_number() over (partition by owner_id order by created_at desc, doc_id) as place from v_docs"


@register(
    "summary_workspace",
    f"""select t.*, dominant_label, dominant_count, recent_activity from (
      select owner_id, count(*) as uploads, count(*) filter (status = 'done') as processed, count(*) filter (status = 'error') as errors, count(*) filter (predicted_label = 'invoice') as invoices, cast(sum(total_amount) as varchar) as recent_invoice_total
      from {ALL} group by owner_id) t
    left join ({_DOMINANT}) m on m.owner_id = t.owner_id
    left join (select owner_id, string_agg(filename, ',' order by place) as recent_activity from ({_NEWEST}) where place <= 5 group by owner_id) r on r.owner_id = t.owner_id""",
)
def summary_workspace(spark, sf):
    return summary(*(view(spark, sf, v) for v in ("v_docs", "v_class", "v_extract")))


@register("distinct_labels", "select distinct predicted_label as label from v_class union select 'selected'")
def distinct_labels(spark, sf):
    one = spark.createDataFrame([("selected",)], "label string")
    return view(spark, sf, "v_class").select(F.col("predicted_label").alias("label")).union(one).distinct().orderBy("label")


@register("union_distinct_label", "select distinct predicted_label as label from v_class union select distinct lang from documents")
def union_distinct_label(spark, sf):
    return view(spark, sf, "v_class").select(F.col("predicted_label").alias("label")).union(view(spark, sf, "documents").select("lang")).distinct()


for _name, _by in (("newest", "created_at desc, d.doc_id"), ("oldest", "created_at, d.doc_id"), ("confidence", "confidence desc nulls last, created_at desc, d.doc_id")):

    @register(f"order_{_name}", f"select owner_id, d.doc_id, row_number() over (partition by owner_id order by {_by}) as place from v_docs d left join v_class c on c.doc_id = d.doc_id")
    def _order(spark, sf, ordering=_name):
        return ranked(_docs(spark, sf).join(view(spark, sf, "v_class"), "doc_id", "left"), ordering).select("owner_id", "doc_id", "place")


@register("recent_activity", f"select owner_id, filename, place from ({_NEWEST}) where place <= 5")
def recent_activity(spark, sf):
    return ranked(_docs(spark, sf), "newest").filter("place <= 5").select("owner_id", "filename", "place")


@register("paginate", f"select owner_id, filename, place, count, case when count > 10 then 3 end as next, 1 as previous from (select *, count(*) over (partition by owner_id) as count from ({_NEWEST})) where place between 6 and 10")
def q_paginate(spark, sf):
    return paginate(_docs(spark, sf), page=2, size=5).select("owner_id", "filename", "place", "count", "next", "previous")


@register("scores_sorted", "select doc_id, string_agg(label || '=' || cast(cast(round(p * 100) as bigint) as varchar), ' ' order by p desc, label) as scores from v_probs where model = 'lr' group by doc_id")
def scores_sorted(spark, sf):
    probs = view(spark, sf, "v_probs").filter("model = 'lr'").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("all_scores"))
    entries = F.array_sort(F.transform(F.map_entries("all_scores"), lambda e: F.struct((-e["value"]).alias("q"), e["key"].alias("label"))))
    return probs.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat(e["label"], F.lit("="), F.round(-e["q"] * 100).cast("long").cast("string"))), " ").alias("scores"))


@register("upload_row", "select doc_id, owner_id, filename, concat(cast(owner_id as varchar), '/', filename) as storage_key, content_type, file_size, 'pending' as status from v_uploads where filename is not null")
def upload_row(spark, sf):
    """Catalog rows for accepted names. Keys may collide: then the later bytes replace the earlier."""
    rows = view(spark, sf, "v_uploads").filter("filename is not null")
    return rows.select("doc_id", "owner_id", "filename", F.concat_ws("/", F.col("owner_id").cast("string"), "filename").alias("storage_key"), "content_type", "file_size", F.lit("pending").alias("status"))


QUERIES, ORACLES = register.queries, register.oracles
