"""Document lifecycle: pending -> processing -> done or error, as batch tables and as a stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.register import Registry
from ..plans.views import view
from ..sources.scratch import new_path

register = Registry()
FINAL = ("done", "error")
WAIT_S = 150


def latest(events: DataFrame) -> DataFrame:
    """Status of each document by its last event, ties by event id."""
    return events.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events"))


#: Letters whose counts the stored model reads.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text) -> list:
    low = F.lower(text)
    return [(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double").alias(f"n_{x}") for x in LETTERS]


def train_classifier(docs: DataFrame, path: str) -> None:
    """Fit a multinomial naive Bayes model over letter counts of (text, label) and store it at path."""
    rows = docs.filter("text is not null and label is not null").select("label", *letter_counts(F.col("text")))
    stages = [StringIndexer(inputCol="label", outputCol="at", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=[f"n_{x}" for x in LETTERS], outputCol="letters"), NaiveBayes(labelCol="at", featuresCol="letters")]
    fitted = Pipeline(stages=stages).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=fitted.stages[0].labels)
    # the index of the label is only for training: uploads have none
    PipelineModel([*fitted.stages[1:], names]).write().overwrite().save(path)


def decoded(content: bytes | None) -> str:
    """The text of an upload; what can't be read raises."""
    if content is None:
        raise FileNotFoundError("no content")
    text = content.decode("utf-8")
    if not text.strip():
        raise ValueError("no text")
    return text


def read_rows(uploads: DataFrame, reader: Callable[[bytes | None], str] = decoded) -> DataFrame:
    """(doc_id, text, error) of (doc_id, content): what reader raises becomes the row's error, and other rows go on."""

    def run(frames):
        for frame in frames:
            out = []
            for content in frame["content"]:
                try:
                    out.append((reader(content), None))
                except Exception as e:  # any failure is that document's state, as in a worker's catch-all
                    out.append((None, type(e).__name__))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [t for t, _ in out], "error": [e for _, e in out]})

    kind = uploads.schema["doc_id"].dataType.simpleString()
    return uploads.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, text string, error string")


def classify_rows(uploads: DataFrame, model: PipelineModel, reader: Callable[[bytes | None], str] = decoded) -> DataFrame:
    """(doc_id, predicted_label, error): one row for each upload, by a fitted model; unreadable ones have an error."""
    scored = model.transform(read_rows(uploads, reader).select("doc_id", "error", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "error", *letter_counts(F.col("text"))))
    return scored.select("doc_id", F.when(F.col("error").isNull(), F.col("predicted_label")).alias("predicted_label"), "error")


def route(classified: DataFrame) -> DataFrame:
    """Status after classification: invoices stay processing until their extraction, errors end."""
    return classified.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("predicted_label") == "invoice", "processing").otherwise("done"))


def run_stream(spark: SparkSession, source: str, schema, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], per_batch: int = 1) -> None:
    """Process what has landed at source, micro-batch by micro-batch, then stop.

    Batches are written under their number by overwrite, so a batch that is run again after a
    failure replaces its own rows: the sink is exactly-once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def streamed(spark: SparkSession, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Land rows, stream them through work, and read the sink."""
    source, out, state = (new_path(spark, n) for n in ("landed", "sink", "state"))
    rows.repartition(4).write.parquet(source)
    run_stream(spark, source, rows.schema, out, state, work, per_batch=2)
    return spark.read.parquet(out).drop("batch")


LOG = "doc_id long, predicted_label string, error string, status string"


def classify_stream(spark: SparkSession, source: str, schema, log: str, checkpoint: str, model_path: str, reader: Callable[[bytes | None], str] = decoded, per_batch: int = 2) -> None:
    """Classify what has landed at source with the stored model; then stop.

    Each batch first logs its documents as processing, then what became of them. Both parts lie under the
    number of their batch and are overwritten by a batch that is run again, so a restart repeats nothing.
    """
    model = PipelineModel.load(model_path)

    def sink(batch: DataFrame, number: int) -> None:
        batch.select("doc_id", F.lit(None).cast("string").alias("predicted_label"), F.lit(None).cast("string").alias("error"), F.lit("processing").alias("status")).write.mode("overwrite").parquet(f"{log}/batch={number}/step=0")
        route(classify_rows(batch, model, reader)).write.mode("overwrite").parquet(f"{log}/batch={number}/step=1")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, log: str) -> DataFrame:
    """Each document's last entry of a log; those that wait are there as processing."""
    rows = spark.read.schema(f"{LOG}, batch int, step int").parquet(log)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("predicted_label", "error", "status"), F.struct("batch", "step")).alias("r"), F.count(F.lit(1)).alias("entries")).select("doc_id", "r.*", "entries")


_LABEL = "case lang when 'de' then 'invoice' when 'en' then 'email' when 'es' then 'resume' else 'scientific_publication' end"


def _classified(spark, sf) -> DataFrame:
    """Documents as uploads, some of them not UTF-8, through the stream; the model learns from those that are not."""
    docs = view(spark, sf, "documents")
    landed, log, state, path = (new_path(spark, n) for n in ("landed", "log", "state", "model"))
    train_classifier(docs.filter("doc_id % 3 = 0").select("text", F.expr(_LABEL).alias("label")), path)
    body = F.encode("text", "utf-8")
    uploads = docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat(F.unhex(F.lit("FF")), body)).otherwise(body).alias("content"))
    uploads.repartition(4, "doc_id").write.parquet(landed)
    classify_stream(spark, landed, uploads.schema, log, state, path)
    return current(spark, log)


_BLANK = "text is null or trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"
_N = lambda x: f"(length(lower(text)) - length(replace(lower(text), '{x}', '')))"
_OUTCOME = f"""(with t as (select {_LABEL} as label, {", ".join(f"sum({_N(x)}) as s_{x}" for x in LETTERS)}, count(*) as docs from documents where doc_id % 3 = 0 and text is not null group by 1),
 m as (select label, ln(docs + 1.0) - ln((select sum(docs) + count(*) from t)) as prior, {", ".join(f"ln(s_{x} + 1.0) - ln({' + '.join(f's_{y}' for y in LETTERS)} + 26.0) as w_{x}" for x in LETTERS)} from t),
 p as (select doc_id, arg_max(label, prior + {" + ".join(f"{_N(x)} * w_{x}" for x in LETTERS)}) as label from documents cross join m where text is not null group by doc_id),
 e as (select doc_id, case when text is null then 'FileNotFoundError' when doc_id % 13 = 0 then 'UnicodeDecodeError' when {_BLANK} then 'ValueError' end as error from documents),
 r as (select doc_id, case when error is null then label end as predicted_label, error, case when error is not null then 'error' when label = 'invoice' then 'processing' else 'done' end as status from e left join p using (doc_id)) select * from r) r"""


@register("stream_classify", f"select doc_id, predicted_label, error, status, 2 as entries from {_OUTCOME}")
def stream_classify(spark, sf):
    """A fitted model in the stream: a row in processing first, then the outcome, an error where a text can't be read."""
    return _classified(spark, sf).select("doc_id", "predicted_label", "error", "status", "entries")


@register("route_invoices", f"select status, count(*) as documents from {_OUTCOME} group by status")
def route_invoices(spark, sf):
    return _classified(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


@register("stream_extract", f"select r.doc_id, 'done' as status, e.invoice_number from {_OUTCOME} left join v_extract e on e.doc_id = r.doc_id where status = 'processing'")
def stream_extract(spark, sf):
    """Invoices that wait in processing get their extraction and are done; a stream-static join."""
    waiting = _classified(spark, sf).filter("status = 'processing'").select("doc_id")
    extracts = view(spark, sf, "v_extract").select("doc_id", "invoice_number")
    return streamed(spark, waiting, lambda b: b.join(extracts, "doc_id", "left").withColumn("status", F.lit("done"))).select("doc_id", "status", "invoice_number")


@register("error_status", f"select doc_id, error from {_OUTCOME} where status = 'error'")
def error_status(spark, sf):
    """Documents whose reading raised stay visible, with what was raised."""
    return _classified(spark, sf).filter("status = 'error'").select("doc_id", "error")


@register("rerun_guard", "select doc_id, case when status = 'processing' then 422 else 202 end as code, case when status = 'processing' then 'processing' else 'pending' end as status from v_docs")
def rerun_guard(spark, sf):
    busy = F.col("status") == "processing"
    return view(spark, sf, "v_docs").select("doc_id", F.when(busy, 422).otherwise(202).alias("code"), F.when(busy, "processing").otherwise("pending").alias("status"))


@register("status_timeline", "select doc_id, arg_max(status, struct_pack(ts := ts, e := event_id)) as status, count(*) as events from v_status_events group by doc_id")
def status_timeline(spark, sf):
    return latest(view(spark, sf, "v_status_events"))


STATE = "status string, ts long, event_id long, events long, t0 long, late boolean"
TIMELINE = "doc_id long, status string, events long, timed_out boolean"


def timeline_stream(events: DataFrame, late: str = "1 hour", wait_s: int = WAIT_S) -> DataFrame:
    """Status of each document as a stream of (doc_id, status, events, timed_out), from a stream of (doc_id, event_id, ts, status).

    State by document: its last event by (ts, event_id), how many there were, and the first time. Events may come
    in any order and twice; what is later than `late` behind the newest is dropped. A document that is not final
    wait_s after its first event gets a row with timed_out from an event-time timer; a final event takes it back.
    """

    def step(key, frames, state):
        status, ts, event, n, t0, late = state.get if state.exists else ("", -(2**63), -(2**63), 0, 2**63 - 1, False)
        if state.hasTimedOut:
            late = True
        for f in frames if not state.hasTimedOut else ():
            at = f["ts"].astype("datetime64[us]").astype("int64")
            last = f.assign(ts=at).sort_values(["ts", "event_id"]).iloc[-1]
            if (int(last["ts"]), int(last["event_id"])) >= (ts, event):
                status, ts, event = str(last["status"]), int(last["ts"]), int(last["event_id"])
            n, t0 = n + len(f), min(t0, int(at.min()))
        due = t0 // 1000 + wait_s * 1000
        late = late or state.getCurrentWatermarkMs() > due
        state.update((status, ts, event, n, t0, late))
        if not late and status not in FINAL:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "events": [n], "timed_out": [late and status not in FINAL]})

    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("doc_id").applyInPandasWithState(step, TIMELINE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_timeline(spark: SparkSession, source: str, schema, out: str, checkpoint: str, late: str = "1 hour", wait_s: int = WAIT_S, per_batch: int = 1, written=lambda number: None) -> None:
    """Follow the events that have landed at source; then stop. `written` is told each batch that is stored.

    A batch that is run again starts from the state before it and replaces its own rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written(number)

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    timeline_stream(events, late, wait_s).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_states(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each document among all that a timeline has sent."""
    rows = spark.read.schema(f"{TIMELINE}, batch int").parquet(out)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "events", "timed_out"), F.struct("events", "timed_out")).alias("r")).select("doc_id", "r.*")


def _timeline(spark, sf) -> DataFrame:
    """Events landed out of order, a tenth of them twice, and at last one that takes the watermark to the newest."""
    events = view(spark, sf, "v_status_events").select("doc_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status")
    landed, out, state = (new_path(spark, n) for n in ("events", "timeline", "state"))
    twice = events.unionByName(events.filter("event_id % 10 = 0"))
    twice.repartition(4, F.xxhash64("event_id", "ts")).sortWithinPartitions(F.xxhash64("event_id")).write.parquet(landed)
    end = events.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts")).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("done").alias("status"))
    run_timeline(spark, landed, events.schema, out, state, late="60 days", per_batch=2)
    end.coalesce(1).write.mode("append").parquet(landed)
    run_timeline(spark, landed, events.schema, out, state, late="60 days", per_batch=2)
    return last_states(spark, out).filter("doc_id >= 0")


@register("status_timeline_stream", "select status, count(*) as documents from (select doc_id, arg_max(status, struct_pack(ts := ts, e := event_id)) as status from v_status_events group by doc_id) group by status")
def status_timeline_stream(spark, sf):
    """The stateful stream, stopped and started again, ends where the batch does."""
    return _timeline(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


@register("status_stream", f"select doc_id, arg_max(status, struct_pack(ts := ts, e := event_id)) as status, count(*) as events, arg_max(status, struct_pack(ts := ts, e := event_id)) not in ('done', 'error') and epoch((select max(ts) from v_status_events)) - epoch(min(ts)) > {WAIT_S} as timed_out from v_status_events group by doc_id")
def status_stream(spark, sf):
    """Status, number of events and time-out of every document from the stateful stream."""
    return _timeline(spark, sf)


@register("poll_timeout", f"select doc_id, arg_max(status, struct_pack(ts := ts, e := event_id)) not in ('done', 'error') and epoch((select max(ts) from v_status_events)) - epoch(min(ts)) > {WAIT_S} as timed_out from v_status_events group by doc_id")
def poll_timeout(spark, sf):
    """Not final and older than 60 polls of 2.5 s at the time of the newest event."""
    events = view(spark, sf, "v_status_events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    docs = events.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("t0"))
    late = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp")) > WAIT_S * 1_000_000
    return docs.join(F.broadcast(now)).select("doc_id", (~F.col("status").isin(*FINAL) & late).alias("timed_out"))


QUERIES, ORACLES = register.queries, register.oracles
