"""TF-IDF, scaling and page-raster features, kept relational so that they scale and can be checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.register import Registry
from ..plans.views import view
from ..sources.scratch import stored

register = Registry()
VOCABULARY = 300


def terms(docs: DataFrame, stop: list[str], grams: int = 1) -> DataFrame:
    """(doc_id, term, tf): lower-case words of two characters or more, and their n-grams.

    A document's words meet as one array and are counted there, in order, so pairs of document and term are never shuffled.
    """
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop))
    rows = docs.select("doc_id", words.alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("w"))

    def with_pairs(w):
        count = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, count), F.slice(w, 2, count), lambda a, b: F.concat_ws(" ", a, b)))

    def counted(s):
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        run = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf")))
        return X.let(begins, run)

    every = F.sort_array(F.flatten(F.transform("w", with_pairs) if grams == 2 else F.col("w")))
    return rows.select("doc_id", F.explode(X.let(every, counted)).alias("t")).select("doc_id", "t.term", "t.tf")


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocab_topk(df: DataFrame, k: int = VOCABULARY) -> DataFrame:
    return df.orderBy(F.desc("total"), "term").limit(k)


def tfidf_fit(tf: DataFrame, n_docs: DataFrame, k: int = VOCABULARY) -> DataFrame:
    """(term, idf) of the k commonest terms; idf = ln((1 + n) / (1 + df)) + 1. k rows."""
    vocabulary = vocab_topk(document_frequency(tf), k)
    return vocabulary.join(F.broadcast(n_docs)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_transform(tf: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, term, weight): (1 + ln tf) * idf, each document of length 1. The model has k rows. Store tf first: the model reads it too."""
    raw = tf.join(F.broadcast(model), "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).drop("w")


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per feature: mean and population deviation, 0 counting as 1."""
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in cols))).alias("f")).select("f.*")


def standardize(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Z-scores; the statistics are one row per feature, turned to one wide row."""
    wide = stats.groupBy().pivot("feature", cols).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    return df.join(F.broadcast(wide)).select("doc_id", *(((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in cols))


STOP = StopWordsRemover.loadDefaultStopWords
_STOP = ("the", "and", "of", "to", "is", "in", "for", "that", "was", "are")
_TF = f"select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]{{2,}}')) as term from documents) where term not in {_STOP} group by doc_id, term"
_DF = f"select term, count(*) as df, cast(sum(tf) as bigint) as total from ({_TF}) group by term"
_TOP = f"select * from ({_DF}) order by total desc, term limit {VOCABULARY}"
_IDF = f"select term, ln((1 + (select count(*) from documents)) / (1 + df)) + 1 as idf from ({_TOP})"


def _tf(spark, sf, grams=1):
    return terms(view(spark, sf, "documents"), list(_STOP), grams)


def _n(spark, sf):
    return view(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@register("document_frequency", _DF)
def q_document_frequency(spark, sf):
    return document_frequency(_tf(spark, sf))


@register("vocab_topk", _TOP)
def q_vocab_topk(spark, sf):
    return vocab_topk(document_frequency(_tf(spark, sf)))


@register("tfidf_fit", f"select term, round(idf, 9) as idf from ({_IDF})")
def q_tfidf_fit(spark, sf):
    return tfidf_fit(_tf(spark, sf), _n(spark, sf)).select("term", F.round("idf", 9).alias("idf"))


@register("tfidf_transform", f"select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 7) as weight from (select t.doc_id, t.term, (1 + ln(tf)) * idf as w from ({_TF}) t join ({_IDF}) m on m.term = t.term)")
def q_tfidf_transform(spark, sf):
    tf = stored(_tf(spark, sf), "tf")
    return tfidf_transform(tf, tfidf_fit(tf, _n(spark, sf))).select("doc_id", "term", F.round("weight", 7).alias("weight"))


@register("tfidf_bigrams")
def tfidf_bigrams(spark, sf):
    """Uni- and bigrams with Spark's English stop words."""
    tf = stored(terms(view(spark, sf, "documents"), STOP("english"), 2), "tf")
    return tfidf_transform(tf, tfidf_fit(tf, _n(spark, sf), 750)).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("weight"), 4).alias("weight"))


_COLS = ["n_chars", "n_words", "upper_ratio", "digit_ratio"]


def _meta(spark, sf):
    made = X.text_meta_features(F.col("text"))
    return view(spark, sf, "documents").select("doc_id", *(made[c].alias(c) for c in _COLS))


_W = "len(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), ' '), lambda t: length(t) > 1 or regexp_full_match(t, '[0-9]')))"
_F = f"select doc_id, length(text) as n_chars, {_W} as n_words, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1) as upper_ratio, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(text), 1) as digit_ratio from documents"


@register("scaler_stats", " union all ".join(f"select '{c}' as feature, round(avg({c}), 6) as mean, round(case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end, 6) as std from ({_F})" for c in _COLS))
def q_scaler_stats(spark, sf):
    return scaler_stats(_meta(spark, sf), _COLS).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("standardize", "select doc_id, " + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in _COLS) + f" from ({_F})")
def q_standardize(spark, sf):
    rows = _meta(spark, sf)
    return standardize(rows, scaler_stats(rows, _COLS), _COLS).select("doc_id", *(F.round(c, 6).alias(c) for c in _COLS))


# Page rasters: one row a page, (doc_id, h, w, gray) with gray as an array of rows, or as bytes, row by row.

SIDE = 80
GRID = tuple(f"g{k}" for k in range(16))
RASTER = ("ink", *GRID, "top", "bottom", "left_half", "right_half", "blank_rows", "blank_cols", "top_margin", "bottom_margin", "left_margin", "right_margin", "edge_mean", "edge_std")


def pages(docs: DataFrame, *keep: str) -> DataFrame:
    """Rasters from the texts' characters, 80 to a row; marks where there is no blank. Empty texts have none. Columns: `keep` (doc_id if not given), h, w, gray."""
    keep = keep or ("doc_id",)
    rows = docs.filter(F.length("text") > 0).select(*keep, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{SIDE}}}"), F.lit(0)).alias("lines"))
    gray = F.transform("lines", lambda t: F.transform(F.split(F.rpad(t, SIDE, " "), ""), lambda c: F.when(c.isin(" ", "\t", "\n", "\r"), 255).otherwise(0)))
    return rows.select(*keep, F.size("lines").alias("h"), F.lit(SIDE).alias("w"), gray.alias("gray"))


def packed_pages(docs: DataFrame, *keep: str) -> DataFrame:
    """`pages` with gray as bytes."""
    keep = keep or ("doc_id",)

    @F.pandas_udf("binary")
    def marks(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            blank = (codes == 32) | (codes == 9) | (codes == 10) | (codes == 13)
            return (blank * np.uint8(255)).tobytes().ljust(-(-len(codes) // SIDE) * SIDE, b"\xff")

        return texts.map(one)

    rows = docs.filter(F.length("text") > 0).select(*keep, F.lit(SIDE).alias("w"), marks("text").alias("gray"))
    return rows.select(*keep, F.floor(F.octet_length("gray") / SIDE).cast("int").alias("h"), "w", "gray")


def image_pages(images: DataFrame, *keep: str) -> DataFrame:
    """Rasters of decoded images (`sources.readers.scan_images`); colours by the weights of ITU-R 601-2. Columns: `keep` (path if not given), h, w, gray as bytes."""
    keep = keep or ("path",)

    @F.pandas_udf("binary")
    def mixed(data: pd.Series, n: pd.Series) -> pd.Series:
        def one(d: bytes, k: int) -> bytes:
            blue, green, red = np.frombuffer(d, np.uint8).reshape(-1, k)[:, :3].T.astype(np.int32)
            return (19595 * red + 38470 * green + 7471 * blue + 32768 >> 16).astype(np.uint8).tobytes()

        return pd.Series([d if k == 1 else one(d, k) for d, k in zip(data, n)], dtype=object)

    image = F.col("image")
    rows = images.filter("image is not null")
    return rows.select(*keep, image["height"].alias("h"), image["width"].alias("w"), mixed(image["data"], image["nChannels"]).alias("gray"))


def page_features(g: np.ndarray) -> list:
    """The 29 features of one page, (rows, columns) of grey values."""
    (h, w), ink = g.shape, g < 128
    band, cell, up, left = h // 4, w // 4, h // 2, w // 2
    share = lambda part, size: float(part) / size if size else None
    row, col = np.count_nonzero(ink, axis=1), np.count_nonzero(ink, axis=0)
    grid = np.count_nonzero(ink[: 4 * band, : 4 * cell].reshape(4, band, 4, cell), axis=(1, 3)).ravel() / (band * cell) if band and cell else [None] * 16
    r, c = np.flatnonzero(row / w > 0.01), np.flatnonzero(col / h > 0.01)
    margins = (r[0] / h, 1 - r[-1] / h, c[0] / w, 1 - c[-1] / w) if len(r) and len(c) else (0.5,) * 4
    # the Sobel operator; what lies beyond a border repeats it
    p = np.pad(g.astype(np.int16), 1, mode="edge")
    smooth, slope = p[:-2] + 2 * p[1:-1] + p[2:], p[2:] - p[:-2]
    across, along = (smooth[:, 2:] - smooth[:, :-2]).astype(np.int32), (slope[:, :-2] + 2 * slope[:, 1:-1] + slope[:, 2:]).astype(np.int32)
    q = across * across + along * along
    mean = float(np.sqrt(q).sum()) / q.size
    halves = share(row[:up].sum(), up * w), share(row[up:].sum(), (h - up) * w), share(col[:left].sum(), left * h), share(col[left:].sum(), (w - left) * h)
    blank = np.count_nonzero(row / w < 0.01) / h, np.count_nonzero(col / h < 0.01) / w
    return [share(row.sum(), h * w), *grid, *halves, *blank, *margins, mean, max(float(q.sum(dtype=np.int64)) / q.size - mean * mean, 0.0) ** 0.5]


def raster_features(px: DataFrame, *keep: str) -> DataFrame:
    """The 29 features of each page, in tasks, without a shuffle.

    Share of ink, overall and in a 4 x 4 grid (pixels beyond the last whole cell count overall; no cells,
    so null, on pages of fewer than four rows or columns); ink of the four halves (null for a half without
    pixels); shares of blank rows and columns; first and last rows and columns with ink as shares, 0.5 if
    the page lacks either; mean and population deviation of the Sobel magnitude, where borders repeat the
    edge pixel. The columns `keep` come first (doc_id if not given).
    """
    keep = keep or ("doc_id",)
    rows = px.select(*keep, "h", "w", "gray")
    names = [*keep, *RASTER]

    def run(batches):
        for b in batches:
            h, w, gray = (b.column(len(keep) + k) for k in range(3))
            found = []
            for m, n, g in zip(h.to_pylist(), w.to_pylist(), gray):
                values = np.frombuffer(g.as_buffer(), np.uint8) if pa.types.is_binary(g.type) or pa.types.is_large_binary(g.type) else g.values.flatten().to_numpy()
                found.append(page_features(values.reshape(m, n)))
            columns = zip(*found) if found else [()] * len(RASTER)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.float64()) for c in columns)], names=names)

    kept = rows.select(*keep).schema
    return rows.mapInArrow(run, T.StructType([*kept.fields, *(T.StructField(c, T.DoubleType()) for c in RASTER)]))


_PX = f"""select doc_id, h, {SIDE} as w, y, x, case when regexp_matches(substr(rpad(substr(text, y * {SIDE} + 1, {SIDE}), {SIDE}, ' '), x + 1, 1), '^[ \\t\\n\\r]$') then 255 else 0 end as gray
 from (select doc_id, text, h, unnest(range(h)) as y from (select doc_id, text, cast(ceil(length(text) / {SIDE}) as int) as h from documents) where h > 0) cross join (select unnest(range({SIDE})) as x)"""
_INK = "case when gray < 128 then 1.0::double else 0.0 end"


def _raster(spark, sf, *cols):
    return raster_features(packed_pages(view(spark, sf, "documents"))).select("doc_id", *cols)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *(F.round(c, 7).alias(c) for c in df.columns if c != "doc_id"))


@register("raster_density", f"select doc_id, round(avg({_INK}), 7) as ink, " + ", ".join(f"round(avg({_INK}) filter (h >= 4 and floor(y / floor(h / 4)) = {k // 4} and floor(x / 20) = {k % 4}), 7) as g{k}" for k in range(16)) + f" from ({_PX}) group by doc_id")
def q_density(spark, sf):
    return rounded(_raster(spark, sf, "ink", *GRID))


@register("raster_whitespace", f"select h.doc_id, top, bottom, left_half, right_half, blank_rows, blank_cols from (select doc_id, round(avg({_INK}) filter (y < floor(h / 2)), 7) as top, round(avg({_INK}) filter (y >= floor(h / 2)), 7) as bottom, round(avg({_INK}) filter (x < 40), 7) as left_half, round(avg({_INK}) filter (x >= 40), 7) as right_half from ({_PX}) group by doc_id) h join (select doc_id, round(avg(case when m < 0.01 then 1.0 else 0.0 end), 7) as blank_rows from (select doc_id, y, avg({_INK}) as m from ({_PX}) group by doc_id, y) group by doc_id) r on r.doc_id = h.doc_id join (select doc_id, round(avg(case when m < 0.01 then 1.0 else 0.0 end), 7) as blank_cols from (select doc_id, x, avg({_INK}) as m from ({_PX}) group by doc_id, x) group by doc_id) c on c.doc_id = h.doc_id")
def q_whitespace(spark, sf):
    return rounded(_raster(spark, sf, *RASTER[17:23]))


@register("raster_margins", f"select a.doc_id, round(case when t is null or l is null then 0.5 else t end, 7) as top_margin, round(case when t is null or l is null then 0.5 else b end, 7) as bottom_margin, round(case when t is null or l is null then 0.5 else l end, 7) as left_margin, round(case when t is null or l is null then 0.5 else r end, 7) as right_margin from (select doc_id, min(y) filter (m > 0.01) / any_value(h) as t, 1 - max(y) filter (m > 0.01) / any_value(h) as b from (select doc_id, h, y, avg({_INK}) as m from ({_PX}) group by doc_id, h, y) group by doc_id) a join (select doc_id, min(x) filter (m > 0.01) / 80 as l, 1 - max(x) filter (m > 0.01) / 80 as r from (select doc_id, x, avg({_INK}) as m from ({_PX}) group by doc_id, x) group by doc_id) c on c.doc_id = a.doc_id")
def q_margins(spark, sf):
    return rounded(_raster(spark, sf, *RASTER[23:27]))


_NB = lambda c, part, order, k: f"coalesce({'lag' if k > 0 else 'lead'}({c}) over (partition by doc_id, {part} order by {order}), {c})"


@register("raster_edges", f"select doc_id, round(avg(s), 6) as edge_mean, round(stddev_pop(s), 6) as edge_std from (select doc_id, sqrt(gx * gx + gy * gy) as s from (select doc_id, {_NB('sx', 'x', 'y', -1)} - {_NB('sx', 'x', 'y', 1)} as gy, {_NB('dx', 'x', 'y', 1)} + 2 * dx + {_NB('dx', 'x', 'y', -1)} as gx from (select doc_id, x, y, {_NB('gray', 'y', 'x', 1)} + 2 * gray + {_NB('gray', 'y', 'x', -1)} as sx, {_NB('gray', 'y', 'x', -1)} - {_NB('gray', 'y', 'x', 1)} as dx from ({_PX})))) group by doc_id")
def q_edges(spark, sf):
    return _raster(spark, sf, *RASTER[27:]).select("doc_id", *(F.round(c, 6).alias(c) for c in ("edge_mean", "edge_std")))


QUERIES, ORACLES = register.queries, register.oracles
