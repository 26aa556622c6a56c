"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a text are its words (A-Z lowered, hashed to WORDS places), stretches of three runs of
character classes (lower case, upper case, digit, blank, newline, other script, each punctuation mark
by itself; hashed to TRIPLES places) and whether a word repeats the one before it. Counts, as square
roots of shares within each kind and weighted by inverse document frequency, are reduced to DIMS
latent-semantic axes (truncated SVD over the labelled sample). The labelled vectors, at most SAMPLE of
them, are sent to all executors (SAMPLE * DIMS * 4 bytes: 1 MB); each document's cosines with all of
them are exact, computed block by block, and its NEIGHBOURS nearest vote with weight cosine ** POWER.
Cosines are taken to 5 decimals; of equal ones the neighbour with the smaller id votes first. A text
does not vote for itself: labelled texts that equal it, letter by letter, are left out.

The bound on the labelled sample is a parameter; which rows it holds is decided by a hash of doc_id
among rows whose crc32(doc_id as text) mod 4 is not 2. Labels, lang, source and doc_id are never
inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_texts, slices, table

SAMPLE, DIMS, NEIGHBOURS, POWER = 4096, 64, 48, 8
KEEP = 0.7
TRIPLES, WORDS = 2048, 2048
TERMS = TRIPLES + 2 + WORDS
ROWS = 256
CLASSES = 40


def classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 other script, then marks."""
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = np.full(256, 5, dtype=np.int64)
    out[:32] = out[32] = 3
    out[10] = 4
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 6 + marks.index(b) if b in marks else out[b]
    return out


CLASS_OF = classes()


LOWERED = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Powers of an odd number, by place in a word; places repeat from PLACES on.
PLACES = 64
POWERS = np.cumprod(np.full(PLACES, 0x9E3779B97F4A7C15, dtype=np.uint64))


def word_places(b: np.ndarray) -> np.ndarray:
    """Hashed place of each word of some bytes, A-Z lowered."""
    blank = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return starts
    inside = ~blank[1:-1]
    at = np.flatnonzero(inside) - np.repeat(starts, ends - starts)
    letters = LOWERED[b[inside]].astype(np.uint64) + np.uint64(1)
    mixed = np.add.reduceat(letters * POWERS[at % PLACES], np.cumsum(np.concatenate([[0], (ends - starts)[:-1]])))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % WORDS


def terms(texts: list[str]) -> np.ndarray:
    """Square roots of term shares, a row for each text; the empty text has a row of zeros."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace")
        raw = np.frombuffer(b, dtype=np.uint8)
        c = CLASS_OF[raw]
        c = c[np.concatenate([[True], c[1:] != c[:-1]])] if len(c) else c
        if len(c) > 2:
            code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            out[i, :TRIPLES] = np.bincount((code * 2654435761 >> 11) % TRIPLES, minlength=TRIPLES) / len(code)
        places = word_places(raw)
        if len(places):
            words = b.split()
            again = sum(map(bytes.__eq__, words, words[1:])) / len(words)
            out[i, TRIPLES : TRIPLES + 2] = again, 1 - again
            out[i, TRIPLES + 2 :] = np.bincount(places, minlength=WORDS) / len(places)
    return np.sqrt(out)


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class Model:
    """Axes and labelled vectors, in the order of their ids; keys tell equal texts."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, keys: np.ndarray):
        df = (rows > 0).sum(0)
        self.weights = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
        self.axes = (self.weights[:, None] * principal(rows * self.weights, DIMS)).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.keys = keys.astype(np.uint64)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.vectors = self.latent(rows)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        v = rows @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' votes; the prior where nothing votes."""
        n = len(self.labels)
        if not n:
            return np.full(len(rows), self.prior)
        cosines = np.rint((self.latent(rows) @ self.vectors.T).astype(np.float64) * 1e5).astype(np.int64)
        cosines[keys.astype(np.uint64)[:, None] == self.keys[None, :]] = -(10**6)
        # one number for each: by cosine, then by id
        ranked, k = cosines * n - np.arange(n), min(NEIGHBOURS, n)
        near = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, 1) / 1e5, 0) ** POWER
        return ((votes * self.labels[near]).sum(1) + 1e-9 * self.prior) / (votes.sum(1) + 1e-9)


def principal(rows: np.ndarray, dims: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(3).standard_normal((rows.shape[1], min(dims + 16, rows.shape[1]))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(8):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    inner = rows @ basis
    turned = np.linalg.eigh(inner.T @ inner)[1][:, ::-1]
    return basis @ turned[:, :dims]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold.

    Ids may be of any type that can be compared; null ids and labels are left out. Of several labels of
    an id the least counts, of several texts of an id that with the least hash. The driver gets term
    rows of the sample alone: sample * TERMS * 2 bytes at most, 34 MB.
    """
    known = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    # one text for each labelled id, even if documents repeat it
    once = texts.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t"), F.first("_label").alias("label")).select("_id", "label", "t._text")

    def run(batches):
        for big in batches:
            for b in slices(big, 2, ROWS):
                some = b.column(2).to_pylist()
                rows = terms(some).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([text_key(t) - 2**63 for t in some], pa.int64())], names=["id", "label", "terms", "key"])

    kind = once.schema["_id"].dataType.simpleString()
    got = over_texts(once, run, f"id {kind}, label int, terms binary, key long").toArrow().sort_by("id")
    rows = np.frombuffer(b"".join(got["terms"].to_pylist()), dtype=np.float16).reshape(-1, TERMS).astype(np.float32)
    keys = np.array([k + 2**63 for k in got["key"].to_pylist()], dtype=np.uint64)
    return Model(rows, np.array(got["label"].to_pylist(), dtype=np.float32), keys)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier), row by row; a column `score` is replaced.

    Null and empty texts get the sample's share of 1. Equal texts get equal scores.
    """
    df, sent = df.drop("score"), df.sparkSession.sparkContext.broadcast(model)
    column = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for big in batches:
            for b in slices(big, column, ROWS):
                some = [t or "" for t in b.column(column).to_pylist()]
                scores = sent.value.score(terms(some), np.array([text_key(t) for t in some], dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(scores, 0, 1), pa.float64())], names=[*b.schema.names, "score"])

    return over_texts(df, run, schema)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
