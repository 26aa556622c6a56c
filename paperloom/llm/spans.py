"""Span lists: array<struct<kind, start, end, base>> in code points, end exclusive.

base tells the spans of the plain patterns from those that an operator's method adds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_texts, slices

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("base", T.BooleanType(), False)]), False)
ARROW = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("base", pa.bool_(), False)]))


def with_spans(df: DataFrame, text_col: str, find) -> DataFrame:
    """Add a column `spans`: find(texts) gives the (kind, start, end, base) list of each of some texts.

    Null texts are passed on as empty ones; a column `spans` of the input is replaced.
    """
    df = df.drop("spans")
    column = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("spans", SPAN, False)])

    def run(batches):
        for big in batches:
            for b in slices(big, column):
                found = find([t or "" for t in b.column(column).to_pylist()])
                spans = pa.array([[dict(zip(("kind", "start", "end", "base"), span)) for span in one] for one in found], ARROW)
                yield pa.RecordBatch.from_arrays([*b.columns, spans], names=[*b.schema.names, "spans"])

    return over_texts(df, run, schema)


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end by start, then kind as listed, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and spans: all of them joined."""
    plain = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(plain, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return df.select("doc_id", *counts, F.sha2(joined(plain, base), 256).alias("base_sha256"), joined(F.col("spans"), kinds).alias("spans"))
