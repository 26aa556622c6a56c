"""Exact dedup by content-defined chunk recipes.

A text (A-Z lowered) is cut at places that its own content sets: after MIN_CHUNK characters at the
next sentence end or newline, at MAX_CHUNK at the latest. The distinct chunk texts are gathered
once; that shows whether two different chunks share a 64-bit hash. Those that do get an ordinal
from the order of their texts, so (hash, ordinal) is an identifier verified against the text. A
document's recipe is the ordered list of its chunk identifiers, and texts are equal exactly when
recipes are. After the one pass that verifies the chunks, only recipes move, never documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, scratch, set_aside, table, written

MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunks_of(norm, low: int = MIN_CHUNK, high: int = MAX_CHUNK):
    """The chunks of a text, in order; joined they are the text. The empty text has none."""
    pattern = rf"(?s).{{{low},{high}}}?(?:(?<=[.!?\n])|\z)|.{{1,{high}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", low: int = MIN_CHUNK, high: int = MAX_CHUNK, hashed=F.xxhash64, rid=None) -> DataFrame:
    """(_rid, id, text_sha256, recipe) for each row of a stored table; _rid numbers its rows.

    rid: a stored column with numbers of the rows. Numbers made here hold for the returned table
    alone, since another scan may split the files otherwise.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select((F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("_rid"), F.col(id_col).alias("_id"), norm.alias("_norm"))
    rows = rows.select("_rid", "_id", F.sha2("_norm", 256).alias("text_sha256"), chunks_of(F.col("_norm"), low, high).alias("_chunks"))
    known = rows.select(F.explode("_chunks").alias("chunk")).select(hashed("chunk").alias("h"), "chunk").distinct()
    shared = written(known.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    if shared.isEmpty():
        return written(rows.select("_rid", "_id", "text_sha256", F.transform("_chunks", lambda c: hashed(c)).alias("recipe")), "recipes")
    ordinals = known.join(shared.hint("merge"), "h").select("h", "chunk", (F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1).cast("long").alias("ordinal"))
    parts = rows.select("_rid", "_id", "text_sha256", F.posexplode_outer("_chunks").alias("pos", "chunk")).withColumn("h", hashed("chunk"))
    parts = parts.join(ordinals.hint("merge"), ["h", "chunk"], "left").drop("chunk")
    whole = parts.groupBy("_rid", "_id", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "h", F.coalesce("ordinal", F.lit(0)).alias("o"))))).alias("parts"))
    return written(whole.select("_rid", "_id", "text_sha256", F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["o"]))).alias("recipe")), "recipes")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **cut) -> DataFrame:
    """One row per row of df: _rid, id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty ones. Of equal texts the row with the
    largest id stays; a null id is below all others, and of rows that tie one stays. Other columns
    of df play no part, whatever their names.
    """
    rows = recipes(df, text_col, id_col, **cut).withColumn("_key", F.xxhash64("recipe"))
    low = F.lit(-(2**63))
    groups = rows.groupBy("_key", "recipe").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"), F.max_by("_rid", F.coalesce("_id", low)).alias("_keep_rid")).filter("_n > 1")
    # a hot recipe is one row of `groups`; as a table of its own it does not tie the join to the
    # aggregate's partitions, so the join's large side can be split
    groups = written(groups, "groups")
    found = rows.join(groups.hint("merge"), ["_key", "recipe"], "left")
    return found.select(
        "_rid",
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | (F.col("_rid") == F.col("_keep_rid"))).alias("kept"),
        "text_sha256",
    )


def without_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. They are numbered once, and both sides read that."""
    own, at = set_aside(df)
    numbered = written(own.withColumn("_rid", F.monotonically_increasing_id()), "numbered")
    with scratch():
        kept = written(exact_dedup(numbered, at[text_col], at[id_col], rid="_rid").filter("kept").select("_rid"), "kept", keep=True)
    return numbered.join(kept.hint("merge"), "_rid", "left_semi").drop("_rid").toDF(*df.columns)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_rid")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY norm)"""
}
