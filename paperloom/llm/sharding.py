"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets its rank in the total order of its values as global row number, computed without
a single-task sort: distinct rows are range-partitioned, each partition is numbered from 0, and
the (few) partition sizes give each partition's offset. A keyed Feistel network on [0, s*s), with
s = ceil(sqrt(N)), permutes the numbers; a value that falls outside [0, N) is fed in again (cycle
walking), which keeps the map a permutation of [0, N). From a permuted position p the place is
plain arithmetic: shard = p mod n, slot = p div n. So the law is `rows`: shard sizes differ by at
most one and slots are gapless.

The numbers depend on the rows' values alone, so reruns, other cluster sizes and lost executors
give the same layout. Rows that are equal in every column are interchangeable.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import set_aside, table, written

PRIME = 2147483647
ROUNDS = 6
WALK = 66
SHARDS = 16
SEED = 20240607
COPY_RUN = 65536


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1 << 20, PRIME), rng.randrange(PRIME), rng.randrange(1 << 20, PRIME)) for _ in range(ROUNDS)]


def number_rows(df: DataFrame, out: str = "global_row") -> DataFrame:
    """Add the 0-based rank of each row in the order of all its columns.

    Repeated rows are counted before they are shuffled and dealt out again as numbered copies, so a
    row that makes up a third of the table is no hot key. Nulls rank first. Columns must be
    orderable. An existing column called `out` is replaced; others may have any name.
    """
    df = df.drop(out)
    own, names = set_aside(df)
    cols = [*names.values()]
    counted = own.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    runs = counted.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPY_RUN})")))
    copies = runs.withColumn("_copy", F.explode(F.expr(f"sequence(_run * {COPY_RUN}, least(_n, (_run + 1) * {COPY_RUN}) - 1)")))
    order = [F.col(c) for c in [*cols, "_copy"]]
    placed = copies.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    # one row for each partition of the shuffle above: bounded by its partition count
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return joined.select(*cols, (F.col("_off") + row)).toDF(*df.columns, out)


def permuted(col: str, n: int, seed: int) -> str:
    """SQL for the place of row number `col` under the permutation of [0, n)."""
    s = max(1, math.isqrt(max(n - 1, 0)) + 1)
    keys = ", ".join(f"named_struct('a', {a}L, 'b', {b}L, 'c', {c}L)" for a, b, c in round_keys(seed))
    mix = f"((acc.r % {PRIME}L * k.a + k.b) % {PRIME}L)"
    f = f"(({mix} ^ shiftright({mix}, 13)) % {PRIME}L * k.c % {PRIME}L)"
    step = f"aggregate(array({keys}), named_struct('l', x div {s}L, 'r', x % {s}L), (acc, k) -> named_struct('l', acc.r, 'r', (acc.l + {f}) % {s}L), acc -> acc.l * {s}L + acc.r)"
    walked = f"aggregate(sequence(1, {WALK}), named_struct('x', {col}, 'go', true), (w, i) -> if(w.go, transform(array(w.x), x -> named_struct('x', {step}, 'go', {step} >= {n}L))[0], w), w -> if(w.go, cast(raise_error('the walk did not end') as bigint), w.x))"
    return walked


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add global_row, position (its permuted place), shard and slot to every row.

    An empty table gives an empty table. Columns of these names in the input are replaced.
    """
    df = df.drop("global_row", "position", "shard", "slot")
    rows = number_rows(df)
    n = rows.count()
    placed = rows.withColumn("position", F.expr(permuted("global_row", n, seed)))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the rows as `shards` folders shard=0.., each in the order of its slots.

    A shard is cut into slot ranges, so its writing is not one task's work.
    """
    placed = shard_rows(df, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir):
    """Null texts count as empty: size 1 and checksum 0."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """crc32 is no function of DuckDB: it is folded there over the bytes with the polynomial's table."""
    step = "SELECT start, step, x // s AS l, x % s AS r FROM walk, dims WHERE step = 0 OR x >= n"
    for a, b, c in round_keys(SEED):
        mix = f"((r % {PRIME} * {a} + {b}) % {PRIME})"
        step = f"SELECT start, step, r AS l, (l + (xor({mix}, {mix} >> 13) % {PRIME} * {c}) % {PRIME}) % s AS r FROM ({step}), dims"
    return f"""
    WITH RECURSIVE tab AS (
      SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
    hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    bytes AS (SELECT doc_id, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexed),
    sums AS (
      SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
        CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
      FROM bytes, tab),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS rn FROM sums),
    dims AS (SELECT count(*) AS n, CAST(ceil(sqrt(greatest(count(*), 1))) AS BIGINT) AS s FROM documents),
    walk AS (
      SELECT rn AS start, rn AS x, 0 AS step FROM numbered
      UNION ALL
      SELECT start, l * s + r AS x, step + 1 AS step FROM ({step}), dims)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INTEGER) AS shard, x // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM numbered JOIN (SELECT start, x FROM walk, dims WHERE step > 0 AND x < n) ON start = rn"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": _oracle()}
