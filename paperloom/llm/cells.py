"""Joins inside the cells of a space partition, without one task for a crowded cell.

Every row has a home cell and visits the other cells in which it may have neighbours. A pair shows
up where one of the two is at home. Cells are dealt out in pairs of blocks of BLOCK rows, so the
work of a crowded cell is spread over many groups of the same size, and no row is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096


def block_pairs(rows: DataFrame, key: str, block: int = BLOCK, few: int = 100_000) -> DataFrame:
    """Rows (cell, home, key, ...) -> the same with (p, q, side): a group for each pair of blocks.

    In a group with p = q all rows are at home and side is 0; else side 0 is block p, at home, and
    side 1 is block q, at home or visiting. The list of cells is sent to all executors if it has at
    most `few` rows, and merged else.
    """
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("nh"), F.count_if(~F.col("home")).alias("nv")).filter("nh > 0 and nh + nv > 1")
    sizes = written(sizes.select("cell", F.ceil(F.col("nh") / block).cast("int").alias("kh"), F.ceil(F.col("nv") / block).cast("int").alias("kv")), "cells")
    sized = rows.join(F.broadcast(sizes) if sizes.count() <= few else sizes.hint("merge"), "cell")
    own = F.pmod(F.xxhash64(key, F.lit(7)), F.when(F.col("home"), F.col("kh")).otherwise(F.col("kv"))).cast("int")
    sized = sized.withColumn("own", own)
    at_home = "transform(sequence(0, kh + kv - 1), j -> named_struct('p', least(own, j), 'q', greatest(own, j), 'side', cast(own > j as int)))"
    away = "transform(sequence(0, kh - 1), i -> named_struct('p', i, 'q', kh + own, 'side', 1))"
    spread = sized.withColumn("g", F.explode(F.expr(f"if(home, {at_home}, {away})")))
    return spread.select(*rows.columns, "g.p", "g.q", "g.side")


def dealt(rows: DataFrame, cell: list[str], key: str, block: int = BLOCK, few: int = 100_000) -> DataFrame:
    """Rows of cells in which all are at home, with (p, q, side) as in block_pairs.

    Cells of up to `block` rows are one group. The list of larger ones is sent to all executors if it
    has at most `few` rows, and merged else.
    """
    large = written(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(*cell, F.ceil(F.col("_n") / block).cast("int").alias("_k")), "large-cells")
    sized = rows.join(F.broadcast(large) if large.count() <= few else large.hint("merge"), cell, "left")
    sized = sized.withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(key, F.lit(7)), F.col("_k")).cast("int"))
    spread = sized.withColumn("g", F.explode(F.expr("transform(sequence(0, _k - 1), j -> named_struct('p', least(_own, j), 'q', greatest(_own, j), 'side', cast(_own > j as int)))")))
    return spread.select(*rows.columns, "g.p", "g.q", "g.side")


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n points and links a[i] - b[i]: the least point reachable from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
