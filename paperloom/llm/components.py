"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, written


def _star(pairs: DataFrame, kept: str) -> DataFrame:
    """Link what is next to each u to the least of u and its neighbours; `kept` picks neighbours."""
    # The minima are written out so that neither join side is bound to an aggregate's partitions:
    # the many edges of a hot node can be split.
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = pairs.join(least.hint("merge"), "u")
    return joined.filter(kept).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: root is the least node of its component.

    edges has two long columns. Alternating large-star and small-star steps keep the number of
    edges; each step is an aggregate and a join, and its result is written out. Loops and repeated
    edges are allowed; no edges give no rows.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = written(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, last = mark, now
        with scratch():
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = written(_star(both, "v > u").distinct(), "edges")
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            low = down.groupBy("u").agg(F.min("v").alias("v"))
            now = written(_star(down, "v <> m").unionByName(low).distinct(), "edges", keep=True)
        discard(last)
