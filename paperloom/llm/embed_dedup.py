"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many directions, and each direction is a sorted line of projections. A
window in the middle of a line holds a constant share of all vectors; near its upper end it holds few,
and vectors that are alike reach the upper ends of the same lines. So a vector is entered on the lines
on which its projection is largest, and query-centred windows are opened there.

* Lines. A rule (lines, entered, width, least) is calibrated by simulated pairs at the threshold
  cosine: as many lines as keep LINE entries on each on average, the fewest entries of a vector with
  which RECALL of such pairs collide `least` times or more, and windows that hold WINDOW of the
  differences between such a pair's projections. Up to SINGLE lines are directions of their own; more
  of them are sums of a direction from either of two sets, so that a vector's highest lines are found
  without visiting all. The entries of a vector grow about as n ** 0.16.
* Counting. The entries of a line meet in one group, each with its vector and its other lines. A pair
  whose projections lie in each other's window collides; collisions are counted over all lines that two
  entries share. A pair belongs to the first line on which it collides, so it is counted once.
* Verifying. Pairs with `least` collisions get their cosine in double precision.

Rules come from the law of random directions, not from the data; every vector is entered. Lines with
more than BLOCK entries are dealt out in pairs of blocks; a group emits link counts and a star for each
cluster, never its pairs. Vectors link with others of their length only. The same rule
holds for every number of vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .common import scratch, table, written
from .components import connected_components

THRESHOLD = 0.9
RECALL, WINDOW = 0.99, 0.98
LINE, BLOCK, FEWEST = 1024, 2048, 32
SINGLE, MOST_ENTERED, TRIALS = 2048, 48, 3000
LEAST = 2
SEED = 31


@lru_cache(maxsize=8)
def directions(dims: int, n: int, part: int) -> np.ndarray:
    d = np.random.default_rng([SEED, dims, n, part]).standard_normal((dims, n))
    return d / np.linalg.norm(d, axis=0)


def highest(units: np.ndarray, lines: int, entered: int) -> tuple[np.ndarray, np.ndarray]:
    """The `entered` lines on which each vector's projection is largest, highest first, and the projections."""
    dims, many = units.shape[1], np.arange(len(units))[:, None]
    if lines <= SINGLE:
        at = units @ directions(dims, lines, 0)
        line = np.argpartition(-at, min(entered, lines) - 1, axis=1)[:, :entered]
        at = at[many, line]
    else:  # sums of one direction from either set; the highest sums are of the highest of both
        side = math.isqrt(lines - 1) + 1
        a, b = (units @ directions(dims, side, k) for k in (1, 2))
        keep = min(entered, side)
        i, j = (np.argpartition(-x, keep - 1, axis=1)[:, :keep] for x in (a, b))
        sums = ((a[many, i][:, :, None] + b[many, j][:, None, :]) / math.sqrt(2)).reshape(len(units), -1)
        best = np.argpartition(-sums, min(entered, sums.shape[1]) - 1, axis=1)[:, :entered]
        line = i[many, best // keep] * side + j[many, best % keep]
        at = sums[many, best]
    order = np.argsort(-at, axis=1, kind="stable")
    return line[many, order].astype(np.int64), at[many, order].astype(np.float32)


def planted_pairs(dims: int, cosine: float, n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors of one cosine, otherwise uniform."""
    rng = np.random.default_rng([seed, dims])
    x, y = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(1 - cosine**2) * y


def counting_rule(dims: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, float, int]:
    """(lines, entered, width, least) for n vectors: at least FEWEST lines, however few vectors there are.

    Where no number of entries reaches the recall (few dimensions), there are fewer lines, down to one without a
    window, on which all pairs are verified.
    """
    if dims < 2:
        return 1, 1, math.inf, 1
    x, y = planted_pairs(dims, threshold, TRIALS)
    step = np.sort(np.abs((x - y) @ directions(dims, 64, 9)).ravel())
    width = float(step[int(WINDOW * (len(step) - 1))])
    lines = max(FEWEST, 8 * n // LINE)
    while lines > 1:
        most = min(MOST_ENTERED, lines)
        (a, at_a), (b, at_b) = (highest(v, lines, most) for v in (x, y))
        met = (a[:, :, None] == b[:, None, :]) & (np.abs(at_a[:, :, None] - at_b[:, None, :]) <= width)
        for entered in range(2, most + 1):
            if (met[:, :entered, :entered].sum((1, 2)) >= LEAST).mean() >= recall:
                return lines, entered, width, LEAST
        lines //= 2
    return 1, 1, math.inf, 1


def usable(vector):
    """Not null, not empty, not zero, all components finite."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(flat: np.ndarray, dims: int) -> np.ndarray:
    x = np.asarray(flat, dtype=np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of large or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def collisions(a, b, own: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """For two blocks of entries (lines, projections): how often each pair collides, and whether `own` is its first line.

    A row's lines are distinct. Each line that both blocks hold adds its window collisions.
    """
    count = np.zeros((len(a[0]), len(b[0])), dtype=np.uint8)
    first, here = np.ones(count.shape, dtype=bool), np.zeros(count.shape, dtype=bool)

    def by_line(lines, at):
        flat = lines.ravel()
        order = np.argsort(flat, kind="stable")
        line, start = np.unique(flat[order], return_index=True)
        return line, np.append(start, len(flat)), order // lines.shape[1], at.ravel()[order]

    (line_a, start_a, row_a, at_a), (line_b, start_b, row_b, at_b) = by_line(*a), by_line(*b)
    both, i, j = np.intersect1d(line_a, line_b, assume_unique=True, return_indices=True)
    for line, i, j in zip(both, i, j):
        i, j = slice(start_a[i], start_a[i + 1]), slice(start_b[j], start_b[j + 1])
        hit = np.abs(at_a[i, None] - at_b[None, j]) <= width
        cell = np.ix_(row_a[i], row_b[j])
        count[cell] += hit
        if line < own:
            first[cell] &= ~hit
        elif line == own:
            here[cell] = hit
    return count, first & here


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, n) over a stored (uid, vector): n links of u were seen in a group, where its star's root is v."""
    # one row for each length of vectors, of which there are no more than components in the longest
    sizes = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()
    rules = {r["dims"]: counting_rule(r["dims"], r["n"], threshold) for r in sizes}

    def place(batches):
        for big in batches:
            for k in range(0, big.num_rows, 1024):
                b = big.slice(k, 1024)
                lengths, flat = b.column(1).value_lengths().to_numpy(), b.column(1).flatten().to_numpy()
                starts = np.cumsum(lengths) - lengths
                for dims in np.unique(lengths):
                    rows = np.flatnonzero(lengths == dims)
                    lines, entered, _, _ = rules[int(dims)]
                    own = flat if len(rows) == len(lengths) else flat[(starts[rows][:, None] + np.arange(dims)).ravel()]
                    line, at = highest(units(own, int(dims)), lines, entered)
                    ends = pa.array(np.arange(0, line.size + 1, line.shape[1], dtype=np.int32))
                    taken = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.ListArray.from_arrays(ends, pa.array(line.ravel())), pa.ListArray.from_arrays(ends, pa.array(at.ravel()))], names=["uid", "vector", "lines", "at"])

    kind = vectors.schema["vector"].dataType.simpleString()
    placed = written(vectors.select("uid", "vector").mapInArrow(place, f"uid long, vector {kind}, lines array<long>, at array<float>"), "placed")
    entries = placed.select(F.size("vector").alias("dims"), F.explode("lines").alias("line"), "uid", "vector", "lines", "at")
    pairs = cells.dealt(entries, ["dims", "line"], "uid", BLOCK)

    def linked(group: pa.Table) -> pa.Table:
        dims, own, same = group["dims"][0].as_py(), group["line"][0].as_py(), group["p"][0].as_py() == group["q"][0].as_py()
        _, entered, width, least = rules[dims]
        group = group.sort_by("uid").combine_chunks()
        flat = lambda name: group[name].combine_chunks().flatten().to_numpy() if group.num_rows else np.zeros(0)
        uid, side = group["uid"].to_numpy(), group["side"].to_numpy()
        x, lines, at = units(flat("vector"), dims), flat("lines").reshape(-1, entered), flat("at").reshape(-1, entered)
        i_of = np.flatnonzero(side == 0)
        j_of = i_of if same else np.flatnonzero(side == 1)
        heads, tails = [], []
        for k in range(0, len(i_of), 512):
            a = i_of[k : k + 512]
            count, first = collisions((lines[a], at[a]), (lines[j_of], at[j_of]), own, width)
            mask = first & (count >= least)
            if same:
                mask &= uid[a][:, None] < uid[j_of][None, :]
            i, j = np.nonzero(mask)
            if len(i) > mask.size // 16:
                true = (x[a] @ x[j_of].T)[i, j] >= threshold
            else:
                true = np.concatenate([np.einsum("ij,ij->i", x[a[i[c : c + 8192]]], x[j_of[j[c : c + 8192]]]) for c in range(0, len(i), 8192)] or [np.zeros(0)]) >= threshold
            heads.append(a[i[true]])
            tails.append(j_of[j[true]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *e]) for e in (heads, tails))
        links = np.bincount(np.concatenate([a, b]), minlength=len(uid))
        root, some = cells.stars(a, b, len(uid)), np.flatnonzero(links)
        return pa.table({"u": uid[some], "v": uid[root[some]], "n": links[some].astype(np.int64)})

    return pairs.groupBy("dims", "line", "p", "q").applyInArrow(linked, "u long, v long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, not finite or hold nulls link with nothing; others link with
    those of their own length. Rows may share an id: each is a vector of its own. An empty table
    gives no rows; other columns of df play no part.
    """
    rows = written(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    with scratch():
        found = written(near_pairs(rows.filter(usable(F.col("vector"))), threshold), "links")
        roots = written(connected_components(found.select("u", "v")), "roots")
        ids = rows.select("uid", "id")
        named = roots.join(ids.hint("merge"), roots["node"] == ids["uid"]).select("node", "root", "id")
        least = written(named.groupBy("root").agg(F.min("id").alias("component")), "components")
        links = found.groupBy("u").agg(F.sum("n").alias("n_links"))
        known = written(roots.join(least.hint("merge"), "root").join(links.hint("merge"), F.col("node") == F.col("u")).select("node", "component", "n_links"), "known", keep=True)
    out = ids.join(known.hint("merge"), ids["uid"] == known["node"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op4_embeddings(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op4_embeddings": op4_embeddings}
ORACLES = {
    "op4_embeddings": """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    c AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u),
    m AS (SELECT u, min(v) AS component_id FROM c GROUP BY u),
    n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
    FROM embeddings e JOIN m ON m.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""
}
