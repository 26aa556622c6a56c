"""SimHash near-dedup over a vantage-point tree in Hamming space.

Fingerprints: a word shingle's XXH64 (seed 42) votes on 64 bits; a bit is set if more than half the
shingles set it. Distinct fingerprints are partitioned by a vantage-point tree: a node holds a
vantage point and a radius, and a fingerprint's home is the leaf that its distances lead to. The
triangle bound says which other leaves can hold fingerprints within the link distance: those across
a border that is not farther off. A fingerprint visits these leaves as well; of two leaves the later
one sees the pair, so nothing is missed and pairs are exact. Leaves with many fingerprints are dealt
out in pairs of blocks.

The tree is fitted on a sample chosen by hash that grows with the fingerprints, so that leaves stay
as large as asked for; MOST bounds it (8 bytes each on the driver). A tree is sent as flat arrays of
some 20 bytes a node. What a group of blocks emits is a star for each linked cluster, not its pairs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cells
from .common import over_texts, scratch, set_aside, slices, table, written
from .components import connected_components

WORDS, BITS = 3, 2
SAMPLE, SHARE, MOST = 1 << 16, 1 / 64, 1 << 22
CANDIDATES, FIT = 16, 4096
STEP = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if words are fewer; none without words.

    bytes.lower() and bytes.split() know A-Z and the six ASCII blanks only, as is asked for. Long texts
    are cut at blanks, so the words of a part exist at a time.
    """
    data, at, out, last, n = text.encode("utf-8", "surrogatepass").lower(), 0, [], [], 0
    while at < len(data):
        end = min(len(data), at + STEP)
        if end < len(data):
            end = m.start() if (m := BLANK.search(data, end)) else len(data)
        w = last + data[at:end].split()
        n, at = n + len(w) - len(last), end
        if len(w) >= words:
            several = zip(*(islice(w, k, None) for k in range(words)))
            out.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in several), dtype=np.uint64, count=len(w) - words + 1))
        last = w[len(w) - words + 1 :] if len(w) >= words else w
    if 0 < n < words:
        out.append(np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)], dtype=np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def voted(hashed: np.ndarray) -> int:
    """The fingerprint of some shingles' hashes, as a signed number; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashed), 4096):
        part = hashed[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed)).tobytes(), "big", signed=True)


def fingerprint(text: str, words: int = WORDS) -> int:
    return voted(hashes(text, words))


def with_fingerprints(df: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Add fp, a signed 64-bit number. Null texts count as empty: no words, fingerprint 0."""
    df = df.drop("fp")
    column = df.columns.index(text_col)

    def run(batches):
        for big in batches:
            for b in slices(big, column):
                fps = np.array([fingerprint(t or "", words) for t in b.column(column).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "fp"])

    return over_texts(df, run, T.StructType([*df.schema.fields, T.StructField("fp", T.LongType(), False)]))


@dataclass
class Tree:
    """Nodes in order of creation: inside is distance to the vantage point <= radius. A node with leaf >= 0 is a leaf; leaves are numbered from left (inside) to right."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaf: np.ndarray


def build_tree(sample: np.ndarray, capacity: int, bits: int = BITS) -> Tree:
    """A tree whose leaves hold at most `capacity` of the sample where a border can part them well.

    Borders are chosen on at most FIT of a node's points.
    """
    rng = np.random.default_rng(5)
    nodes: list[list[int]] = []  # vantage, radius, inside, outside, leaf
    leaves, todo = 0, [(np.unique(sample), -1, 0)]
    while todo:  # the left side is on top, so leaves come up from left to right
        points, parent, side = todo.pop()
        best = None
        if len(points) > max(1, capacity):
            some = points if len(points) <= FIT else points[rng.choice(len(points), FIT, replace=False)]
            for v in some[rng.choice(len(some), min(CANDIDATES, len(some)), replace=False)]:
                upto = np.cumsum(np.bincount(np.bitwise_count(some ^ v), minlength=65)) / len(some)
                for r in np.flatnonzero((upto >= 0.25) & (upto <= 0.75)):
                    seen = upto[min(64, r + bits)] + 1 - (upto[r - bits] if r >= bits else 0)
                    cost = math.log(seen) / -(upto[r] * math.log(upto[r]) + (1 - upto[r]) * math.log(1 - upto[r]))
                    best = min(best or (math.inf,), (cost, int(v), int(r)))
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        if best is None or best[0] > 0.95:  # nearly all would be seen from both sides
            nodes.append([0, 0, -1, -1, leaves])
            leaves += 1
            continue
        near = np.bitwise_count(points ^ np.uint64(best[1])) <= best[2]
        todo += [(points[~near], len(nodes), 3), (points[near], len(nodes), 2)]
        nodes.append([best[1], best[2], -1, -1, -1])
    columns = list(zip(*nodes))
    return Tree(np.array(columns[0], dtype=np.uint64), np.array(columns[1], dtype=np.int16), *(np.array(c, dtype=np.int32) for c in columns[2:]))


def route(tree: Tree, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home): each fingerprint's home and the later leaves that it visits."""
    every = np.arange(len(fps))
    # later: whether the home leaf is known to lie to the left of the node
    found, todo = [], [(0, every, np.ones(len(fps), bool), np.zeros(len(fps), bool))]
    while todo:
        node, at, home, later = todo.pop()
        if not len(at):
            continue
        if tree.leaf[node] >= 0:
            found.append((at, np.full(len(at), tree.leaf[node]), home))
            continue
        d, radius = np.bitwise_count(fps[at] ^ tree.vantage[node]).astype(np.int64), tree.radius[node]
        inside = d <= radius
        # to the left only those at home there or visiting from further left
        left = (inside & home) | (later & (d - bits <= radius))
        right = (home | later) & (d + bits > radius)
        todo.append((tree.inside[node], at[left], (home & inside)[left], later[left]))
        todo.append((tree.outside[node], at[right], (home & ~inside)[right], (later | (home & inside))[right]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (every, every, every.astype(bool))


def links(fps: DataFrame, bits: int = BITS, sample: int | None = None, leaf: int | None = None) -> DataFrame:
    """(u, v) over a table of distinct fingerprints `fp`: stars that connect all within `bits`."""
    n = fps.count()
    spark = fps.sparkSession
    sample = sample or min(MOST, max(SAMPLE, int(n * SHARE)))
    drawn = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(max(1, (sample << 30) // max(n, 1)))) if n > sample else fps
    points = drawn.select("fp").toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    # crowded leaves cost comparisons, small ones visits: the square root balances both
    leaf = leaf or min(8192, max(512, 4 * math.isqrt(n)))
    sent = spark.sparkContext.broadcast(build_tree(np.sort(points), max(4, leaf * len(points) // max(n, 1)), bits))

    def place(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at, cell, home = route(sent.value, own.view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home), pa.array(own[at])], names=["cell", "home", "fp"])

    routed = written(fps.select("fp").mapInArrow(place, "cell int, home boolean, fp long"), "routed")
    pairs = cells.block_pairs(routed, "fp")

    def linked(group: pa.Table) -> pa.Table:
        fp, side = group["fp"].to_numpy(), group["side"].to_numpy()
        same = group["p"][0].as_py() == group["q"][0].as_py()
        x = np.sort(fp[side == 0])
        y = x if same else np.sort(fp[side == 1])
        every, ends = np.concatenate([x, y]), []
        for k in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(x[k : k + 256, None].view(np.uint64) ^ y[None, :].view(np.uint64)) <= bits)
            i = i + k
            keep = i < j if same else slice(None)
            ends.append((i[keep], j[keep] + (0 if same else len(x))))
        a, b = (np.concatenate([np.zeros(0, np.int64), *e]) for e in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
        root = cells.stars(a, b, len(every))
        u = np.flatnonzero(root != np.arange(len(every)))
        return pa.table({"u": every[u], "v": every[root[u]]})

    return pairs.groupBy("cell", "p", "q").applyInArrow(linked, "u long, v long")


def _labels(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint of a stored table: the least one that links reach."""
    distinct = written(rows.select("fp").distinct(), "distinct")
    roots = written(connected_components(links(distinct, bits)), "roots")
    return written(distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "labels")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) for each row: the least id that links of at most `bits` bits reach.

    Equal fingerprints are linked, so null, empty and blank texts (fingerprint 0) form one group. Ids
    that are null count as larger than all; a group of null ids has a null component. Rows may share an
    id or repeat; each gives a row.
    """
    rows = written(with_fingerprints(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", words).select("_id", "fp"), "fingerprints")
    with scratch():
        labels = _labels(rows, bits)
        firsts = rows.groupBy("fp").agg(F.min("_id").alias("first")).join(labels.hint("merge"), "fp")
        least = written(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "components")
        known = written(labels.join(least.hint("merge"), "root").select("fp", "component_id"), "known", keep=True)
    return rows.join(known.hint("merge"), "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each group stays, that with the least id; all columns are kept, whatever their names.

    A null id is above all others; of rows that tie, repeated rows among them, one stays. Rows are
    numbered once, and both sides of the last join read these numbers.
    """
    own, at = set_aside(df)
    numbered = written(own.withColumn("_rid", F.monotonically_increasing_id()), "numbered")
    found = with_fingerprints(numbered.select("_rid", F.col(at[id_col]).alias("_id"), F.col(at[text_col]).alias("_text")), "_text", words)
    with scratch():
        rows = written(found.select("fp", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid")).alias("row")), "fingerprints")
        firsts = rows.groupBy("fp").agg(F.min("row").alias("row")).join(_labels(rows, bits).hint("merge"), "fp")
        kept = written(firsts.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.rid").alias("_rid")), "kept", keep=True)
    return numbered.join(kept.hint("merge"), "_rid", "left_semi").drop("_rid").toDF(*df.columns)


def op2_simhash(spark, sf_dir):
    found = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
