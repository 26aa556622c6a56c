"""Merkle dataset manifest with octopus multiproofs.

Leaves are digests of rows, in order of (source, id, leaf). Each source has a tree of its own; runs of
FAN nodes become their digest until one is left, the source's subroot; subroots in order of their
sources form the top tree in the same way. manifest() builds the node table level by level, each level
one shuffle of a FAN-th of the rows of the one below, so no source, however large, meets in one task.

prove() deals the leaves that are asked for to blocks of BLOCK consecutive leaf places. A block's leaves
share most of their way to the root: an octopus multiproof takes the minimal union of coordinates
(tree, level, place) that can't be derived from the block itself, all blocks fetch theirs by one join,
derive the interiors that they share, and expand the proof of each leaf locally.

Null sources rank first, as do null ids. Rows that are equal in id, source and leaf are interchangeable.
An empty table has no root (None) and no proofs. A source with one row has its leaf as subroot.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, table, written
from .sharding import number_rows

FAN, BLOCK = 16, 4096
TOP = -1
FEW = 10_000
HEX = 64


def encoded(*cols):
    """The values one after the other, each as its number of UTF-8 bytes, `:` and itself; null is `-`."""
    text = [c.cast("string") for c in cols]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def leaf_of(*cols):
    return F.sha2(encoded(*cols), 256)


@dataclass
class Manifest:
    """leaves: (id, tree, place, size, row, leaf, claim); nodes: (tree, level, place, digest).

    tree numbers the sources in their order; the top tree is TOP, and the place of a subroot in it is the
    number of its source. size: leaves of the tree. row: place among all leaves. claim: the leaf to be
    verified, null where it is the leaf itself. sources: (tree, source, size, subroot). root: digest of the top tree.
    """

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    trees: int
    root: str | None


def _levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All (tree, level, place, digest) over a written level 0 with n nodes a tree, and (tree, digest) of the tops."""
    every, tops, level = [], [], 0
    while True:
        every.append(nodes.select("tree", F.lit(level).alias("level"), "place", "digest"))
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        more = nodes.filter("n > 1")
        if more.isEmpty():
            break
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        up = more.groupBy("tree", "n", F.expr(f"place div {FAN}").alias("up")).agg(F.sha2(F.array_join(run, ""), 256).alias("digest"))
        nodes = written(up.select("tree", F.col("up").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "digest"), "level", keep=True)
        level += 1
    union = lambda parts: parts[0] if len(parts) == 1 else union([*(a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])), *(parts[-1:] if len(parts) % 2 else [])])
    return union(every), union(tops)


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of (id, source, leaf, claim) rows; other columns play no part.

    Leaves are moved as digests; texts never are. Rows are ranked by range partitions, and a source's
    first rank turns a rank into its place, so the list of sources is the only thing that is joined.
    """
    with scratch():
        hashed = written(rows.select("source", "id", "leaf", "claim"), "hashed")
        ranked = written(number_rows(hashed, "row"), "ranked", keep=True)
        spans = ranked.groupBy("source").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
        sources = written(number_rows(spans, "tree"), "sources", keep=True)
    trees = sources.count()
    if not trees:
        none = ranked.select("id", F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("size"), "row", "leaf", "claim")
        nodes = none.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"))
        return Manifest(none, nodes, sources.select("tree", "source", "size", F.lit(None).cast("string").alias("subroot")), 0, None)
    listed = sources.select(F.col("source").alias("of"), "first", "size", "tree")
    placed = ranked.join(F.broadcast(listed) if trees <= FEW else listed.hint("merge"), F.col("source").eqNullSafe(F.col("of")))
    leaves = written(placed.select("id", "tree", (F.col("row") - F.col("first")).alias("place"), "size", "row", "leaf", "claim"), "leaves")
    nodes, tops = _levels(leaves.select("tree", "place", F.col("size").alias("n"), F.col("leaf").alias("digest")))
    tops = written(tops, "subroots")
    above, top = _levels(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest"))
    of = tops.select("tree", F.col("digest").alias("subroot"))
    named = sources.join(of.hint("merge"), "tree").select("tree", "source", "size", "subroot")
    return Manifest(leaves, nodes.unionByName(above), named, trees, top.first()["digest"])


def missing(places: np.ndarray, n: int):
    """(level, place) of the nodes that, with the leaves at `places` of a tree of n, give its root; fewest possible."""
    level = 0
    while n > 1:
        ups = np.unique(places // FAN)
        runs = (ups[:, None] * FAN + np.arange(FAN)).ravel()
        for p in np.setdiff1d(runs[runs < n], places, assume_unique=True):
            yield level, int(p)
        places, n, level = ups, -(-n // FAN), level + 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """The runs of each level, joined, by place of their parent; and the root of the tree."""
    runs, level = [], 0
    while n > 1:
        ups = {}
        for up in dict.fromkeys(p // FAN for p in known):
            children = range(up * FAN, min(n, up * FAN + FAN))
            ups[up] = "".join(known[p] if p in known else fetched[level, p] for p in children)
        runs.append(ups)
        known, n, level = {up: sha(run) for up, run in ups.items()}, -(-n // FAN), level + 1
    return runs, known[0]


def siblings(runs: list[dict[int, str]], place: int):
    """(before, after) of a node's run, level by level."""
    for ups in runs:
        at = place % FAN * HEX
        place //= FAN
        yield ups[place][:at], ups[place][at + HEX :]


def prove(made: Manifest, asked: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for the leaves asked for, all of them by default.

    asked: rows of made.leaves. proof_sha256 is the digest of all siblings, left to right and level by level
    through the subroot to the root. folded_root is what the claim, or else the leaf, and these siblings
    give; verified tells whether that is the root. With `whole`, also proof: an array with (before, after), the
    joined siblings at either side, for each level. A block holds BLOCK leaf places, whatever was asked.
    """
    asked, trees, root = made.leaves if asked is None else asked, made.trees, made.root
    leaves = asked.withColumn("block", F.expr(f"row div {BLOCK}"))

    def requests(group: pa.Table) -> pa.Table:
        tree, place, size = (group[c].to_numpy() for c in ("tree", "place", "size"))
        out = []
        for t in np.unique(tree):
            mine = tree == t
            out += [(t, level, p) for level, p in missing(np.unique(place[mine]), int(size[mine][0]))]
        out += [(TOP, level, p) for level, p in missing(np.unique(tree), trees)]
        found = np.array(out, dtype=np.int64).reshape(-1, 3)
        block = np.full(len(found), group["block"][0].as_py())
        return pa.table({"block": block, "tree": found[:, 0], "level": found[:, 1].astype(np.int32), "place": found[:, 2]})

    wanted = leaves.select("block", "tree", "place", "size").groupBy("block").applyInArrow(requests, "block long, tree long, level int, place long")
    wanted = written(wanted, "requests")
    fetched = wanted.join(made.nodes.hint("merge"), ["tree", "level", "place"])

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, dict] = {}
        for t, level, p, d in zip(*(right[c].to_pylist() for c in ("tree", "level", "place", "digest"))):
            got.setdefault(t, {})[level, p] = d
        tree, place, size, leaf, claim = (left[c].to_pylist() for c in ("tree", "place", "size", "leaf", "claim"))
        mine: dict[int, dict[int, str]] = {}
        sizes = dict(zip(tree, size))
        for t, p, h in zip(tree, place, leaf):
            mine.setdefault(t, {})[p] = h
        climbed = {t: climb(known, sizes[t], got.get(t, {})) for t, known in mine.items()}
        tops, derived = climb({t: sub for t, (_, sub) in climbed.items()}, trees, got.get(TOP, {}))
        assert derived == root, "the node table doesn't belong to these leaves"
        rest = {t: list(siblings(tops, t)) for t in climbed}
        proofs, digests, folded = [], [], []
        for t, p, h, c in zip(tree, place, leaf, claim):
            way = [*siblings(climbed[t][0], p), *rest[t]]
            digests.append(sha("".join(a + b for a, b in way)))
            now = h if c is None else c
            for a, b in way:
                now = sha(a + now + b)
            folded.append(now)
            if whole:
                proofs.append([{"before": a, "after": b} for a, b in way])
        cols = {"id": left["id"], "leaf": left["leaf"], "subroot": [climbed[t][1] for t in tree], "root": [root] * len(tree), "proof_sha256": digests, "folded_root": folded, "verified": [f == root for f in folded]}
        return pa.table(cols | ({"proof": pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))} if whole else {}))

    kind = made.leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<struct<before:string,after:string>>" if whole else "")
    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, schema)


def op11_merkle(spark, sf_dir):
    """Where 5 divides crc32(doc_id), the claim is the leaf of the text with A-Z lowered. A null id is never tampered with."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select(F.col("doc_id").alias("id"), "source", row(F.col("text")).alias("leaf"), F.when(tampered, row(ascii_lower(F.col("text")))).alias("claim"))
    return prove(manifest(rows)).withColumnRenamed("id", "doc_id")


def _oracle(levels: int = 6) -> str:
    """Levels are written out; a tree with one node left hands it on unchanged, so any depth up to `levels` is right."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = f"""
    WITH tab AS (
      SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
    sums AS (
      SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(low)} AS lowered,
        xor(list_reduce(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc
      FROM documents, tab),
    ranked AS (
      SELECT doc_id, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM sums),
    s0 AS (SELECT tree, place, n, leaf AS d FROM ranked)"""

    def climb(name: str, first: str) -> str:
        sql = ""
        for k in range(levels):
            sql += f""",
    {name}{k + 1} AS (
      SELECT tree, place // {FAN} AS place, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY place)) END AS d
      FROM {name}{k} GROUP BY tree, place // {FAN}, n),
    {name}p{k + 1} AS (
      SELECT w.doc_id, w.leaf, w.up // {FAN} AS up, w.tree, w.siblings || coalesce(string_agg(s.d, '' ORDER BY s.place) FILTER (s.place <> w.up), '') AS siblings,
        CASE WHEN any_value(s.n) = 1 THEN w.claim ELSE sha256(string_agg(CASE WHEN s.place = w.up THEN w.claim ELSE s.d END, '' ORDER BY s.place)) END AS claim
      FROM {name}p{k} w JOIN {name}{k} s ON s.tree = w.tree AND s.place // {FAN} = w.up // {FAN} GROUP BY w.doc_id, w.leaf, w.up, w.tree, w.siblings, w.claim)"""
        return sql

    out += ", sp0 AS (SELECT doc_id, leaf, place AS up, tree, '' AS siblings, claim FROM ranked)" + climb("s", "sp0")
    out += f", t0 AS (SELECT -1 AS tree, tree AS place, count(*) OVER () AS n, d FROM s{levels}), tp0 AS (SELECT doc_id, leaf, tree AS up, -1 AS tree, siblings, claim FROM sp{levels})" + climb("t", "tp0")
    return out + f"""
    SELECT p.doc_id, p.leaf, s.d AS subroot, t.d AS root, sha256(p.siblings) AS proof_sha256, p.claim AS folded_root, p.claim = t.d AS verified
    FROM tp{levels} p JOIN ranked r ON r.doc_id IS NOT DISTINCT FROM p.doc_id AND r.leaf = p.leaf JOIN s{levels} s ON s.tree = r.tree CROSS JOIN t{levels} t"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": _oracle()}
