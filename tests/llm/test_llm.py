"""The ten operators on small tables: brute force, and nulls, empty and long texts, ties, no rows,
clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import bpe, cells, chat, components, embed_dedup, exact_dedup, mixing, pii, quality, queries, secret_scan, sharding, simhash, spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("shard", "slot", "size", "spans", "ids", "score", "kept", "fp", "draws", "cell", "h", "count")
    return df.select("*", *(F.lit("x").alias(c) for c in clash)) if extra else df


def sample_texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "été", "漢字", "x", "THE"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [None, "", " \t", "a", *texts, texts[0], texts[0].upper(), texts[1] + " end", "word " * 30_000, "z" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, sample_texts()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500, 501 + k) for k in range(60)] + [(k, k + 1) for k in range(600, 640)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: find(x) for x in got}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars():
    a, b = np.array([1, 4, 5]), np.array([2, 3, 4])
    assert cells.stars(a, b, 7).tolist() == [0, 1, 1, 3, 3, 3, 6]


def test_sharding(spark, docs, empty):
    rows = sharding.shard_rows(docs.select("doc_id", F.lit("old").alias("shard")).union(docs.select(F.lit(None), F.lit("x"))), shards=5).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows))) == sorted(r.global_row for r in rows)
    assert all(r.shard == r.position % 5 and r.slot == r.position // 5 for r in rows)
    again = sharding.shard_rows(docs.select("doc_id").repartition(3), shards=5).collect()
    assert sorted(again) == sorted(sharding.shard_rows(docs.select("doc_id").coalesce(1), shards=5).collect())
    assert sharding.shard_rows(empty).count() == 0
    for n in (1, 2, 3, 10, 97):
        assert sorted(r[0] for r in spark.range(n).select(F.expr(sharding.permuted("id", n, 9))).collect()) == list(range(n))


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"file://{tmp_path}/s", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def naive_exact(rows):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, weak):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rule = {"low": 8, "high": 32, "hashed": lambda c: F.length(c).cast("long")} if weak else {}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, **rule).collect()}
    assert got == naive_exact(rows)


def test_exact_dedup_ties(spark, empty):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (5, "b"), (5, "B"), (4, "b")], "doc_id long, text string").coalesce(1)
    rows = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {2, 3}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_chunks(spark):
    texts = ["", "a. " * 900, "q" * 20_000, "é\n" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks_of(F.col("t")).alias("c"))
    assert all("".join(r.c) == r.t for r in df.collect())


def test_exact_numbers_survive_another_split(spark, tmp_path, monkeypatch):
    """Files are packed otherwise between the two reads of a run, as when an executor goes."""
    texts = [f"text {k % 150}" for k in range(300)]
    docs_of(spark, texts).repartition(6).write.parquet(str(tmp_path / "docs"))
    stored, write, key = spark.read.parquet(str(tmp_path / "docs")), exact_dedup.written, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def written(df, name, **more):
        out = write(df, name, **more)
        if name == "kept":
            spark.conf.set(key, "1")
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    monkeypatch.setattr(exact_dedup, "written", written)
    try:
        assert sorted(r.doc_id for r in exact_dedup.without_copies(stored).collect()) == list(range(150, 300))
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_fingerprint(text, words=3):
    """From the contract's words: pure Python, a bit and a shingle at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [int.from_bytes(xxhash.xxh64(s.encode("utf-8"), seed=42).digest(), "big") for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_bits(fps, bits=2):
    """key -> least key reachable, by every pair."""
    label, before = {i: i for i in fps}, None
    while label != before:
        before, label = label, {a: min(label[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= bits) for a in fps}
    return label


def test_fingerprints_in_parts(monkeypatch):
    """Cut anywhere, a text has the same shingles."""
    texts = [t or "" for t in sample_texts()[:44]] + ["a b", "a", "x \x0b\x0cy\rz  ", "\x1c\x85\xa0A", "été É q"]
    for words in (1, 3, 5):
        want = [plain_fingerprint(t, words) for t in texts]
        for step in (1, 7, 1 << 20):
            monkeypatch.setattr(simhash, "STEP", step)
            assert [simhash.fingerprint(t, words) & (2**64 - 1) for t in texts] == want


def test_simhash(spark, docs, empty):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    label = linked_by_bits(fps)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_dedup(docs_of(spark, sample_texts(), extra=True)).collect()}
    assert got == {i: (f, label[i]) for i, f in fps.items()}
    assert simhash.near_dedup(empty).count() == 0
    assert {r.doc_id for r in simhash.without_near_copies(docs).collect()} == {i for i in fps if label[i] == i}


def test_simhash_query(spark):
    """The three columns of the query on the smallest table."""
    fps = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    label = linked_by_bits(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{f:016x}", label[i]) for i, f in fps.items()}


def survivors(rows, alike):
    """Of rows (id, text) the number of those that stay: the least id of each linked group, nulls last, one of equals."""
    label, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and alike(rows[a][1], rows[b][1]):
                    low, high = sorted((label[a], label[b]))
                    label, changed = [low if x == high else x for x in label], True
    groups = {}
    for (i, t), x in zip(rows, label):
        groups.setdefault(x, []).append((i is None, i or 0, t or ""))
    return [{(None if n else i, t) for n, i, t in g if (n, i) == min(x[:2] for x in g)} for g in groups.values()]


def test_near_copies_by_row(spark):
    """Repeated rows, ids that several rows share, and null ids: of each group one row stays, by content."""
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue cyan"
    rows = [(1, a), (1, a), (1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, None), (7, ""), (6, " "), (8, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = survivors(rows, lambda x, y: (plain_fingerprint(x) ^ plain_fingerprint(y)).bit_count() <= 2)
    got = [(r.doc_id, r.text or "") for r in simhash.without_near_copies(df).collect()]
    assert len(got) == len(want) == 4 and all(any(g in w for g in got) for w in want)
    assert len({r.component_id for r in simhash.near_dedup(df).collect()}) == 4


def test_tree_misses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    dense = np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, base[:300] ^ np.uint64(5), dense]))
    at, cell, home = simhash.route(simhash.build_tree(fps, 60), fps)
    assert home.sum() == len(fps) and cell.max() > 10
    seen = set()
    for c in np.unique(cell):
        own, all_ = at[(cell == c) & home], at[cell == c]
        i, j = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[all_][None, :]) <= 2)
        seen |= {(min(a, b), max(a, b)) for a, b in zip(own[i], all_[j]) if a != b}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert seen == {(a, b) for a, b in zip(i, j) if a < b}


def brute_links(rows, threshold=0.9):
    """Number of links and least id reachable of each (id, vector), lengths apart, in double precision."""
    n_links, label = [0] * len(rows), list(range(len(rows)))
    good = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    links = []
    for d in {len(v) for _, v in rows if v}:
        own = [k for k, (_, v) in enumerate(rows) if good(v) and len(v) == d]
        if own:
            u = np.array([rows[k][1] for k in own], dtype=np.float64)
            u /= np.abs(u).max(1, keepdims=True)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            links += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)))]
    root = cells.stars(np.array([a for a, _ in links], dtype=int), np.array([b for _, b in links], dtype=int), len(rows)) if links else np.arange(len(rows))
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    for a, b in links:
        n_links[a] += 1
        n_links[b] += 1
    return n_links, [least[r] for r in root]


def test_embeddings(spark, monkeypatch):
    """Small blocks, so that lines, windows and pairs of blocks all come up."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 128)
    monkeypatch.setattr(embed_dedup, "LINE", 64)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 32))
    near = x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True)
    other = rng.standard_normal((200, 32))
    other -= (other * near).sum(1, keepdims=True) * near
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    rows = np.concatenate([x, 3 * (0.93 * near + (1 - 0.93**2) ** 0.5 * other), np.repeat(x[599:], 200, axis=0)])
    data = [(i, v.tolist()) for i, v in enumerate(rows)] + [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (9005, [1.0]), (9006, [])]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    true = np.array(brute_links(data)[0])[: len(rows)]
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum() and found[800:].sum() == true[800:].sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9007)) and got[640 + 160].component_id == 599
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_several_lengths(spark):
    """Lengths link among themselves; ids may repeat; columns of clashing names play no part. These few dimensions leave no link out."""
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((3, 300), (2, 80), (1, 6), (16, 120)):
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, d)))]
    rows += [(2000, [1.0, 0.0, 0.0]), (2000, [1.0, 0.01, 0.0]), (2001, [1e300, 0.0, 0.0]), (2002, [0.0, 0.0, 0.0]), (2003, [float("inf"), 1.0, 1.0]), (2004, [1.0, None, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("uid", "lines", "at", "n_links", "component_id", "kept", "dims", "p")))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect())
    n_links, least = brute_links(rows)
    assert got == sorted((i, n, c, i == c) for (i, _), n, c in zip(rows, n_links, least)) and sum(n_links) > 1000


def test_embedding_recall_near_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.91 among other vectors, and a third of all in one group around 0.9."""
    rng = np.random.default_rng(1)
    x, y = embed_dedup.planted_pairs(48, 0.905, 1200, seed=77)
    centre = rng.standard_normal(48)
    centre /= np.linalg.norm(centre)
    off = rng.standard_normal((1500, 48))
    off -= (off @ centre)[:, None] * centre
    hot = 0.9**0.5 * centre + 0.1**0.5 * off / np.linalg.norm(off, axis=1, keepdims=True)
    rows = np.concatenate([x, y, rng.standard_normal((600, 48)), hot])
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    true = np.array(brute_links([(i, v.tolist()) for i, v in enumerate(rows)])[0])
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= true).all() and found[:2400].sum() >= 0.97 * true[:2400].sum() and found[3000:].sum() >= 0.97 * true[3000:].sum()


def test_counting_rule():
    for dims, n in ((64, 50_000), (64, 2_000_000), (8, 50_000), (2, 50_000)):
        lines, entered, width, least = embed_dedup.counting_rule(dims, n)
        x, y = embed_dedup.planted_pairs(dims, 0.9, 2000, seed=5)
        (a, at_a), (b, at_b) = embed_dedup.highest(x, lines, entered), embed_dedup.highest(y, lines, entered)
        met = (a[:, :, None] == b[:, None, :]) & (np.abs(at_a[:, :, None] - at_b[:, None, :]) <= width)
        assert (met.sum((1, 2)) >= least).mean() >= 0.97 and all(len(set(r)) == entered for r in a.tolist())
    assert embed_dedup.counting_rule(64, 2000)[0] == embed_dedup.FEWEST and embed_dedup.counting_rule(1, 2000)[:2] == (1, 1)


def test_collisions():
    rng = np.random.default_rng(3)
    lines = [np.stack([rng.permutation(9)[:4] for _ in range(n)]) for n in (20, 30)]
    at = [rng.standard_normal(x.shape) for x in lines]
    met = (lines[0][:, None, :, None] == lines[1][None, :, None, :]) & (np.abs(at[0][:, None, :, None] - at[1][None, :, None, :]) <= 0.7)
    line = np.where(met, lines[0][:, None, :, None], 99).min((2, 3))
    for own in range(9):
        count, first = embed_dedup.collisions((lines[0], at[0]), (lines[1], at[1]), own, 0.7)
        assert (count == met.sum((2, 3))).all() and (first == (line == own)).all()


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), (None, 50), ("c", 10), ("é", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    left, open_, want = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * open_[s]]
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2 * open_.pop(s)
            left -= want[s]
    assert got == pytest.approx(want)


def test_mixing(spark, docs, empty):
    sized = docs.drop("size").withColumn("size", mixing.words(F.col("text")))
    rows = mixing.mix_plan(sized, shards=4, block_words=200).collect()
    taken, target = {}, {}
    for r in rows:
        assert sum(d["words"] for d in r.draws) <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + sum(d["words"] for d in r.draws)
        target[r.source] = r.target
    assert len(rows) == docs.count() and all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(sized.repartition(5), shards=4, block_words=200).collect()))
    assert mixing.mix_plan(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0
    drawn = mixing.mix(docs_of(spark, sample_texts(), extra=True))
    assert drawn.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())


def test_mixing_of_empty_texts(spark):
    """A source of empty texts is split in blocks like others and takes nothing."""
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "void").otherwise("full").alias("source"), F.when(F.col("id") < 300, 0).otherwise(5).cast("long").alias("size"))
    rows = mixing.mix_plan(df, shards=4, block_words=20).collect()
    assert sum(d["words"] for r in rows for d in r.draws) == 1500 and not any(r.draws for r in rows if r.source == "void")


def test_quota_tree(spark):
    quotas = spark.createDataFrame([(f"s{k}", k, 37 * k + 5) for k in range(6)], "source string, _id long, quota long")
    got = mixing.split_quotas(quotas, shards=7).groupBy("source").agg(F.sum("quota").alias("n"), F.countDistinct("shard")).collect()
    assert {r.source: r.n for r in got} == {f"s{k}": 37 * k + 5 for k in range(6)}
    sums = [r[0] for r in mixing.split_quotas(quotas, shards=8).groupBy("shard").agg(F.sum("quota").alias("n")).select("n").collect()]
    assert max(sums) - min(sums) <= 8


def test_hypergeometric(spark):
    us = spark.range(2000).select(F.expr(mixing.hypergeometric("100L", "30L", "40L", "((id + 0.5D) / 2000)")).alias("k"))
    m, s = us.agg(F.avg("k"), F.stddev("k")).first()
    assert abs(m - 12) < 0.05 and abs(s - (40 * 0.3 * 0.7 * 60 / 99) ** 0.5) < 0.05


def test_chat(spark):
    turns = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "a\n### User: b </turn>\n"), (2, 0, "assistant", None), (2, 1, None, ""), (3, 0, "sys:tem#", "x" * 70_000), (None, 0, "user", "q"), (4, 1, "user", "b"), (4, 1, "user", "a")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.parse_chats(F.col("formatted"))).collect()}
    loss = {r.conv_id: r.t for r in chat.format_chats(df).select("conv_id", chat.loss_text(F.col("segments")).alias("t")).collect()}
    assert loss == {1: "a\n### User: b </turn>\n", 2: "", 3: "", None: "", 4: ""}
    for c in (1, 2, 3, None, 4):
        want = sorted((t, r or "", x or "") for i, t, r, x in turns if i == c)
        assert [(b.role, b.text) for b in rows[c].back] == [(r, x) for _, r, x in want]
        assert "".join(s.text for s in rows[c].segments) == rows[c].formatted
    assert rows[1].valid and not rows[2].valid and rows[1].formatted.count(" </turn>\n") == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def pii_brute(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end(), True))
    return out


def test_pii_base():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choices("ab@@..-_ +1234567890() é", k=rng.randint(0, 50)))
        assert [s for s in pii.find_one(t) if s[3]] == pii_brute(t), t


def test_pii_added():
    cases = {"mail joe (at) site [dot] com": ("email", "joe (at) site [dot] com"), "joe at site dot org": ("email", "joe at site dot org"), "j０e@ехample.com": ("email", "j０e@ехample.com"), "card four five three nine one four eight eight zero three four three six four six seven": ("card", None), "𝐣𝐨𝐞@𝘴𝘪𝘵𝘦.𝚘𝚛𝚐 ๔": ("email", "𝐣𝐨𝐞@𝘴𝘪𝘵𝘦.𝚘𝚛𝚐"), "call plus four nine one five one two three four five six": ("phone", "plus four nine one five one two three four five six")}
    for t, (kind, want) in cases.items():
        got = [(k, t[a:b]) for k, a, b, base in pii.find_one(t) if not base]
        assert got and got[0][0] == kind and (want is None or got[0][1] == want)
    for t in ("look at this dot", "one two three go", "(at) the [dot] end", "plain text. At home"):
        assert not pii.find_one(t)


def test_pii_added_over_base_fragments():
    """A disguised identifier of which a part matches the base pattern: both spans are there."""
    for kind, t, part in (("email", "jоhn@example.com", "hn@example.com"), ("email", "john@example.cоm", "john@example.c"), ("phone", "+49 151 2345678９", "+49 151 2345678")):
        got = pii.find_one(f"to {t} now")
        spans = [(k, f"to {t} now"[a:b], base) for k, a, b, base in got]
        assert (kind, part, True) in spans and (kind, t, False) in spans, spans
    assert pii.find_one("a@b.com ｘ") == [("email", 0, 7, True)]


def test_pii_any_spelled_or_spoken_form():
    cases = {"ip": ["192 dot 168 dot 0 dot 1", "one nine two dot one six eight dot zero dot one", "192.one six eight.0.1", "one zero (dot) 0 (dot) 0 (dot) seven"], "card": ["four five three nine 1488 0343 6467", "4539, one four eight eight 0343 6467", "4539 1488 zero three four three 6467"], "phone": ["plus 49 151 two three four five 678", "plus four nine 151 2345678"]}
    cases["email"] = [f"joe at site dot {e}" for e in ("co dot uk", "it", "nl", "ch", "eu")] + ["joe@site dot nl", "joe (at) site dot nl", "joe at site (dot) nl", "john dot doe at mail.site dot eu", "one at site dot com"]
    for kind, texts in cases.items():
        for t in texts:
            for before, after in (("", ""), ("see ", ".")):
                whole = before + t + after
                assert (kind, len(before), len(before) + len(t), False) in pii.find_one(whole), (whole, pii.find_one(whole))
    assert ("card", 4, 23, False) in pii.find_one("one ４５３９ 1488 0343 6467")
    for t in ("one of two at the dot", "three dot four", "300 dot one dot two dot three", "look at site.com"):
        assert not [x for x in pii.find_one(t) if not x[3]], t


def secrets_brute(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(secret_scan.BASE[0].pattern, t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["token", "SECRET", "pass", "wd", "api", "_", "key", '="', ": ", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "x", "sk9+/=aa", "longsecretvalue1", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    got = secret_scan.finder(secret_scan.RULES)(texts)
    assert [[s[:3] for s in g if s[3]] for g in got] == [secrets_brute(t) for t in texts] and any(got)
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == [] and secret_scan.trigram_query("AKIA[A-Z0-9]+") == [(frozenset({b"aki", b"kia"}),)]


def timed(f, seconds):
    import time

    begun = time.time()
    out = f()
    assert time.time() - begun < seconds
    return out


@pytest.mark.parametrize("text", ["-" * 10**7 + " dot x", "%" * 10**7 + " at x dot y", "+1" * 5 * 10**6, "+1" + " " * 10**7, "1" * 10**7, "a@" * 10**6, "1." * 10**6, "O" * 10**7 + "1", "l0." * 10**6, "one " * 10**6, "a at " * 10**6])
def test_pii_is_linear(text):
    timed(lambda: pii.find_one(text), 40)


@pytest.mark.parametrize("text", ["eyJ" * 3 * 10**6, "eyJaaaaaaaaa." * 10**6, "token" + " " * 10**7, "-----BEGIN " * 10**6, "AKIA" * 10**6, ("0" * 31 + "g") * 10**5])
def test_secrets_are_linear(text):
    timed(lambda: secret_scan.finder(secret_scan.RULES)([text]), 40)


def test_jwt_as_from_anywhere():
    """The rule tries one start in a run; a plain pattern that tries all finds the same."""
    rng, plain, n = random.Random(1), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0
    texts = ["".join(rng.choices(["eyJ", ".", ".", "abcdefgh", "a-b_", "eyJaaaaaaaaaaa", " "], k=rng.randint(1, 14))) for _ in range(20_000)]
    for t, got in zip(texts, secret_scan.finder(secret_scan.RULES)(texts)):
        want = [(m.start(), m.end()) for m in plain.finditer(t)]
        assert [s[1:3] for s in got if s[0] == "jwt"] == want, t
        n += len(want)
    assert n > 300


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abc|abd") == [(frozenset({b"abc"}), frozenset({b"abd"}))] and q("a?bcd") == [(frozenset({b"bcd"}),)]
    assert q("x[^a]yzw+") == [(frozenset({b"yzw"}),)] and q(r"(?<!q)ab\.c(?=d)") == [(frozenset({b"ab.", b"b.c"}),)]
    assert q("(?:abc)*d") == [] and q("(abcd){2,}") == [(frozenset({b"abc", b"bcd"}),)] and q("[Aa]\\x42c") == [(frozenset({b"abc"}),)]
    with pytest.raises(ValueError):
        q("(?P<x>abc)")


def digest_rows(texts, kinds, brute, more):
    """The columns that the contract asks for, from brute-force base spans and the operator's own others."""
    for t in texts:
        base = sorted(brute(t or ""), key=lambda s: (s[1], kinds.index(s[0])))
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in base)
        everything = sorted([*((k, a, b) for k, a, b, *_ in base), *more(t or "")], key=lambda s: (s[1], ALL_KINDS.index(s[0])))
        yield (*(sum(s[0] == k for s in base) for k in kinds), hashlib.sha256(plain.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in everything))


ALL_KINDS = (*pii.KINDS, *(r.kind for r in secret_scan.RULES))


def test_span_queries(spark):
    """All columns of op7 and op8 on the smallest table and on planted texts, against brute force."""
    planted = ["joe@a.com +49 151 23456789 10.0.0.256 10.0.0.1 4539 1488 0343 6467", "joe at site dot it token=abcdefgh12 AKIAABCDEFGHIJKL", "é" * 5 + " api_key: 'zzzzzzzz' " + "0af" * 20, "eyJaaaaaaaaa.bbbbbbbbb.ccccccccc", None, ""]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(planted)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for find, kinds, brute, added in (
        (pii.find_pii, pii.KINDS, pii_brute, lambda t: [s[:3] for s in pii.find_one(t) if not s[3]]),
        (secret_scan.find_secrets, tuple(r.kind for r in secret_scan.BASE), secrets_brute, lambda t: [s[:3] for s in secret_scan.finder(secret_scan.MORE)([t])[0]]),
    ):
        every = kinds if find is pii.find_pii else tuple(r.kind for r in secret_scan.RULES)
        got = {r[0]: tuple(r)[1:] for r in spans.digests(find(docs).drop("text"), kinds, every).collect()}
        assert got == dict(zip(texts, digest_rows(texts.values(), kinds, brute, added)))
    assert spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() == pii.op7_pii(spark, "/root/testdata/sf0.001").count() == secret_scan.op8_secrets(spark, "/root/testdata/sf0.001").count()


def test_pii_look_alikes():
    cases = {"email": ["ĵoe@ехample.com", "josé@example.com", "joe＠example．com", "ｊｏｅ at ｓｉｔｅ dot ｉｔ", "ᴊᴏe@example.com", "jοe@exampʟe.com"], "card": ["4O12 8888 8888 l881", "④⓪①② 8888 8888 ①881"], "ip": ["l92.l68.O.1", "¹⁹².168.0.1"], "phone": ["+49 I51 23456789"]}
    for kind, texts in cases.items():
        for t in texts:
            assert (kind, 4, 4 + len(t), False) in pii.find_one(f"see {t} ."), (t, pii.find_one(f"see {t} ."))
    for t in ("m² and 10²", "J. O. 10-l", "①②③ Él está en casa", "I 5 O 7"):
        assert not pii.find_one(t), t


def test_spans_on_spark(spark, docs, empty):
    """Clashing columns keep their values, but for the spans."""
    for f in (pii.find_pii, secret_scan.find_secrets):
        odd = docs_of(spark, sample_texts(), extra=True)
        out = f(odd)
        assert sorted(out.columns) == sorted(odd.columns) and f(empty).count() == 0
        rest = [c for c in odd.columns if c != "spans"]
        assert sorted(map(repr, out.select(*rest).collect())) == sorted(map(repr, odd.select(*rest).collect()))


def test_bpe():
    from tokenizers import Tokenizer

    codec, lib = bpe.Codec(open(bpe.tokenizer_path()).read()), Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(4)
    chars = [chr(i) for i in range(256)] + list(" \n\t\x0b\x85\xa0 　​\x1cÉß漢😀́١½Ⅷ") * 4
    tokens = list(codec.ids)
    for i in range(1500):
        t = "".join(rng.choices(chars, k=rng.randint(0, 30))) if i % 2 else b"".join(rng.choices(tokens, k=6)).decode("utf-8", "ignore")
        t += "<|endoftext|>x" if i % 9 == 0 else ""
        want = lib.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(codec.encode(t), dtype="<i4")
        assert ids.tolist() == want, t
        assert codec.decode(ids, np.array([len(ids)]))[0] == lib.decode(want, skip_special_tokens=False)
    assert np.frombuffer(codec.encode("ab" * 20_000), dtype="<i4").tolist() == lib.encode("ab" * 20_000, add_special_tokens=False).ids


def test_bpe_query(spark):
    """The digests of the query against the tokenizers library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def test_decoding_in_steps(monkeypatch):
    codec = bpe.Codec(open(bpe.tokenizer_path()).read())
    texts = [t or "" for t in sample_texts()]
    coded = [np.frombuffer(codec.encode(t), dtype="<i4") for t in texts]
    for step in (1, 7, 1 << 18):
        monkeypatch.setattr(bpe, "IDS", step)
        few = slice(None, 44) if step < 9 else slice(None)
        assert codec.decode(np.concatenate(coded[few]), np.cumsum([len(c) for c in coded[few]])) == texts[few]


def test_bpe_on_spark(spark, docs, empty):
    rows = bpe.decode(bpe.encode(docs_of(spark, sample_texts(), extra=True))).collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == docs.count()
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_quality(spark, empty):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "ran", "the", "mi") for b in ("ne", "st", "ing", "ar")]
    good = lambda: " ".join(rng.choices(words, k=60)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=60)) if rng.random() < 0.5 else (rng.choice(words) + " ") * 80
    truth = [int(rng.random() < 0.7) for _ in range(400)]
    texts = [good() if y else bad() for y in truth]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(truth)] + [(7, 1 - truth[7], 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, sample=200)
    assert len(model.labels) <= 200
    rows = quality.score(df, model).withColumn("out", quality.held_out()).collect()
    assert {r.doc_id for r in rows if r.out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in rows if r.out) >= 0.97 * sum(r.out for r in rows)
    odd = quality.score(docs_of(spark, [None, "", "x"], extra=True), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and quality.score(empty, model).count() == 0
    none = quality.fit(empty, labels.limit(0))
    assert all(r.score == 0.5 for r in quality.score(df.limit(3), none).collect())


def test_quality_votes_by_brute_force(spark):
    """Each cosine and vote by itself; equal texts do not vote, ties go by id."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["lorem", "ipsum", "Dolor,", "sit!", "42", "é"], k=rng.randint(1, 12))) for _ in range(90)] + ["", "lorem"]
    texts += texts[:10]
    labels = [k % 3 > 0 for k in range(len(texts))]
    keys = np.array([quality.text_key(t) for t in texts], dtype=np.uint64)
    model = quality.Model(quality.terms(texts), np.array(labels, dtype=np.float32), keys)
    asked = [*texts[:30], "new text", "", "DOLOR, dolor,"]
    got = model.score(quality.terms(asked), np.array([quality.text_key(t) for t in asked], dtype=np.uint64))
    own = model.latent(quality.terms(asked)).astype(float)
    for t, v, s in zip(asked, own, got):
        votes = sorted((-round(1e5 * float(sum(a * b for a, b in zip(v, w)))), k) for k, w in enumerate(model.vectors.astype(float)) if texts[k] != t)[: quality.NEIGHBOURS]
        weight = [(max(-c, 0) / 1e5) ** quality.POWER for c, _ in votes]
        want = (sum(w for w, (_, k) in zip(weight, votes) if labels[k]) + 1e-9 * model.prior) / (sum(weight) + 1e-9)
        assert s == pytest.approx(want, abs=2e-3), t
    assert not np.allclose(got, model.prior)


def test_word_places():
    """Words by themselves and within a text have the same place; case A-Z and blanks do not matter."""
    place = lambda t: quality.word_places(np.frombuffer(t.encode(), dtype=np.uint8)).tolist()
    for words in (["a"], ["alpha", "Beta", "漢字", "x" * 300, "été"], []):
        assert place("  ".join(words)) == [place(w)[0] for w in words] == place("\t" + "\n".join(words).replace("B", "b") + " \r")
    assert place("alpha") != place("beta") and place("ab") != place("ba")


def test_quality_ids_of_any_type(spark):
    """String ids; ids that several rows share with other texts and labels give the same model in any order."""
    rows = [(f"d{k % 40}", f"text number {k} " + "Word. " * (k % 7), k % 2) for k in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), ("d1", None)], "doc_id string, quality int")
    one, two = (quality.fit(d, y) for d, y in ((docs, labels), (docs.repartition(5), labels.repartition(3))))
    assert (one.keys == two.keys).all() and (one.labels == two.labels).all() and len(one.labels) <= 40
    asked = docs.orderBy("text").limit(20)
    a, b = ([r.score for r in quality.score(asked, m).orderBy("text").collect()] for m in (one, two))
    assert a == pytest.approx(b)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, None), None)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = {i for i, v in naive_exact(rows).items() if v[2]}
    got = {r.doc_id for r in kept.collect()}
    assert got <= once and len(corpus_pipeline.STAGES) == 5
    mixed = corpus_pipeline.mix_sources(spark, docs.limit(50), None)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.encode(spark, docs.limit(50), None)
    assert out.filter("not round_trip").count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar_brute(rows):
    """Ids that stay, by every pair's Jaccard similarity of five-word tuples."""
    sets = [(i, five_words(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    near = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x == y or len(x & y) * 5 >= 4 * len(x | y)]
    before = None
    while label != before:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i in label if label[i] == i}, near


def test_near_stage_by_brute_force(spark, docs, empty):
    """The stage against every pair, with copies of which up to a fifth differs, chains and a hot passage."""
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, texts = [word() for _ in range(30)], []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(20, 150))]
        texts.append(" ".join(w + passage * (rng.random() < 0.5)))
        for _ in range(4):
            w = [word() if rng.random() < 0.015 else x for x in w]
            texts.append(" ".join(w + passage * (rng.random() < 0.3)).swapcase())
    rng.shuffle(texts)
    many = docs_of(spark, texts)
    for df in (many, docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want, near = similar_brute([(r.doc_id, r.text) for r in df.collect()])
        assert near and {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, None).collect()} == want
    assert corpus_pipeline.drop_near_copies(spark, empty, None).count() == 0


def test_pipeline_by_brute_force(spark):
    """The run's rows against naive dedup, all pairs at similarity 0.8, the mix in SQL and the tokenizers library."""
    import corpus_pipeline
    import duckdb
    from tokenizers import Tokenizer

    sf, lib = "/root/testdata/sf0.001", Tokenizer.from_file(bpe.tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).filter(F.col("score") >= 0.7).toPandas()
    exact = naive_exact(list(zip(good.doc_id, good.text)))
    kept = good[[exact[i][2] for i in good.doc_id]]
    stay, near = similar_brute(list(zip(kept.doc_id, kept.text)))
    kept = kept[[i in stay for i in kept.doc_id]]
    duck = duckdb.connect()
    duck.register("documents", kept)
    want = {r[0]: r[1] for r in duck.sql(f"select doc_id, taken from ({mixing.ORACLES['op5_mixing']}) where taken > 0").fetchall()}
    got: dict = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        text = lib.decode(r.ids, skip_special_tokens=False)
        assert r.round_trip and r.n_tokens == len(r.ids) and lib.encode(text, add_special_tokens=False).ids == r.ids
        got[r.doc_id] = got.get(r.doc_id, 0) + len(text.encode().split())
    assert near and got == want


def odd_table(spark):
    """Clashing column names, null ids and texts, repeated rows, ids that rows of other texts share."""
    odd = docs_of(spark, sample_texts(), extra=True)
    shared = odd.filter("doc_id in (8, 9)").withColumn("doc_id", F.lit(10).cast("long"))
    return odd.union(odd.filter("doc_id < 12")).union(shared).union(odd.filter("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "near_dedup", "mix", "bpe"])
def test_pipeline_stage_on_odd_tables(spark, empty, name):
    """By content, against brute force over the same rows."""
    import corpus_pipeline

    stage, sf = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    odd = odd_table(spark)
    out = stage(spark, odd, sf)
    assert stage(spark, empty, sf).count() == 0 and (out.columns == odd.columns or name == "bpe")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.text) for r in out.collect()) if name != "bpe" else None
    if name == "quality":
        scores = quality.score(odd, quality.fit(odd, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
        assert got == Counter((r.doc_id, r.text) for r in scores if r.score >= quality.KEEP)
    elif name == "exact_dedup":
        low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
        best = {}
        for i, t in rows:
            best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
        assert Counter((i, low(t)) for (i, t), n in got.items() for _ in range(n)) == Counter((None if i < 0 else i, t) for t, i in best.items())
    elif name == "near_dedup":
        sets = {t: five_words(t) for _, t in rows}
        want = survivors(rows, lambda x, y: sets[x] == sets[y] or len(sets[x] & sets[y]) * 5 >= 4 * len(sets[x] | sets[y]))
        stay = [(i, t or "") for (i, t), n in got.items() for _ in range(n)]
        assert len(stay) == len(want) and all(any(s in w for s in stay) for w in want)
    elif name == "mix":
        plan = mixing.mix_plan(odd.drop("size").withColumn("size", mixing.words(F.col("text")))).collect()
        taken = {s: sum(d["words"] for r in plan if r.source == s for d in r.draws) for s in {r.source for r in plan}}
        assert all(abs(taken[r.source] - r.target) <= 0.5 for r in plan)
        count = lambda t: len((t or "").encode().split())
        whole = Counter((i, t) for i, t in rows)
        assert sum(n * count(t) for (_, t), n in got.items()) == sum(taken.values())
        cut = sum(n for (i, t), n in got.items() if (i, t) not in whole)
        assert cut <= len(taken) and all(n <= 2 * whole[k] for k, n in got.items() if k in whole)
    else:
        codec = bpe.Codec(open(bpe.tokenizer_path()).read())
        coded = Counter((r.doc_id, tuple(r.ids)) for r in out.collect())
        assert coded == Counter((i, tuple(np.frombuffer(codec.encode(t or ""), dtype="<i4").tolist())) for i, t in rows)


def test_sharding_of_repeated_and_null_rows(spark, monkeypatch):
    """Runs of copies are dealt out in several pieces."""
    monkeypatch.setattr(sharding, "COPY_RUN", 7)
    df = spark.createDataFrame([(None, None)] * 50 + [(1, "a")] * 40 + [(1, None)] * 3 + [(2, "b")], "doc_id long, text string")
    rows = sharding.shard_rows(df, shards=6).collect()
    assert sorted(r.position for r in rows) == list(range(94)) and Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(6))


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
