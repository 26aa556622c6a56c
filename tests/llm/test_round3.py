"""Manifest, whitening and language-model scoring on small tables: brute force, and nulls, empty and long
texts, ties, repeated rows, no rows, clashing names."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, embed_dedup, exact_dedup, lm, merkle, mixing, sharding, simhash, similar, whitening

LEAVES = "id long, source string, leaf string, claim string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_manifest(rows):
    """{row number: (leaf, subroot, root, siblings, folded)} of (id, source, leaf, claim) rows."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            first = at // 16 * 16
            yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])
            at //= 16

    key = lambda s: (s is not None, (s or "").encode())
    by_source = {}
    for k, r in enumerate(rows):
        by_source.setdefault(r[1], []).append(k)
    names = sorted(by_source, key=key)
    for s in names:
        by_source[s].sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
    trees = {s: tree([rows[k][2] for k in by_source[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = {}
    for i, s in enumerate(names):
        for at, k in enumerate(by_source[s]):
            path = [*way(trees[s], at), *way(top, i)]
            now = rows[k][3] or rows[k][2]
            for a, b in path:
                now = sha(a + now + b)
            out[k] = (rows[k][2], trees[s][-1][0], top[-1][0], path, now)
    return out


def leaf_rows():
    sizes = {None: 3, "": 1, "a": 1, "big": 700, "é": 16, "b": 17, "z": 256, "y": 257, **{f"s{k:03}": 1 for k in range(40)}}
    rows = [(k * 7 % 1009 + 2000 * i, s, sha(f"{s}/{k}"), None if k % 3 else sha(f"other {k}")) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    return rows + [(None, "b", sha("null id"), None), (5, "b", sha("twice"), None), (5, "b", sha("twice"), None), (5, "b", sha("same id"), None)]


@pytest.mark.parametrize("block", [4096, 37])
def test_manifest(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = leaf_rows()
    made = merkle.manifest(spark.createDataFrame(rows, LEAVES).withColumns({c: F.lit("x") for c in ("row", "tree", "place", "first", "size", "block", "of", "_n", "_copy")}).repartition(5))
    got = merkle.prove(made, whole=True).collect()
    want = naive_manifest(rows)
    digest = lambda way: sha("".join(a + b for a, b in way))
    flat = lambda r: tuple(map(str, r))
    assert sorted(flat((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in got) == sorted(flat((rows[k][0], leaf, sub, root, digest(way), now, now == root)) for k, (leaf, sub, root, way, now) in want.items())
    assert all([(p.before, p.after) for p in r.proof] == next(w[3] for w in want.values() if w[0] == r.leaf) for r in got[::50])
    some = merkle.prove(made, made.leaves.filter("place % 100 = 7")).collect()
    assert some and {(r.leaf, r.proof_sha256) for r in some} <= {(r.leaf, r.proof_sha256) for r in got}


def test_manifest_of_few_rows(spark):
    empty = merkle.manifest(spark.createDataFrame([], LEAVES))
    assert empty.root is None and merkle.prove(empty).count() == 0
    one = merkle.prove(merkle.manifest(spark.createDataFrame([(1, None, "ab", None)], LEAVES))).first()
    assert (one.subroot, one.root, one.folded_root, one.verified) == ("ab", "ab", "ab", True) and one.proof_sha256 == sha("")


def test_missing_is_least():
    assert list(merkle.missing(np.arange(16), 16)) == []
    assert list(merkle.missing(np.array([3]), 5)) == [(0, 0), (0, 1), (0, 2), (0, 4)]
    assert list(merkle.missing(np.arange(16, 20), 20)) == [(1, 0)]


def test_merkle_query_on_odd_rows(spark, tmp_path):
    texts = [None, "", "ABC", "abc", "É upper", "X" * 300_000, "a\n b"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i, "x") for i, t in enumerate(texts * 9)] + [(None, "T", "en", "s1", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(str(tmp_path / "documents.parquet"))
    enc = lambda *v: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)
    low = lambda t: None if t is None else t.translate({c: c + 32 for c in range(65, 91)})
    hit = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    leaves = [(i, s, sha(enc(i, s, lang, n, t)), sha(enc(i, s, lang, n, low(t))) if hit(i) else None) for i, t, lang, s, n, _ in rows]
    want = naive_manifest(leaves)
    got = {r.leaf: r for r in merkle.op11_merkle(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for leaf, sub, root, way, now in want.values():
        r = got[leaf]
        assert (r.subroot, r.root, r.folded_root, r.verified) == (sub, root, now, now == root) and r.proof_sha256 == sha("".join(a + b for a, b in way))
    assert not all(r.verified for r in got.values())


def naive_whitening(vectors, wanted=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    scaled = n * x - s
    centred = (scaled / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return n, (scaled**2).sum(1), centred @ vectors / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize(("dims", "n"), [(6, 300), (40, 500)])
def test_whitening(spark, dims, n):
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((n, dims)) * np.linspace(3, 0.5, dims) + 100).astype(np.float32).tolist()
    odd = [None, [], [None] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors + odd)], "vec_id long, embedding array<float>, component string").repartition(3)
    rows = whitening.whitened(df).collect()
    count, deviation, want, explained = naive_whitening(vectors)
    k = min(dims, 32)
    assert len(rows) == n * k and {r.n for r in rows} == {count} and max(r.identity_error for r in rows) < 1e-9
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-10
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0])], kind)).count() == 0  # no variance, no component
    mixed = spark.createDataFrame([(1, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [5.0]), (3, [7.0])], kind)
    rows = whitening.whitened(mixed).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == [(0, 1, 2), (1, 1, 3), (1, 1, 3), (1, 1, 3), (3, 1, 2)]
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [1.0])], kind)).collect()


def test_whitening_is_exact_far_from_zero(spark):
    """Products of uncentred entries would need 80 bits; deviations go beyond doubles."""
    values = [[1e9 + k % 5, -1e9 - k % 3] for k in range(200)]
    rows = whitening.whitened(spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")).collect()
    n, deviation, want, explained = naive_whitening(values)
    assert all(r.deviation == deviation[r.vec_id] and abs(abs(r.whitened) - abs(want[r.vec_id, r.component - 1])) < 1e-9 for r in rows) and len(rows) == 400


SPECTRA = {
    "falling": np.exp(-np.arange(64) / 8),
    "flat": 1 + np.linspace(0, 1e-3, 64),
    "equal": np.ones(40),
    "groups": np.repeat([5.0, 3, 1, 0.1], 16),
    "rank three": np.r_[3.0, 2, 1, np.zeros(61)],
    "one far out": np.r_[1000.0, np.linspace(1, 2, 63)],
    "small": np.array([2.0, 1.0]),
    "single": np.array([3.0]),
    "wide": np.exp(-np.arange(200) / 30),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_feast(name):
    values = SPECTRA[name]
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.components(v)
    k, want = len(got), np.sort(values)[::-1]
    assert k == min(32, (values > 0).sum())
    assert np.abs(got - want[:k]).max() < 1e-12 * values.sum()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * values.sum()


def test_inertia():
    a = np.random.default_rng(2).standard_normal((30, 30))
    a += a.T
    shifts = np.linspace(-10, 10, 21)
    assert whitening.inertia(*whitening.tridiagonal(a), shifts).tolist() == [(np.linalg.eigvalsh(a) < s).sum() for s in shifts]
    parts = whitening.intervals(a, 12)
    assert sum(n for *_, n in parts) >= 12 and all(((np.linalg.eigvalsh(a) > low) & (np.linalg.eigvalsh(a) < high)).sum() == n for low, high, n in parts)


def naive_katz(rows, many):
    """[(n_tokens, n_known, base, score, {context: probabilities sum})] of (train, text) rows by plain dictionaries."""
    low = {c: c + 32 for c in range(65, 91)}
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    docs = [(use, cut(t)) for use, t in rows]
    one, two = Counter(), Counter()
    for use, ws in docs:
        if use:
            one.update(ws)
            two.update(zip(["<start>", *ws], ws))
    n, total = sum(one.values()), sum(one.values()) + len(one) + 1
    context = Counter()
    after = {}
    for (v, w), c in two.items():
        context[v] += c
        after.setdefault(v, {})[w] = c
    d = lm.discounts([sum(c == r for c in two.values()) for r in range(1, lm.K + 2)])
    p1 = lambda w: (one[w] + 1) / total
    cut_off = lambda c: d[min(c, lm.K + 1)]

    def p2(v, w):
        seen = after.get(v)
        if not seen:
            return p1(w)
        freed = sum((1 - cut_off(c)) * c for c in seen.values())
        den = context[v] + (freed == 0 or context[v] >= many)
        if w in seen:
            return cut_off(seen[w]) * seen[w] / den
        rest = 1 - sum(cut_off(c) * c / den for c in seen.values())
        return rest / (1 - sum(p1(x) for x in seen)) * p1(w)

    for v in [*after][:40]:  # one class stands for all unknown words
        assert abs(sum(p2(v, w) for w in [*one, "an unknown word"]) - 1) < 1e-9
    return n, [(len(ws), sum(one[w] > 0 for w in ws), sum(math.log10(p1(w)) for w in ws), sum(math.log10(p2(v, w)) for v, w in zip(["<start>", *ws], ws))) for _, ws in docs]


LM_SIZES = {"small": {}, "many blocks": {"block": 300, "bucket": 512, "chunk": 7, "docs": 5}, "rare words": {"block": 2000, "bucket": 256, "common": 5, "least_local": 2, "many": 40}, "no heavy pair": {"heavy": 0, "bucket": 128, "block": 500}}


@pytest.mark.parametrize("name", LM_SIZES)
def test_lm(spark, name):
    sizes = lm.Sizes(**({"many": 60} | LM_SIZES[name]))
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "été", "漢字", " x", "Ünder"]
    texts = [" ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    texts += [None, "", " \t\x0b\n", "same pair " * 400, *["a copy of a text"] * 30, "never seen words here", texts[0], texts[0].upper(), "x" * 5000]
    rows = [(None if i == 7 else i // 2, t, i % 5 != 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, use boolean, score string").repartition(4)
    model = lm.fit(df, F.col("use"), sizes=sizes)
    got = lm.scores(model).collect()
    n, want = naive_katz([(r[2], r[1]) for r in rows], sizes.many)
    assert {r.train_tokens for r in got} == {n}
    line = lambda i, held, a, b, base, score: (-1 if i is None else i, held, a, b, round(base, 6) + 0.0, round(score, 6) + 0.0)
    assert sorted(line(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == sorted(line(r[0], not r[2], *w) for r, w in zip(rows, want))
    assert bool(len(model.words.heavy)) == (name != "no heavy pair") and (name != "rare words" or model.hot)


def test_lm_of_odd_tables(spark):
    kind = "doc_id string, text string, use boolean"
    assert lm.scores(lm.fit(spark.createDataFrame([], kind), F.col("use"))).count() == 0
    untrained = lm.scores(lm.fit(spark.createDataFrame([("a", "b c", False), ("a", None, None)], kind), F.col("use"))).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in untrained) == [("a", True, 1, 0, 0, 0, 0), ("a", True, 3, 0, 0, 0, 0)]
    long = lm.scores(lm.fit(spark.createDataFrame([("a", "ab cd " * 700_000, True), ("b", "ab", True)], kind), F.col("use"))).collect()
    assert {r.doc_id: r.n_tokens for r in long} == {"a": 1_400_001, "b": 2}


def test_discounts():
    d = lm.discounts([1000, 400, 220, 140, 100, 75])
    assert d[0] == d[6] == 1 and all(0 < a < 1 for a in d[1:6])
    assert lm.discounts([10, 0, 0, 0, 0, 0])[1:6].tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_lm_held_out_gain(spark):
    """Pairs must help where they were not learned from."""
    rows = [r for r in lm.op13_lm(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def clashing(spark, module):
    """A table of documents with a column for every name that a module uses."""
    names = sorted(set(re.findall(r"[\"'](_?[a-z][a-z_0-9]*)[\"']", inspect.getsource(module))) | {"_rid", "_n", "_copy", "_run", "_at", "_part", "_id", "_words", "_h", "d", "x", "own0"})
    names = [n for n in names if n not in ("doc_id", "text", "source", "lang", "n_chars")]
    rows = [(k, f"text of {k % 5} in some more words than five so that it counts", f"s{k % 3}", *(f"{n} {k}" for n in names)) for k in range(20)]
    return names, spark.createDataFrame(rows, ["doc_id", "text", "source", *names])


@pytest.mark.parametrize("case", ["sharding", "exact_dedup", "simhash", "similar", "mixing", "mix_plan"])
def test_any_column_name(spark, case):
    module = {"sharding": sharding, "exact_dedup": exact_dedup, "simhash": simhash, "similar": similar, "mixing": mixing, "mix_plan": mixing}[case]
    names, df = clashing(spark, module)
    run, added = {
        "sharding": (sharding.shard_rows, {"global_row", "position", "shard", "slot"}),
        "exact_dedup": (exact_dedup.without_copies, set()),
        "simhash": (simhash.without_near_copies, set()),
        "similar": (similar.without_similar, set()),
        "mixing": (mixing.mix, {"shard", "pass", "place"}),
        "mix_plan": (lambda t: mixing.mix_plan(t.drop("size").withColumn("size", F.lit(12).cast("long"))), {"source_size", "target", "draws", "size"}),
    }[case]
    rows = run(df).collect()
    assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names if n not in added)
    assert set(rows[0].asDict()) == {*df.columns, *added}


def test_two_threads(spark):
    docs = spark.createDataFrame([(k, f"words of text {k % 30} that are more than five of them {k % 7}") for k in range(200)], "doc_id long, text string").persist()
    runs = {"near": lambda: sorted(map(tuple, simhash.near_dedup(docs).collect())), "exact": lambda: sorted(r.doc_id for r in exact_dedup.without_copies(docs).collect())}
    want = {k: f() for k, f in runs.items()}
    with ThreadPoolExecutor(2) as pool:
        jobs = [(k, pool.submit(runs[k])) for _ in range(3) for k in runs]
        assert all(j.result() == want[k] for k, j in jobs)


@pytest.mark.parametrize("n", [500, 2000, 8000])
def test_projections_at_every_size(spark, n):
    """Recall by brute force at cosines just above 0.9, through the projections, with the parameters in use."""
    rng = np.random.default_rng(n)
    x, y = embed_dedup.planted_pairs(64, 0.905, n // 8, seed=n)
    rest = rng.standard_normal((n - 2 * len(x), 64))
    every = np.concatenate([x, y, rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    lines, entered, width, least = embed_dedup.counting_rule(64, n)
    assert lines >= embed_dedup.FEWEST and entered < lines and width < 2 and least > 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df).collect()}
    close = np.argwhere(np.triu(every @ every.T >= 0.9, 1))
    found = sum(got.values()) / 2
    assert len(close) >= len(x) and 0.97 * len(close) <= found <= len(close)


def test_bpe_generations(monkeypatch):
    """Caches of a few pieces, turned over many times, change no id; frequent pieces stay."""
    from paperloom.llm import bpe

    with open(bpe.tokenizer_path(None), encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(2)
    words = ["common"] + ["".join(rng.choice("abcdeé 7") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) + " common" for _ in range(40)) for _ in range(20)]
    whole = bpe.Codec(spec)
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "KEEP", 4)
    small = bpe.Codec(spec)
    assert [small.encode(t) for t in texts] == want
    assert len(small.seen) <= 4 and len(small.before) <= 4 and " common" in {*small.seen, *small.before}
    small.forget()
    assert not small.seen and not small.before and small.encode(texts[0]) == want[0]


def test_round_trip_takes_one_pass(spark):
    """Encoding and decoding share a worker, and give what the two give one after the other."""
    texts = ["", None, "a  b\n", "é😀", "<|endoftext|> x", "word " * 3000]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, decoded string")
    made = bpe.encode(df, decoded="decoded")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert made.columns == bpe.decode(bpe.encode(df)).columns
    assert sorted(map(str, made.collect())) == sorted(map(str, bpe.decode(bpe.encode(df)).collect()))


@pytest.mark.parametrize("groups", [4, 20])
def test_common_passages_leave_heads(spark, groups, monkeypatch):
    """Passages that a number of texts share stay out of the heads, in tables of any size, so texts that share no more than one are not paired."""
    passages = [" ".join(f"p{g}x{k}" for k in range(60)) for g in range(groups)]
    texts = [f"{passages[i % groups]} " + " ".join(f"w{i}x{k}" for k in range(340)) for i in range(60 * groups)]
    df = spark.createDataFrame(list(enumerate(texts)), "_rid long, _text string")
    monkeypatch.setattr(similar, "SAMPLE", 60)
    counts = similar._common(df, similar.WORDS)
    heads = similar._sets(df, similar.WORDS, counts).selectExpr("_rid", "explode(elements) as e")
    pairs = heads.groupBy("e").count().selectExpr("sum(count * (count - 1))").first()[0]
    assert pairs <= 0.01 * 60 * 59 * groups * 12
    assert similar.without_similar(df.toDF("doc_id", "text")).count() == len(texts)


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("large", [2, None])
def test_differences_from_hubs_lose_no_link(spark, large, monkeypatch):
    """Copies with chance edits, cut ones and chains of edits: what stays is as by brute force."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for size, copies in ((140, 320), (60, 60)):
        base = [word() for _ in range(size)]
        texts += [[word() if rng.random() < 0.033 else x for x in base] for _ in range(copies)]
        texts += [base[: size - k] for k in range(0, size // 2, 4)] + [base[k:] for k in range(4, size // 2, 4)]
        texts += [[x for x in base if rng.random() > 0.04] for _ in range(30)]
        chain = base
        for _ in range(12):
            chain = [word() if rng.random() < 0.02 else x for x in chain]
            texts.append(chain)
    sets = [five_words(" ".join(t)) for t in texts]
    root = list(range(len(sets)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(sets)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {k for k in range(len(sets)) if find(k) == k}
    if large:
        monkeypatch.setattr(similar, "LARGE", large)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in similar.without_similar(df).collect()} == want and len(want) > 20


def test_near_copies_pair_in_proportion(spark, monkeypatch):
    """Of many copies with chance edits, about half of them too far from their source, each is compared with a few others only."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, counts, similar_of = [word() for _ in range(140)], [], similar._similar
    texts = [" ".join(word() if rng.random() < 0.023 else x for x in base) for _ in range(500)]
    monkeypatch.setattr(similar, "_similar", lambda pairs, *a: (counts.append(pairs.count()), similar_of(pairs, *a))[1])
    similar.without_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count()
    assert sum(counts) <= 16 * len(texts)


def test_mix_leaves_texts_in_place(spark, monkeypatch):
    """Draws are the same whether the list of blocks is sent or spread, and where it is sent only cut blocks move."""
    rows = [(k, "w " * (k % 90), f"s{k % 4}" if k % 5 else None, k % 90) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    sent = mixing.mix_plan(df, shards=4, block_words=300)
    assert "ShuffledHashJoin" not in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    spread = mixing.mix_plan(df, shards=4, block_words=300)
    assert sorted(map(str, sent.collect())) == sorted(map(str, spread.collect()))
