"""Classifiers: the vector against plain formulas, the measures by hand, sizes and accuracies of the experiments."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paperloom.operators import features as V
from paperloom.operators import models as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return M.Corpus(spark.read.parquet(f"{SF}/documents.parquet"))


def plain_tfidf(texts, train, k):
    """Unigrams and bigrams of two letters or more, (1 + ln tf) * idf, length 1, by term."""
    stop, counts = set(V.STOP("english")), {}
    for i, t in texts.items():
        clean = " ".join(w for w in re.sub(r"[^\x00-\x7f]", "", t or "").split() if len(w) > 1 or w.isdigit())
        words = [w for w in re.findall(r"\b\w\w+\b", clean.lower()) if w not in stop]
        counts[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    total, df = Counter(), Counter()
    for i in train:
        total.update(counts[i])
        df.update(counts[i].keys())
    terms = sorted(sorted(total, key=lambda w: (-total[w], w))[:k])
    out = {}
    for i, c in counts.items():
        v = [(1 + math.log(c[w])) * (math.log((1 + len(train)) / (1 + df[w])) + 1) if c[w] else 0.0 for w in terms]
        size = math.sqrt(sum(x * x for x in v))
        out[i] = [x / size if size else 0.0 for x in v]
    return out


def test_vector(spark, corpus):
    rows = {r.doc_id: r for r in corpus.assembled(2, 60, ("text", "image", "meta")).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.lang}
    want = plain_tfidf(texts, [i for i, r in rows.items() if not r.val], 60)
    assert set(rows) == set(texts) and all(len(r.x) == 60 + 29 + 15 for r in rows.values())
    assert all(r.x[:60] == pytest.approx(want[i], abs=1e-9) for i, r in rows.items())
    ink = {r.doc_id: r.ink for r in V.QUERIES["raster_density"](spark, SF).collect()}
    assert all(r.x[60] == pytest.approx(ink.get(i, 0.0), abs=1e-6) for i, r in rows.items())
    assert all(r.x[89] == len(texts[i] or "") for i, r in rows.items())


def test_gaussian_bayes(corpus):
    """Predictions against the formula: normal densities by class and column, with class shares."""
    data = corpus.vectors(2, 60, ("text", "meta"))
    rows = data.select("doc_id", "label", "val", vector_to_array("scaled").alias("x")).collect()
    x, y, val = np.array([r.x for r in rows]), np.array([r.label for r in rows]), np.array([r.val for r in rows])
    train, classes = ~val, sorted(set(y[~val]))
    floor = 1e-9 * x[train].var(0).max()
    score = np.stack([math.log((y[train] == c).mean()) - 0.5 * (np.log(2 * np.pi * (v := x[train & (y == c)].var(0) + floor)) + (x - x[train & (y == c)].mean(0)) ** 2 / v).sum(1) for c in classes], axis=1)
    want = {r.doc_id: classes[k] for r, k in zip(rows, score.argmax(1))}
    got = {r.doc_id: r.prediction for r in M.fit_score(data, "nb").collect()}
    assert set(got) == {r.doc_id for r in rows if r.val}
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def test_measures(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 1)]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pairs)], "doc_id long, label double, prediction double")
    p, r = {0: 5 / 6, 1: 3 / 6, 2: 0.0}, {0: 5 / 7, 1: 3 / 4, 2: 0.0}
    share = {0: 7 / 12, 1: 4 / 12, 2: 1 / 12}
    f = {c: 2 * p[c] * r[c] / (p[c] + r[c]) if p[c] + r[c] else 0.0 for c in p}
    assert M.metrics(df) == pytest.approx((8 / 12, *(sum(share[c] * m[c] for c in share) for m in (p, r, f))))


def test_soft_vote(spark):
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, label double, prediction double, probability array<double>")
    a, b = made([(1, 0.0, 0.0, [0.6, 0.4]), (2, 1.0, 0.0, [0.5, 0.5])]), made([(1, 0.0, 1.0, [0.1, 0.9]), (2, 1.0, 0.0, [0.5, 0.5])])
    assert {r.doc_id: r.prediction for r in M.soft_vote([a, b]).collect()} == {1: 1.0, 2: 0.0}


def test_fourier_kernel(corpus):
    """Inner products of the features approximate the kernel."""
    data = corpus.vectors(1, 40, ("text", "image"))
    lifted = M.fourier(data, 0.01, 4096)
    rows = data.join(lifted.select("doc_id", F.col("scaled").alias("z")), "doc_id").select(vector_to_array("scaled").alias("x"), vector_to_array("z").alias("z")).limit(20).collect()
    x, z = np.array([r.x for r in rows]), np.array([r.z for r in rows])
    kernel = np.exp(-0.01 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(2 * z @ z.T / 4096 - kernel).max() < 0.1


@pytest.mark.parametrize("name, rows, least", [("ablation", 9, 0.2), ("grid_c_gamma", 4, 0.2), ("grid_vocab", 4, 0.2), ("select_config", 1, 0.85)])
def test_experiments(spark, corpus, monkeypatch, name, rows, least):
    """Shorter lists of sizes, C and configurations, one corpus and fewer trees; the queries run all."""
    plain = M.estimator
    monkeypatch.setattr(M, "estimator", lambda kind, n, c=1.0: plain(kind, n, c).setNumTrees(20) if kind == "rf" else plain(kind, n, c))
    monkeypatch.setattr(M, "_corpus", lambda spark, sf: corpus)
    monkeypatch.setattr(M, "SIZES", (300, 500))
    monkeypatch.setattr(M, "CS", (1.0, 10.0))
    monkeypatch.setattr(M, "CONFIGS", {k: M.CONFIGS[k] for k in list(M.CONFIGS)[::3]})
    got = M.QUERIES[name](spark, SF).collect()
    assert len(got) == rows and all(least <= r.accuracy <= 1 and 0 <= r.f1 <= 1 and r.recall == pytest.approx(r.accuracy) for r in got)
    assert len({(r.model, r.features, r.param) for r in got}) == rows and max(r.accuracy for r in got) >= 0.85


def test_five_models(spark):
    got = M.QUERIES["compare_models"](spark, SF).collect()
    assert {r.model for r in got} == {"rf", "rbf", "svm", "lr", "nb"} and all(r.accuracy >= 0.85 and r.f1 >= 0.85 for r in got)


def test_training(spark):
    rows = M.QUERIES["train_nb"](spark, SF).collect()
    assert len(rows) >= 30 and sum(r.label == r.prediction for r in rows) >= 0.85 * len(rows)


def test_gaussian_tables(spark):
    """Scores of the relational form by the formula, with a feature constant in training and one constant in a class."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 4)) * [1, 50, 1e-3, 0] + y[:, None] * [0.5, 10, 1e-3, 0]
    x[y == 1, 1] = 7.0
    x[80:, 3] = 0.5  # seen in no training row
    train = np.arange(90) < 80
    rows = [(int(i), f"c{y[i]}", f"f{j}", float(x[i, j])) for i in range(90) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, label string, feature string, value double")
    model, priors = M.gaussian_fit(df.filter("doc_id < 80").drop("doc_id"))
    held = df.filter("doc_id >= 80").drop("label")
    spread = np.where(x[train].var(0) > 0, x[train].var(0), 1.0)
    want = {}
    for c in range(3):
        part = x[train & (y == c)]
        v = part.var(0) + 1e-9 * spread
        for i in range(80, 90):
            want[i, f"c{c}"] = math.log(len(part) / 80) - 0.5 * (np.log(2 * np.pi * v) + (x[i] - part.mean(0)) ** 2 / v).sum()
    got = {(r.doc_id, r.label): r.score for r in M.gaussian_scores(held, model, priors).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    best = {i: max((want[i, f"c{c}"], f"c{c}") for c in range(3))[1] for i in range(80, 90)}
    assert {r.doc_id: r.prediction for r in M.gaussian_classify(held, model, priors).collect()} == best
