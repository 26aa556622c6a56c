"""Document classifiers on MLlib: the hybrid feature vector, training, comparison, ablation and grids.

A document's vector is TF-IDF weights of its cleaned text, page-raster features and text features, each
from the relational operators of `features`. Vocabulary, idf, scaler and label index are fitted on the
training part. Documents without a label cannot train or be judged and are left out by name.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.register import Registry
from ..plans.views import view
from ..sources.readers import cached
from ..sources.scratch import new_path
from . import features as V
from . import text_jobs as J

register = Registry()
SEED = 42
#: Vocabulary sizes, C and gamma tried, and the features of each configuration.
SIZES = (300, 500, 750, 1000, 1500, 2000)
CS, GAMMAS = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0), ("scale", "auto")
CONFIGS = {"A: unigrams 500 + image": (1, 500, ("text", "image")), "B: bigrams 500 + image": (2, 500, ("text", "image")), "C: bigrams 500 + image + meta": (2, 500, ("text", "image", "meta")), "D: bigrams 750 + image + meta": (2, 750, ("text", "image", "meta"))}
HYBRID = (2, 750, ("text", "image", "meta"))
FOURIER = 256


def held_out(doc_id: str = "doc_id"):
    """A fifth of the documents, by hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(5)) == 0


def image_features(docs: DataFrame) -> DataFrame:
    """(doc_id, image): 29 raster features; documents without pixels are absent."""
    rows = V.raster_features(V.packed_pages(docs))
    return rows.select("doc_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in V.RASTER)).alias("image"))


class Corpus:
    """Labelled documents with what their vectors are made of; each part is written once."""

    def __init__(self, docs: DataFrame):
        docs = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
        meta = [v.cast("double") for v in X.text_meta_features(F.col("text")).values()]
        base = docs.select("doc_id", "lang", held_out().alias("val"), F.array(*meta).alias("meta"))
        images = image_features(docs)
        self.base = cached(base.join(images, "doc_id", "left").withColumn("image", F.coalesce("image", F.array_repeat(F.lit(0.0), 29))), "base")
        tf = V.terms(docs.withColumn("text", X.clean_ocr_text(F.col("text"))), V.STOP("english"), 2)
        self.tf = cached(tf.withColumn("grams", F.size(F.split("term", " "))), "terms")
        train = self.tf.filter(~held_out())
        self.df = cached(V.document_frequency(train).withColumn("grams", F.size(F.split("term", " "))), "frequencies")
        self.n = docs.filter(~held_out()).agg(F.count(F.lit(1)).alias("n"))
        self.texts = {}

    def text(self, grams: int, k: int) -> DataFrame:
        """(doc_id, text): TF-IDF weights of the k commonest terms of the training part, by term; written once, mostly zeros."""
        if (grams, k) not in self.texts:
            self.texts[grams, k] = cached(self._text(grams, k), "text")
        return self.texts[grams, k]

    def _text(self, grams: int, k: int) -> DataFrame:
        top = V.vocab_topk(self.df.filter(F.col("grams") <= grams), k).orderBy("term").collect()  # k rows
        n = self.n.first()["n"]
        model = self.tf.sparkSession.createDataFrame([(r["term"], at, math.log((1 + n) / (1 + r["df"])) + 1) for at, r in enumerate(top)], "term string, at int, idf double")
        rows = self.tf.join(F.broadcast(model), "term").select("doc_id", "at", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct("at", "w")).alias("t")).select("doc_id", F.col("t.at").alias("at"), F.col("t.w").alias("w"))

        def scatter(batches):
            for b in batches:
                at, sizes = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
                out = np.zeros((b.num_rows, k))
                out[np.repeat(np.arange(b.num_rows), sizes), at] = b.column(2).flatten().to_numpy()
                out /= np.linalg.norm(out, axis=1, keepdims=True)
                ends = pa.array(np.arange(0, out.size + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["doc_id", "text"])

        return lists.mapInArrow(scatter, "doc_id long, text array<double>")

    def assembled(self, grams: int, k: int, parts: tuple[str, ...]) -> DataFrame:
        """(doc_id, lang, val, x): the parts end to end. Documents without a known term have zeros for text."""
        rows = self.base
        if "text" in parts:
            rows = rows.join(self.text(grams, k).hint("merge"), "doc_id", "left").withColumn("text", F.coalesce("text", F.array_repeat(F.lit(0.0), k)))
        return rows.select("doc_id", "lang", "val", F.concat(*parts).alias("x"))

    def scaled(self, grams: int, k: int, parts: tuple[str, ...]) -> DataFrame:
        """(doc_id, label, scaled, val), made when read: only the unscaled vectors, mostly zeros, are written."""
        rows = cached(self.assembled(grams, k, parts).withColumn("raw", array_to_vector("x")).drop("x"), "assembled")
        return preparation().fit(rows.filter(~F.col("val"))).transform(rows).select("doc_id", "label", "scaled", "val")

    def vectors(self, grams: int, k: int, parts: tuple[str, ...]) -> DataFrame:
        """(doc_id, label, scaled, val), written."""
        return cached(self.scaled(grams, k, parts), "vectors")


def preparation() -> Pipeline:
    """Label index and scaler. A class that training lacks gets an index of its own, and so counts as missed."""
    return Pipeline(stages=[StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)])


def fourier(rows: DataFrame, gamma: str | float = "scale", n_out: int = FOURIER) -> DataFrame:
    """`scaled` as random Fourier features cos(w.x + b), which approximate an RBF kernel.

    gamma "auto" is 1 / columns; "scale" divides by the variance of all entries too, and scaled columns
    have variance 1, or 0 if they are constant in training.
    """
    from pyspark.ml.stat import Summarizer

    n_in = rows.select(F.size(vector_to_array("scaled")).alias("n")).first()["n"]
    if gamma == "scale":
        spread = rows.filter(~F.col("val")).select(Summarizer.variance(F.col("scaled")).alias("v")).first()["v"]
        gamma = 1 / max(1.0, float(np.sum(spread.toArray())))
    gamma = 1 / n_in if gamma == "auto" else float(gamma)
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((n_in, n_out)) * (2 * gamma) ** 0.5, rng.uniform(0, 2 * np.pi, n_out)

    @F.pandas_udf("array<double>")
    def lifted(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.stack(x.to_numpy()) @ w + b))) if len(x) else pd.Series([], dtype=object)

    return cached(rows.withColumn("scaled", array_to_vector(lifted(vector_to_array("scaled")))), "lifted")


def estimator(name: str, n: int, c: float = 1.0):
    return {
        "rf": lambda: RandomForestClassifier(labelCol="label", featuresCol="scaled", numTrees=200, maxDepth=10, seed=SEED),
        "lr": lambda: LogisticRegression(labelCol="label", featuresCol="scaled", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=60),
        "nb": lambda: NaiveBayes(labelCol="label", featuresCol="scaled", modelType="gaussian"),
    }[name]()


def descent(start: np.ndarray, most: int = 30, memory: int = 10, tol: float = 1e-6):
    """L-BFGS with step halving as a coroutine: yields points, takes the value and gradient of each, returns the best."""
    x, pairs = start, []
    f, g = yield x
    for _ in range(most):
        q, kept = g.copy(), []
        for s, y, r in reversed(pairs):
            kept.append(r * (s @ q))
            q -= kept[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y, r), a in zip(pairs, reversed(kept)):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, -(g @ q)
        for _ in range(20):
            there = x - step * q
            value, slant = yield there
            if value <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y, gain = there - x, slant - g, f - value
        x, f, g = there, value, slant
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        if gain <= tol * abs(f):
            break
    return x


def machines(train: DataFrame, cs: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linear support vector machines, each class against the rest, for each C: weights (a row for each class) and intercepts.

    The objective of MLlib's LinearSVC with regParam 1 / (C n) and 30 iterations: mean hinge loss, and the squares of the
    weights of standardised columns. All machines descend at once, each by its own steps: a pass over the rows gives
    loss and gradient of every machine, so passes do not multiply with classes and Cs, and rows are stored once. A task
    gets and gives machines x columns numbers. A class that training lacks is never predicted.
    """
    rows = train.select(F.col("label").cast("int").alias("label"), vector_to_array("scaled").alias("x"))

    def summed(of):
        def run(batches):
            total = 0.0
            for b in batches:
                if b.num_rows:
                    total = total + of(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        return sum(np.frombuffer(r["s"]) for r in rows.mapInArrow(run, "s binary").collect())  # a row a task

    names = train.schema["label"].metadata.get("ml_attr", {}).get("vals")
    classes = len(names) if names else int(train.agg(F.max("label")).first()[0]) + 1
    moments = summed(lambda y, x: np.concatenate([np.bincount(y, minlength=classes), x.sum(0), (x * x).sum(0)]))
    seen, d = moments[:classes], (len(moments) - classes) // 2
    n, mean = seen.sum(), moments[classes : classes + d] / seen.sum()
    var = (moments[classes + d :] - n * mean * mean) / max(n - 1, 1)
    inverse = np.where(var > 1e-12, 1 / np.sqrt(np.maximum(var, 1e-12)), 0.0)
    each = [(c, k) for c in cs for k in range(classes) if seen[k]]
    plain = lambda p: (p[:-1] * inverse, p[-1] - p[:-1] @ (mean * inverse))  # noqa: E731  weights of columns as they are
    running, asked, done = {}, {}, {}
    for m in each:
        running[m] = descent(np.zeros(d + 1))
        asked[m] = next(running[m])
    while running:
        now = list(running)
        w, b = (np.array(v) for v in zip(*(plain(asked[m]) for m in now)))
        own = np.array([k for _, k in now])

        def hinge(y, x, w=w, b=b, own=own):
            side = np.where(y[:, None] == own, 1.0, -1.0)
            short = 1 - side * (x @ w.T + b)
            pull = np.where(short > 0, -side, 0.0)
            return np.column_stack([np.maximum(short, 0).sum(0), pull.T @ x, pull.sum(0)])

        for m, row in zip(now, summed(lambda y, x: hinge(y, x).ravel()).reshape(len(now), -1) / n):
            p, weight = asked[m][:-1], 1 / (m[0] * max(n, 1))
            slope = np.append((row[1:-1] - mean * row[-1]) * inverse + weight * p, row[-1])
            try:
                asked[m] = running[m].send((row[0] + weight / 2 * (p @ p), slope))
            except StopIteration as end:
                done[m] = end.value
                del running[m]
    never = (np.zeros(d), -np.inf)
    return [tuple(np.array(v) for v in zip(*(plain(done[c, k]) if seen[k] else never for k in range(classes)))) for c in cs]


def machine_scores(data: DataFrame, cs: tuple[float, ...]) -> list[DataFrame]:
    """(doc_id, label, prediction, probability) of the held-out part by linear machines, for each C.

    Machines give no probabilities; theirs are the softmax of the class margins.
    """
    def scored(w, b):
        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_numpy()) @ w.T + b)) if len(x) else pd.Series([], dtype=object)

        rows = data.filter("val").select("doc_id", "label", margins(vector_to_array("scaled")).alias("m"))
        prediction = (F.array_position("m", F.array_max("m")) - 1).cast("double")
        power = F.transform("m", lambda x: F.exp(x))
        return rows.select("doc_id", "label", prediction.alias("prediction"), F.transform(power, lambda x: x / F.aggregate(power, F.lit(0.0), lambda a, b: a + b)).alias("probability"))

    return [scored(w, b) for w, b in machines(data.filter(~F.col("val")), tuple(cs))]


def fit_score(data: DataFrame, name: str, c: float | None = None, gamma: str = "scale") -> DataFrame:
    """(doc_id, label, prediction, probability) of the held-out part.

    "rbf" is the linear machine over Fourier features, C = 10 unless given.
    """
    if name == "rbf":
        data, name, c = fourier(data, gamma), "svm", 10.0 if c is None else c
    if name == "svm":
        return machine_scores(data, (1.0 if c is None else c,))[0]
    train, val = data.filter(~F.col("val")), data.filter("val")
    out = estimator(name, train.count(), 1.0 if c is None else c).fit(train).transform(val)
    return out.select("doc_id", "label", "prediction", vector_to_array("probability").alias("probability"))


def soft_vote(scored: list[DataFrame]) -> DataFrame:
    """(doc_id, label, prediction): the class of the highest mean probability, the first of equals."""
    each = reduce(DataFrame.unionByName, scored).select("doc_id", "label", F.posexplode("probability").alias("class", "p"))
    mean = each.groupBy("doc_id", "label", "class").agg(F.avg("p").alias("p"))
    return mean.groupBy("doc_id", "label").agg(F.max_by("class", F.struct("p", -F.col("class"))).cast("double").alias("prediction"))


def metrics(scored: DataFrame) -> tuple[float, float, float, float]:
    """Accuracy and support-weighted precision, recall and F1, from the table of classes."""
    cells = {(r["label"], r["prediction"]): r["count"] for r in scored.groupBy("label", "prediction").count().collect()}
    n, total = max(1, sum(cells.values())), [0.0, 0.0, 0.0]
    for k in {a for a, _ in cells}:
        hit, support, said = cells.get((k, k), 0), sum(v for (a, _), v in cells.items() if a == k), sum(v for (_, p), v in cells.items() if p == k)
        p, r = hit / said if said else 0.0, hit / support
        total = [t + support / n * v for t, v in zip(total, (p, r, 2 * p * r / (p + r) if p + r else 0.0))]
    return (sum(v for (a, p), v in cells.items() if a == p) / n, *total)


RESULT = "model string, features string, param string, accuracy double, precision double, recall double, f1 double"


def results(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], RESULT)


def _corpus(spark, sf) -> Corpus:
    return Corpus(view(spark, sf, "documents"))


for _name, _key in (("rf", "train_rf"), ("lr", "train_logreg"), ("nb", "train_nb"), ("svm", "train_linear_svm"), ("rbf", "train_rbf_svm_approx")):

    @register(_key)
    def _train(spark, sf, name=_name):
        """Held-out predictions of a model trained on the rest, over the hybrid vector."""
        return fit_score(_corpus(spark, sf).vectors(*HYBRID), name).select("doc_id", "label", "prediction")


def gaussian_fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaussian naive Bayes from rows (label, feature, value): (feature, label, mean, var) and (label, prior).

    Two grouped aggregates with map-side sums. A variance grows by 1e-9 of its feature's over all classes
    (of 1 for a constant feature), which is the smoothing of standardised features. Each document has one
    row of each feature; the tables have classes x features and classes rows.
    """
    moments = rows.groupBy("feature", "label").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n"))
    spread = rows.groupBy("feature").agg(F.var_pop("value").alias("all"), F.count(F.lit(1)).alias("docs"))
    model = cached(moments.join(F.broadcast(spread), "feature").select("feature", "label", "mean", (F.col("v") + 1e-9 * F.when(F.col("all") > 0, F.col("all")).otherwise(1.0)).alias("var"), F.log(F.col("n") / F.col("docs")).alias("prior")), "moments")
    return model.drop("prior"), model.groupBy("label").agg(F.max("prior").alias("prior"))


def gaussian_scores(rows: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, label, score): log density plus log prior of rows (doc_id, feature, value), for every class.

    The model goes to the rows, as it has classes x features rows; what is shuffled is a partial sum for
    each document and class.
    """
    gap = F.col("value") - F.col("mean")
    density = -0.5 * (F.log(2 * math.pi * F.col("var")) + gap * gap / F.col("var"))
    return rows.join(F.broadcast(model), "feature").groupBy("doc_id", "label").agg(F.sum(density).alias("s")).join(F.broadcast(priors), "label").select("doc_id", "label", (F.col("s") + F.col("prior")).alias("score"))


def gaussian_classify(rows: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, prediction): the class of the highest score, the last by name of equals."""
    return gaussian_scores(rows, model, priors).groupBy("doc_id").agg(F.max_by("label", F.struct("score", "label")).alias("prediction"))


_NUMBERS = (*V.RASTER[:17], *V.RASTER[23:], *J.META)
_SQL_ROWS = f"(unpivot (select d.doc_id, lang as label, {', '.join(f'cast(coalesce({c}, 0) as double) as {c}' for c in _NUMBERS)} from (select doc_id, lang from documents where lang is not null) d left join ({V.ORACLES['raster_density']}) a on a.doc_id = d.doc_id left join ({V.ORACLES['raster_margins']}) b on b.doc_id = d.doc_id left join ({V.ORACLES['raster_edges']}) c on c.doc_id = d.doc_id left join ({J.ORACLES['text_meta_features']}) e on e.doc_id = d.doc_id) on {', '.join(_NUMBERS)} into name feature value value)"


@register(
    "gaussian_nb",
    f"""with f as materialized (select * from {_SQL_ROWS}), t as (select * from f where doc_id % 5 <> 0),
 m as (select feature, label, avg(value) as mean, var_pop(value) as v, count(*) as n from t group by feature, label), g as (select feature, var_pop(value) as a, count(*) as docs from t group by feature),
 p as (select m.feature, label, mean, v + 1e-9::double * case when a > 0 then a else 1.0::double end as var, ln(n / docs) as prior from m join g on g.feature = m.feature)
 select doc_id, truth as label, arg_max(label, score) as prediction from (select f.doc_id, f.label as truth, p.label, sum(-0.5 * (ln(2 * pi() * var) + (value - mean) * (value - mean) / var)) + max(prior) as score from f join p on p.feature = f.feature where f.doc_id % 5 = 0 group by f.doc_id, f.label, p.label) group by doc_id, truth""",
)
def gaussian_nb(spark, sf):
    """Class moments by aggregates over raster and text features in long form; every fifth document is held out."""
    docs = view(spark, sf, "documents").filter("lang is not null").select("doc_id", F.col("lang").alias("label"), "text")
    raster = V.raster_features(V.packed_pages(docs, "doc_id", "label", "text"), "doc_id", "label", "text")
    blank = docs.filter(F.coalesce(F.length("text"), F.lit(0)) == 0).select("doc_id", "label", "text", *(F.lit(None).cast("double").alias(c) for c in V.RASTER))
    digits = dict.fromkeys(V.RASTER[27:], 6)
    made = raster.select("doc_id", "label", "text", *(F.round(c, digits.get(c, 7)).alias(c) for c in V.RASTER)).unionByName(blank)
    wide = J.meta_features(made, "doc_id", "label", *(c for c in _NUMBERS if c in V.RASTER))
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in _NUMBERS))
    rows = cached(wide.select("doc_id", "label", F.explode(each).alias("f")).select("doc_id", "label", "f.*"), "features")
    model, priors = gaussian_fit(rows.filter("doc_id % 5 <> 0").drop("doc_id"))
    held = rows.filter("doc_id % 5 = 0")
    truth = held.filter(F.col("feature") == "ink").select("doc_id", "label")
    return truth.join(gaussian_classify(held.drop("label"), model, priors).hint("merge"), "doc_id")


@register("assemble_features")
def assemble_features(spark, sf):
    """The vector of every labelled document: its length, and the norms of its text, image and meta parts."""
    k, x = HYBRID[1], F.col("x")
    norm = lambda a: F.round(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)), 5)
    rows = cached(_corpus(spark, sf).assembled(*HYBRID), "assembled")
    return rows.select("doc_id", F.size("x").alias("dims"), norm(F.slice(x, 1, k)).alias("text"), norm(F.slice(x, k + 1, 29)).alias("image"), norm(F.slice(x, k + 30, 15)).alias("meta"))


@register("compare_models")
def compare_models(spark, sf):
    """Five models on the hybrid vector."""
    data = _corpus(spark, sf).vectors(*HYBRID)
    return results(spark, [(m, "hybrid", "", *metrics(fit_score(data, m))) for m in ("rf", "rbf", "svm", "lr", "nb")])


@register("ablation")
def ablation(spark, sf):
    """Text, image and both, by three models."""
    corpus, rows = _corpus(spark, sf), []
    for name, parts in (("text", ("text",)), ("image", ("image",)), ("hybrid", ("text", "image"))):
        data = corpus.vectors(1, 750, parts)
        rows += [(m, name, "", *metrics(fit_score(data, m))) for m in ("rbf", "rf", "lr")]
    return results(spark, rows)


@register("grid_vocab")
def grid_vocab(spark, sf):
    """Vocabulary sizes, with and without image features, by the RBF machine; a few sizes at once, as fits are many short jobs."""
    corpus, sets = _corpus(spark, sf), (("hybrid", ("text", "image")), ("text", ("text",)))

    def of(k):
        return [("rbf", name, f"vocabulary={k}", *metrics(fit_score(corpus.scaled(1, k, parts), "rbf"))) for name, parts in sets]

    with ThreadPoolExecutor(3) as pool:
        return results(spark, [row for rows in pool.map(inheritable_thread_target(spark)(of), SIZES) for row in rows])


@register("grid_c_gamma")
def grid_c_gamma(spark, sf):
    """C by gamma of the RBF machine over 1000 unigrams and image features. All Cs are fitted together."""
    data, rows = _corpus(spark, sf).scaled(1, 1000, ("text", "image")), []
    for gamma in GAMMAS:
        rows += [("rbf", "hybrid", f"C={c} gamma={gamma}", *metrics(scored)) for c, scored in zip(CS, machine_scores(fourier(data, gamma), CS))]
    return results(spark, rows)


@register("select_config")
def select_config(spark, sf):
    """The best of four configurations by the RBF machine and the soft vote of three models; the first of equals."""
    corpus, tried = _corpus(spark, sf), []
    for name, config in CONFIGS.items():
        data = corpus.vectors(*config)
        scored = [cached(fit_score(data, m), "scored") for m in ("rbf", "lr", "rf")]
        tried += [("rbf", name, "", *metrics(scored[0])), ("ensemble", name, "", *metrics(soft_vote(scored)))]
    best = max(tried, key=lambda r: r[3])  # max keeps the first
    return results(spark, [best])


@register("model_store")
def model_store(spark, sf):
    """A pipeline saved to the shared folder, loaded again, and applied."""
    rows = _corpus(spark, sf).assembled(*HYBRID).withColumn("raw", array_to_vector("x")).select("doc_id", "lang", "val", "raw")
    rows = cached(rows, "assembled")
    path = new_path(spark, "model")
    Pipeline(stages=[*preparation().getStages(), estimator("nb", 1)]).fit(rows.filter(~F.col("val"))).write().overwrite().save(path)
    return PipelineModel.load(path).transform(rows).select("doc_id", "label", "prediction")


QUERIES, ORACLES = register.queries, register.oracles
