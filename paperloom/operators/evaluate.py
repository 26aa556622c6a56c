"""Evaluation of classifiers and field extraction, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.register import Registry
from ..plans.views import view

register = Registry()
LANGS = ["de", "en", "es", "fr"]


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """All cells, zero-filled: one row per actual label, one column per predicted one."""
    return pairs.groupBy("actual").pivot("predicted", labels).count().na.fill(0)


def class_report(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for each class, then accuracy, macro and weighted rows.

    0/0 counts as 0. Per-class sums come from one aggregate over the confusion cells.
    """
    cells = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("n", F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.col("n").alias("p")))).alias("x"), (F.col("actual") == F.col("predicted")).alias("hit"))
    sums = each.groupBy("x.label").agg(F.sum("x.a").alias("support"), F.sum("x.p").alias("chosen"), F.sum(F.when(F.col("hit"), F.col("x.a"))).alias("hits"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.coalesce(a, F.lit(0)) / b)
    rows = sums.select("label", ratio(F.col("hits"), F.col("chosen")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), F.col("support").cast("long"))
    rows = rows.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")
    marks = ("precision", "recall", "f1")
    macro = rows.agg(*(F.avg(m).alias(m) for m in marks), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "*")
    weighted = rows.agg(*((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in marks), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "*")
    accuracy = pairs.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("a"), F.count(F.lit(1)).alias("support")).select(F.lit("accuracy").alias("label"), *(F.col("a").alias(m) for m in marks), "support")
    return reduce(DataFrame.unionByName, [rows, accuracy, macro, weighted]).select("label", *(F.round(m, 9).alias(m) for m in marks), "support")


_PRF = """with c as (select actual, predicted, count(*) as n from v_class_pred group by actual, predicted),
 s as (select label, sum(a) as support, sum(p) as chosen, sum(h) as hits from (
   select actual as label, n as a, 0 as p, case when actual = predicted then n else 0 end as h from c union all select predicted, 0, n, 0 from c) group by label),
 r as (select label, case when chosen = 0 then 0 else hits / chosen end as precision, case when support = 0 then 0 else hits / support end as recall, support from s),
 f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from r)"""


def nested(sql: str) -> str:
    """A statement with its own WITH, so that views can stand in front of it."""
    return f"select * from ({sql}) q"


@register("confusion_matrix", "select actual, " + ", ".join(f"count(*) filter (predicted = '{x}') as {x}" for x in LANGS) + " from v_class_pred group by actual")
def q_confusion(spark, sf):
    return confusion_matrix(view(spark, sf, "v_class_pred"), LANGS)


@register("accuracy", "select round(avg(case when actual = predicted then 1.0 else 0.0 end), 9) as accuracy, count(*) as n from v_class_pred")
def accuracy(spark, sf):
    return view(spark, sf, "v_class_pred").agg(F.round(F.avg((F.col("actual") == F.col("predicted")).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@register("weighted_prf", nested(f"{_PRF} select round(sum(precision * support) / sum(support), 9) as precision, round(sum(recall * support) / sum(support), 9) as recall, round(sum(f1 * support) / sum(support), 9) as f1 from f"))
def weighted_prf(spark, sf):
    return class_report(view(spark, sf, "v_class_pred")).filter("label = 'weighted avg'").select("precision", "recall", "f1")


@register(
    "class_report",
    nested(f"""{_PRF} select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, cast(support as bigint) as support from f
 union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), cast(sum(support) as bigint) from f
 union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from f
 union all select 'accuracy', a, a, a, n from (select round(avg(case when actual = predicted then 1.0 else 0.0 end), 9) as a, count(*) as n from v_class_pred)"""),
)
def q_class_report(spark, sf):
    return class_report(view(spark, sf, "v_class_pred"))


@register("model_ranking", "select model, features, acc as accuracy, row_number() over (order by acc desc, model, features) as place from (select model, label as features, round(avg(p), 9) as acc from v_probs group by model, label)")
def model_ranking(spark, sf):
    """Models by score, the first of equal ones by name. The window runs over the list of models."""
    scores = view(spark, sf, "v_probs").groupBy("model", F.col("label").alias("features")).agg(F.round(F.avg("p"), 9).alias("accuracy"))
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "model", "features")))


def normalised(col: str) -> Column:
    """Currency signs and commas dropped, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), "[$€£,]", "")))


def field_support_stats(rows: DataFrame) -> DataFrame:
    """Per field: support, non-empty predictions, exact and symmetric partial hits at support."""
    g, p = normalised("gt"), normalised("pred")
    rows = rows.select("field", g.alias("g"), p.alias("p"))
    has = F.col("g") != ""
    sums = rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has).alias("support"),
        F.count_if(F.col("p") != "").alias("pred_non_empty"),
        F.count_if(has & (F.col("g") == F.col("p"))).alias("exact_hits"),
        F.count_if(has & (F.col("p") != "") & (F.col("p").contains(F.col("g")) | F.col("g").contains(F.col("p")))).alias("partial_hits"),
    )
    at = lambda c: F.round(F.when(F.col("support") == 0, 0.0).otherwise(F.col(c) / F.col("support") * 100), 6)
    return sums.select("field", "support", F.round(F.col("pred_non_empty") / F.col("n") * 100, 6).alias("pred_pct"), at("exact_hits").alias("exact_pct"), at("partial_hits").alias("partial_pct"))


def field_match_naive(rows: DataFrame) -> DataFrame:
    """Shares over all rows: equal (two blanks count), and truth within prediction."""
    g, p = normalised("gt"), normalised("pred")
    return rows.groupBy("field").agg(F.round(F.avg((g == p).cast("double")) * 100, 6).alias("exact_pct"), F.round(F.avg(p.contains(g).cast("double")) * 100, 6).alias("partial_pct"))


_N = "lower(trim(regexp_replace(coalesce({0}, ''), '[$€£,]', '', 'g'), ' '))"
_GP = f"select field, {_N.format('gt')} as g, {_N.format('pred')} as p from v_truth_pred"
_NAIVE = f"select field, round(avg(case when g = p then 1.0 else 0.0 end) * 100, 6) as exact_pct, round(avg(case when contains(p, g) then 1.0 else 0.0 end) * 100, 6) as partial_pct from ({_GP}) group by field"


@register("field_support_stats", f"select field, count(*) filter (g <> '') as support, round(count(*) filter (p <> '') / count(*) * 100, 6) as pred_pct, round(count(*) filter (g <> '' and g = p) / count(*) filter (g <> '') * 100, 6) as exact_pct, round(count(*) filter (g <> '' and p <> '' and (contains(p, g) or contains(g, p))) / count(*) filter (g <> '') * 100, 6) as partial_pct from ({_GP}) group by field")
def q_field_support(spark, sf):
    return field_support_stats(view(spark, sf, "v_truth_pred"))


@register("field_match_naive", _NAIVE)
def q_field_naive(spark, sf):
    return field_match_naive(view(spark, sf, "v_truth_pred"))


@register("normalise_eval", f"select doc_id, field, {_N.format('pred')} as value from v_truth_pred")
def normalise_eval(spark, sf):
    return view(spark, sf, "v_truth_pred").select("doc_id", "field", normalised("pred").alias("value"))


def field_detection_rate(boxes: DataFrame, classes: DataFrame, least: float = 0.25) -> DataFrame:
    """Share of images, of all that have boxes, with a box of each class at that confidence."""
    n = boxes.agg(F.count_distinct("image_id").alias("n"))
    seen = boxes.filter(F.col("confidence") >= least).groupBy("label").agg(F.count_distinct("image_id").alias("seen"))
    # one row each: the count of images, and one row for each class
    return classes.join(seen, "label", "left").join(F.broadcast(n)).select("label", F.round(F.coalesce("seen", F.lit(0)) / F.col("n") * 100, 6).alias("detected_pct"))


_RATE = "select c.label, round(coalesce(seen, 0) / n * 100, 6) as detected_pct from (select distinct label from v_detections union select 'stamp') c left join (select label, count(distinct image_id) as seen from v_detections where confidence >= 0.25 group by label) s on s.label = c.label cross join (select count(distinct image_id) as n from v_detections)"


def _classes(boxes: DataFrame) -> DataFrame:
    return boxes.select("label").distinct().union(boxes.sparkSession.range(1).select(F.lit("stamp").alias("label")))


@register("field_detection_rate", _RATE)
def q_detection_rate(spark, sf):
    boxes = view(spark, sf, "v_detections")
    return field_detection_rate(boxes, _classes(boxes))


@register("benchmark_compare", f"select n.field, exact_pct, partial_pct, coalesce(detected_pct, 0.0) as detected_pct from ({_NAIVE}) n left join (select case label when 'table' then 'Total' when 'paragraph' then 'Client_Name' end as field, detected_pct from ({_RATE})) r on r.field = n.field")
def benchmark_compare(spark, sf):
    """Exact and partial matches beside the detection rate of each field's box class."""
    boxes = view(spark, sf, "v_detections")
    rate = field_detection_rate(boxes, _classes(boxes)).select(F.when(F.col("label") == "table", "Total").when(F.col("label") == "paragraph", "Client_Name").alias("field"), "detected_pct")
    return field_match_naive(view(spark, sf, "v_truth_pred")).join(rate, "field", "left").select("field", "exact_pct", "partial_pct", F.coalesce("detected_pct", F.lit(0.0)).alias("detected_pct"))


@register("join_gt_pred", "select doc_id, field, max(answer) filter (part = 0) as gt, max(answer) filter (part = 1) as pred from (select doc_id, field, answer, 0 as part from v_answers union all select doc_id, field, arg_min(answer, q_rank), 1 from v_qa where score >= 0.05 group by doc_id, field) group by doc_id, field")
def join_gt_pred(spark, sf):
    """Each truth with the first answer, by rank, that is confident enough; none where no answer is."""
    pred = view(spark, sf, "v_qa").filter("score >= 0.05").groupBy("doc_id", "field").agg(F.min_by("answer", "q_rank").alias("pred"))
    return view(spark, sf, "v_answers").withColumnRenamed("answer", "gt").join(pred, ["doc_id", "field"], "left")


@register("soft_vote", "select doc_id, label, round(p, 9) as p from (select doc_id, label, avg(p) as p, row_number() over (partition by doc_id order by round(avg(p), 9) desc, label) as k from v_probs group by doc_id, label) where k = 1")
def soft_vote(spark, sf):
    """Mean probability per class over the models; the largest wins, ties by label."""
    means = view(spark, sf, "v_probs").groupBy("doc_id", "label").agg(F.round(F.avg("p"), 9).alias("p"))
    best = means.groupBy("doc_id").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("b"))
    return best.select("doc_id", "b.label", (-F.col("b.q")).alias("p"))


@register("score_documents", "select doc_id, label as predicted_label, p as confidence, scores from (select doc_id, label, round(p, 4) as p, string_agg(label || ':' || cast(cast(round(p * 10000) as bigint) as varchar), ',' ) over (partition by doc_id order by label rows between unbounded preceding and unbounded following) as scores, row_number() over (partition by doc_id order by p desc, label) as k from v_probs where model = 'svm') where k = 1")
def score_documents(spark, sf):
    """Label, confidence and score map of each document from its class probabilities."""
    probs = view(spark, sf, "v_probs").filter("model = 'svm'")
    rows = probs.groupBy("doc_id").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("all_scores"))
    rounded = F.transform_values("all_scores", lambda k, v: F.round(v, 4))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(rounded)), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 10000).cast("long").cast("string"))), ",")
    return rows.select("doc_id", F.col("best.label").alias("predicted_label"), F.round(-F.col("best.q"), 4).alias("confidence"), shown.alias("scores"))


@register("round_scores", "select doc_id, model, label, round(p / 3, 4) as score from v_probs")
def round_scores(spark, sf):
    maps = view(spark, sf, "v_probs").groupBy("doc_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("p") / 3))).alias("m"))
    return maps.select("doc_id", "model", F.explode(F.transform_values("m", lambda k, v: F.round(v, 4))).alias("label", "score"))


@register("score_map", "select doc_id, l.label, case when v.predicted = l.label then 1.0 else 0.0 end as score from v_class_pred v cross join (select distinct lang as label from documents) l")
def score_map(spark, sf):
    """One-hot scores for models without probabilities."""
    one_hot = F.map_from_arrays(F.array(*map(F.lit, LANGS)), F.array(*((F.col("predicted") == x).cast("double") for x in LANGS)))
    return view(spark, sf, "v_class_pred").select("doc_id", F.explode(one_hot).alias("label", "score"))


@register("label_encode", nested("with l as (select actual, row_number() over (order by actual) - 1 as i from (select distinct actual from v_class_pred)) select v.doc_id, v.actual, l.i as label_index from v_class_pred v join l on l.actual = v.actual"))
def label_encode(spark, sf):
    """Alphabetical class index; the class list is small and is broadcast after its distinct."""
    rows = view(spark, sf, "v_class_pred").select("doc_id", "actual")
    index = rows.select("actual").distinct().withColumn("label_index", F.row_number().over(Window.orderBy("actual")).cast("long") - 1)
    return rows.join(index, "actual").select("doc_id", "actual", "label_index")


QUERIES, ORACLES = register.queries, register.oracles
