"""Detection boxes, annotations and leakage-free training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.register import Registry
from ..plans.views import view
from ..sources.scratch import new_path, stored

register = Registry()
IOU, CONTAINED = 0.6, 0.85
CAPS = {"paragraph": 12, "table": 3}
#: Suffixes that augmentation adds to a document's image.
AUGMENTED = ("_affine_translation", "_brightness", "_gaussianblur", "_horizontallyflip")


def overlap(a: str = "a", b: str = "b") -> tuple[Column, Column, Column]:
    """Intersection and the two areas of boxes in columns a.x1.. and b.x1.."""
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda t: F.greatest(F.lit(0.0), c(t, "x2") - c(t, "x1")) * F.greatest(F.lit(0.0), c(t, "y2") - c(t, "y1"))
    return w * h, area(a), area(b)


def box_iou(a: str = "a", b: str = "b") -> Column:
    i, s, t = overlap(a, b)
    return F.when((i > 0) & (s + t - i > 0), i / (s + t - i)).otherwise(0.0)


def containment_ratio(a: str = "a", b: str = "b") -> Column:
    i, s, t = overlap(a, b)
    return F.when((i > 0) & (F.least(s, t) > 0), i / F.least(s, t)).otherwise(0.0)


def box_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one image and label; an equi-join, so images are dealt out by hash."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.det_no") < F.col("b.det_no"))
    return a.join(b.hint("merge"), on)


def dedup_detections(boxes: DataFrame) -> DataFrame:
    """Greedy by confidence: a box goes if it overlaps a kept one of its label, caps tested first.

    Each choice depends on those before it, so an image's boxes are folded in one array; what is
    kept has at most 15 boxes, and images are dealt out by hash. Ties in confidence go by det_no.
    Kept boxes get a 1-based index in reading order.
    """
    fields = "q:double,det_no:bigint,label:string,x1:double,y1:double,x2:double,y2:double"
    near = "greatest(0D, least(e.x2, d.x2) - greatest(e.x1, d.x1)) * greatest(0D, least(e.y2, d.y2) - greatest(e.y1, d.y1))"
    size = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    s, t = size.format("e"), size.format("d")
    meets = f"{near} > 0 and ({near} >= {IOU} * ({s} + {t} - {near}) or {near} >= {CONTAINED} * least({s}, {t}))"
    cap = f"if(d.label = 'table', {CAPS['table']}, {CAPS['paragraph']})"
    fold = f"aggregate(b, cast(array() as array<struct<{fields}>>), (k, d) -> if(size(filter(k, e -> e.label = d.label)) < {cap} and not exists(k, e -> e.label = d.label and {meets}), concat(k, array(d)), k))"
    row = F.struct((-F.col("confidence")).cast("double").alias("q"), F.col("det_no").cast("long").alias("det_no"), "label", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    kept = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("b")).withColumn("k", F.expr(fold))
    ordered = F.array_sort(F.transform("k", lambda r: F.struct(*(r[c].alias(c) for c in ("y1", "x1", "det_no", "label", "x2", "y2")))))
    return kept.select("image_id", F.posexplode(ordered).alias("at", "r")).select("image_id", "r.det_no", "r.label", (F.col("at") + 1).alias("region_index"), "r.x1", "r.y1", "r.x2", "r.y2")


def padded(x1: str, y1: str, x2: str, y2: str, width, height, ratio: float = 0.02, least: int = 12) -> list[Column]:
    """The box grown on all sides, clipped to the image; rounding is half-even."""
    pad = lambda a, b: F.greatest(F.lit(least), F.bround(F.greatest(F.lit(1), F.col(b) - F.col(a)) * ratio).cast("int"))
    px, py = pad(x1, x2), pad(y1, y2)
    return [F.greatest(F.lit(0), F.col(x1) - px), F.greatest(F.lit(0), F.col(y1) - py), F.least(width, F.col(x2) + px), F.least(height, F.col(y2) + py)]


_I = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_S, _T = ("({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)".format(t) for t in "ab")
_PAIRS = "v_detections a join v_detections b on a.image_id = b.image_id and a.label = b.label and a.det_no < b.det_no"
_IOU = f"case when {_I} > 0 then {_I} / ({_S} + {_T} - {_I}) else 0.0 end"
_CON = f"case when {_I} > 0 then {_I} / least({_S}, {_T}) else 0.0 end"


@register("box_iou", f"select a.image_id, a.det_no as left_no, b.det_no as right_no, round({_IOU}, 9) as iou from {_PAIRS}")
def q_iou(spark, sf):
    return box_pairs(view(spark, sf, "v_detections")).select("a.image_id", F.col("a.det_no").alias("left_no"), F.col("b.det_no").alias("right_no"), F.round(box_iou(), 9).alias("iou"))


@register("containment_ratio", f"select a.image_id, a.det_no as left_no, b.det_no as right_no, round({_CON}, 9) as contained from {_PAIRS}")
def q_contained(spark, sf):
    return box_pairs(view(spark, sf, "v_detections")).select("a.image_id", F.col("a.det_no").alias("left_no"), F.col("b.det_no").alias("right_no"), F.round(containment_ratio(), 9).alias("contained"))


@register("join_boxes_overlap", f"select a.image_id, a.det_no as left_no, b.det_no as right_no from {_PAIRS} where {_IOU} >= {IOU} or {_CON} >= {CONTAINED}")
def join_boxes_overlap(spark, sf):
    return box_pairs(view(spark, sf, "v_detections")).filter((box_iou() >= IOU) | (containment_ratio() >= CONTAINED)).select("a.image_id", F.col("a.det_no").alias("left_no"), F.col("b.det_no").alias("right_no"))


_MEETS = f"e.label = d.label and {_I} > 0 and ({_I} >= {IOU}::double * ({_S} + {_T} - {_I}) or {_I} >= {CONTAINED}::double * least({_S}, {_T}))".replace("a.", "e.").replace("b.", "d.")
#: One step of the recursion for each box of an image, best first.
KEPT_SQL = f"""select image_id, e.det_no as det_no, e.label as label, row_number() over (partition by image_id order by e.y1, e.x1, e.det_no) as region_index, e.x1 as x1, e.y1 as y1, e.x2 as x2, e.y2 as y2 from (
 with recursive best as (select *, row_number() over (partition by image_id order by confidence desc, det_no) as k from v_detections),
 fold as (select image_id, 0 as k, count(*) as n, cast([] as struct(det_no bigint, label varchar, x1 double, y1 double, x2 double, y2 double)[]) as kept from v_detections group by image_id
  union all select f.image_id, f.k + 1, f.n, case when len(list_filter(f.kept, lambda e: e.label = d.label)) < (case when d.label = 'table' then {CAPS['table']} else {CAPS['paragraph']} end) and len(list_filter(f.kept, lambda e: {_MEETS})) = 0
   then list_append(f.kept, struct_pack(det_no := d.det_no, label := d.label, x1 := d.x1::double, y1 := d.y1::double, x2 := d.x2::double, y2 := d.y2::double)) else f.kept end from fold f join best d on d.image_id = f.image_id and d.k = f.k + 1)
 select image_id, unnest(kept) as e from fold where k = n)"""


@register("dedup_detections", f"select image_id, det_no, label, region_index from ({KEPT_SQL})")
def q_dedup(spark, sf):
    return dedup_detections(view(spark, sf, "v_detections")).select("image_id", "det_no", "label", "region_index")


@register("region_index", "select image_id, det_no, row_number() over (partition by image_id order by y1, x1, det_no) as region_index from v_detections")
def region_index(spark, sf):
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("y1", "x1", "det_no"))
    return view(spark, sf, "v_detections").select("image_id", "det_no", place.alias("region_index"))


@register("pad_box", "select image_id, det_no, greatest(0, x1 - px) as px1, greatest(0, y1 - py) as py1, least(1000, x2 + px) as px2, least(800, y2 + py) as py2 from (select *, greatest(12, cast(round_even(greatest(1, x2 - x1) * 0.02::double, 0) as int)) as px, greatest(12, cast(round_even(greatest(1, y2 - y1) * 0.02::double, 0) as int)) as py from v_detections)")
def pad_box(spark, sf):
    box = padded("x1", "y1", "x2", "y2", F.lit(1000), F.lit(800))
    return view(spark, sf, "v_detections").select("image_id", "det_no", *(c.cast("double").alias(n) for c, n in zip(box, ("px1", "py1", "px2", "py2"))))


@register("scan_detections", "select image_id, det_no, case l_id when 0 then 'paragraph' when 1 then 'table' else cast(l_id as varchar) end as label, round(confidence / 3, 4) as confidence, round(x1 / 3, 2) as x1 from (select *, image_id % 3 as l_id from v_detections)")
def scan_detections(spark, sf):
    """Class ids to labels by map, unknown ids as text; confidence to 4 places, coordinates to 2."""
    names = F.create_map(F.lit(0), F.lit("paragraph"), F.lit(1), F.lit("table"))
    rows = view(spark, sf, "v_detections").withColumn("class_id", (F.col("image_id") % 3).cast("int"))
    return rows.select("image_id", "det_no", F.coalesce(F.try_element_at(names, "class_id"), F.col("class_id").cast("string")).alias("label"), F.round(F.col("confidence") / 3, 4).alias("confidence"), F.round(F.col("x1") / 3, 2).alias("x1"))


@register("tokens_from_polygons", "select image_id, det_no, least(x1, x2 + 3, x2, x1 + 1) as xmin, least(y1 + 2, y1, y2, y2 + 1) as ymin, greatest(x1, x2 + 3, x2, x1 + 1) as xmax, greatest(y1 + 2, y1, y2, y2 + 1) as ymax from v_detections")
def tokens_from_polygons(spark, sf):
    """Bounding box of a four-point polygon."""
    point = lambda x, y: F.array(x, y)
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    rows = view(spark, sf, "v_detections").select("image_id", "det_no", F.array(point(x1, y1 + 2), point(x2 + 3, y1), point(x2, y2), point(x1 + 1, y2 + 1)).alias("poly"))
    side = lambda k: F.transform("poly", lambda p: p[k])
    return rows.select("image_id", "det_no", F.array_min(side(0)).alias("xmin"), F.array_min(side(1)).alias("ymin"), F.array_max(side(0)).alias("xmax"), F.array_max(side(1)).alias("ymax"))


def class_index(labels: DataFrame) -> DataFrame:
    """Sorted distinct class names with dense ids; the window runs over the class list."""
    names = labels.distinct()
    return names.withColumn("class_id", F.row_number().over(Window.orderBy("class")) - 1)


def yolo_row(class_id: Column) -> Column:
    """`id cx cy w h`, normalised, clamped to [0, 1], six places."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x = lambda c: clamp(c / F.col("width"))
    y = lambda c: clamp(c / F.col("height"))
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, x((F.col("xmin") + F.col("xmax")) / 2), y((F.col("ymin") + F.col("ymax")) / 2), x(F.col("xmax") - F.col("xmin")), y(F.col("ymax") - F.col("ymin")))


def document_key(name: Column) -> Column:
    """The document behind an image name: `.rf.` tail, type suffix and one augmentation go."""
    stem = F.regexp_replace(F.substring_index(name, ".rf.", 1), r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, "(_jpg|_png|_jpeg)$", "")
    return F.regexp_replace(stem, "(" + "|".join(AUGMENTED) + ")$", "")


_KEY = "regexp_replace(regexp_replace(regexp_replace(split_part(name, '.rf.', 1), '\\.[^.]*$', ''), '(_jpg|_png|_jpeg)$', ''), '(" + "|".join(AUGMENTED) + ")$', '')"
_CLASSES = "select class, row_number() over (order by class) - 1 as class_id from (select distinct class from v_annotations)"
_C = "least(1.0, greatest(0.0, {0}))"
_YOLO = "printf('%d %.6f %.6f %.6f %.6f', class_id, " + ", ".join(_C.format(e) + "::double" for e in ("(xmin + xmax) / 2 / width", "(ymin + ymax) / 2 / height", "(xmax - xmin) / width", "(ymax - ymin) / height")) + ")"


@register("class_index", _CLASSES)
def q_class_index(spark, sf):
    return class_index(view(spark, sf, "v_annotations").select("class"))


@register("to_yolo_row", f"select filename, {_YOLO} as row from v_annotations a join ({_CLASSES}) c on c.class = a.class")
def to_yolo_row(spark, sf):
    rows = view(spark, sf, "v_annotations")
    return rows.join(class_index(rows.select("class")), "class").select("filename", yolo_row(F.col("class_id")).alias("row"))


@register("sink_label_files", f"select filename, string_agg(row, chr(10) order by row) as content, case when filename < 'doc_5' then 'train' else 'val' end as split from (select filename, {_YOLO} as row from v_annotations a join ({_CLASSES}) c on c.class = a.class) group by filename")
def sink_label_files(spark, sf):
    """Label text of each image, written by split and read back."""
    rows = view(spark, sf, "v_annotations")
    rows = rows.join(class_index(rows.select("class")), "class").withColumn("row", yolo_row(F.col("class_id")))
    files = label_texts(rows, "filename").withColumn("split", F.when(F.col("filename") < "doc_5", "train").otherwise("val"))
    path = new_path(spark, "labels")
    write_label_files(files, path)
    return spark.read.schema(files.schema).json(path)


def label_texts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("content"))


def write_label_files(files: DataFrame, path: str) -> None:
    """A folder for each split, with a JSON record for each image: a file for each would swamp a store of millions."""
    files.write.partitionBy("split").json(path)


@register("sink_class_manifest", f"select '{{\"names\":[' || string_agg('\"' || class || '\"', ',' order by class_id) || '],\"nc\":' || count(*) || '}}' as manifest from ({_CLASSES})")
def sink_class_manifest(spark, sf):
    names = class_index(view(spark, sf, "v_annotations").select("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "class"))), lambda c: c["class"]).alias("names"))
    path = new_path(spark, "manifest")
    manifest(names).write.text(path)  # one row
    return spark.read.text(path).toDF("manifest")


def manifest(names: DataFrame) -> DataFrame:
    """The class list, in the order of ids, and its length as JSON."""
    return names.select(F.to_json(F.struct("names", F.size("names").alias("nc"))).alias("manifest"))


@register("document_key", f"select file_id, {_KEY} as document_key from v_files")
def q_document_key(spark, sf):
    return view(spark, sf, "v_files").select("file_id", document_key(F.col("name")).alias("document_key"))


@register("count_unique_docs", f"select count(distinct {_KEY}) as documents, count(*) as files from v_files")
def count_unique_docs(spark, sf):
    return view(spark, sf, "v_files").agg(F.count_distinct(document_key(F.col("name"))).alias("documents"), F.count(F.lit(1)).alias("files"))


def seeded_hash(key: str, seed: int = 42) -> Column:
    """32 digits that order keys at random, the same at every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


#: So few hashes are sorted in one place.
FEW = 65536


def kth_hash(hashes: DataFrame, k: int, few: int = FEW) -> str:
    """The k-th smallest (from 1) of a column h of 32 hexadecimal digits, by radix selection.

    Each pass counts, with map-side sums, the 4,096 next values of three digits among the hashes that share
    the digits found so far, and goes on in the one that holds the k-th; the last pass sorts what is left,
    at most `few`. So no task and no result grows with the table, and n rows take about log4096(n / few)
    passes. Equal hashes, however many, end in all their digits.
    """
    found = ""
    while len(found) < 32:
        here = hashes.filter(F.col("h").startswith(found)) if found else hashes
        next_ = F.substring("h", len(found) + 1, 3)
        counts = sorted((r["d"], r["count"]) for r in here.groupBy(next_.alias("d")).count().collect())  # 4,096 at most
        for digits, n in counts:
            if k <= n:
                break
            k -= n
        found += digits
        if n <= few:
            left = hashes.filter(F.col("h").startswith(found)).agg(F.sort_array(F.collect_list("h"))[k - 1].alias("h"))
            return left.first()["h"]
    return found


def split_random(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded split by rank of a hash: max(1, n * fraction) rows to val, never all.

    The threshold hash comes from radix selection, so no task ranks the table.
    """
    n = rows.count()
    k = min(max(1, int(n * fraction)), n - 1)
    if k < 1:
        return rows.withColumn("split", F.lit("train"))
    hashed = seeded_hash(key, seed)
    cut = kth_hash(rows.select(hashed.alias("h")), k)
    return rows.withColumn("split", F.when(hashed <= cut, "val").otherwise("train"))


def split_grouped(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of a key go to one side; max(1, round(n * fraction)) keys go to val."""
    keys = rows.select(key).distinct()
    return rows.join(split_random(keys, key, fraction, seed), key)


_RANDOM = "select *, case when row_number() over (order by md5('42:' || cast(file_id as varchar))) <= least(greatest(1, cast(floor((count(*) over ()) * 0.2) as bigint)), count(*) over () - 1) then 'val' else 'train' end as split from v_files"


@register("split_random", f"select file_id, split from ({_RANDOM})")
def q_split_random(spark, sf):
    return split_random(view(spark, sf, "v_files"), "file_id").select("file_id", "split")


@register("split_grouped", f"select f.file_id, f.document_key, k.split from (select file_id, {_KEY} as document_key from v_files) f join (select document_key, case when row_number() over (order by md5('42:' || document_key)) <= greatest(1, cast(floor((count(*) over ()) * 0.2) as bigint)) then 'val' else 'train' end as split from (select distinct {_KEY} as document_key from v_files)) k on k.document_key = f.document_key")
def q_split_grouped(spark, sf):
    rows = view(spark, sf, "v_files").withColumn("document_key", document_key(F.col("name")))
    return split_grouped(rows, "document_key").select("file_id", "document_key", "split")


@register("split_counts", f"select split, count(*) as files from ({_RANDOM}) group by split")
def split_counts(spark, sf):
    return split_random(view(spark, sf, "v_files"), "file_id").groupBy("split").agg(F.count(F.lit(1)).alias("files"))


@register("split_coverage", "select s.split, l.label, coalesce(cast(n as varchar), 'MISSING') as files from (select unnest(['train', 'validation']) as split) s cross join (select unnest(['email', 'invoice', 'resume', 'scientific_publication', 'other']) as label) l left join (select case when doc_id % 10 < 8 then 'train' else 'validation' end as split, predicted_label as label, count(*) as n from v_class group by 1, 2) c on c.split = s.split and c.label = l.label")
def split_coverage(spark, sf):
    """Counts for each expected split and category, or MISSING. The expected grid has ten rows."""
    found = view(spark, sf, "v_class").groupBy(F.when(F.col("doc_id") % 10 < 8, "train").otherwise("validation").alias("split"), F.col("predicted_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = found.sparkSession.range(1).select(F.explode(F.array(F.lit("train"), F.lit("validation"))).alias("split")).select("split", F.explode(F.array(*map(F.lit, ("email", "invoice", "resume", "scientific_publication", "other")))).alias("label"))
    return grid.join(found.hint("merge"), ["split", "label"], "left").select("split", "label", F.coalesce(F.col("n").cast("string"), F.lit("MISSING")).alias("files"))


@register("eval_holdout_slice", "select doc_id, predicted_label from (select c.doc_id, predicted_label, row_number() over (partition by predicted_label order by filename, c.doc_id) as k from v_class c join v_docs d on d.doc_id = c.doc_id) where k between 81 and 100")
def eval_holdout_slice(spark, sf):
    place = F.row_number().over(Window.partitionBy("predicted_label").orderBy("filename", "doc_id"))
    rows = view(spark, sf, "v_class").join(view(spark, sf, "v_docs"), "doc_id")
    return rows.withColumn("k", place).filter("k between 81 and 100").select("doc_id", "predicted_label")


@register("join_image_labels", f"select image_stem, rows from (select regexp_replace(filename, '\\.[^.]*$', '') as image_stem, count(*) as rows from v_annotations group by 1)")
def join_image_labels(spark, sf):
    """Images and labels by stem; `unlabelled` must be empty."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    labels = view(spark, sf, "v_annotations").groupBy(stem.alias("image_stem")).agg(F.count(F.lit(1)).alias("rows"))
    images = view(spark, sf, "v_annotations").select(stem.alias("image_stem")).distinct()
    return images.join(labels, "image_stem").select("image_stem", "rows")


_DISK = "select o_orderkey from orders where o_orderkey % 23 <> 0"


@register("anti_missing_files", f"select distinct filename from v_annotations where regexp_extract(filename, '[0-9]+') not in (select cast(o_orderkey as varchar) from ({_DISK})) order by filename limit 20")
def anti_missing_files(spark, sf):
    """Annotated files that are not stored; a report of the first 20."""
    there = view(spark, sf, "orders").filter("o_orderkey % 23 <> 0").select(F.col("o_orderkey").cast("string").alias("key"))
    named = view(spark, sf, "v_annotations").select("filename").distinct().withColumn("key", F.regexp_extract("filename", "[0-9]+", 0))
    return named.join(there, "key", "left_anti").select("filename").orderBy("filename").limit(20)


@register("skip_existing", f"select o_orderkey from orders where o_orderkey not in ({_DISK})")
def skip_existing(spark, sf):
    there = view(spark, sf, "orders").filter("o_orderkey % 23 <> 0").select("o_orderkey")
    return view(spark, sf, "orders").select("o_orderkey").join(there, "o_orderkey", "left_anti")


@register("list_remote_filter", "select file_id, path from (select file_id, concat(case file_id % 3 when 0 then 'train/' when 1 then 'validation/' else 'test/' end, case file_id % 4 when 0 then 'invoice/' when 1 then 'email/' else 'memo/' end, name) as path from v_files) where regexp_matches(path, '^(train|validation)/') and regexp_matches(path, '/(email|invoice|resume|scientific_publication)/')")
def list_remote_filter(spark, sf):
    path = F.concat(F.when(F.col("file_id") % 3 == 0, "train/").when(F.col("file_id") % 3 == 1, "validation/").otherwise("test/"), F.when(F.col("file_id") % 4 == 0, "invoice/").when(F.col("file_id") % 4 == 1, "email/").otherwise("memo/"), "name")
    rows = view(spark, sf, "v_files").select("file_id", path.alias("path"))
    return rows.filter(F.col("path").rlike("^(train|validation)/") & F.col("path").rlike("/(email|invoice|resume|scientific_publication)/"))


@register("dataset_usable", "select split, count(*) as files, count(*) filter (not regexp_matches(name, '[.](jpg|png|jpeg)$')) as odd, count(*) > 0 and count(*) filter (not regexp_matches(name, '[.](jpg|png|jpeg)$')) = 0 as usable from (select *, case when file_id % 5 = 0 then 'val' else 'train' end as split from v_files) group by split")
def dataset_usable(spark, sf):
    rows = view(spark, sf, "v_files").withColumn("split", F.when(F.col("file_id") % 5 == 0, "val").otherwise("train"))
    odd = F.count_if(~F.col("name").rlike("[.](jpg|png|jpeg)$"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("files"), odd.alias("odd")).withColumn("usable", (F.col("files") > 0) & (F.col("odd") == 0))


@register("join_split_annotations", "select a.filename, a.class, case when right(md5(a.filename), 1) < '4' then 'val' else 'train' end as split from v_annotations a")
def join_split_annotations(spark, sf):
    rows = view(spark, sf, "v_annotations")
    split = rows.select("filename").distinct().withColumn("split", F.when(F.right(F.md5("filename"), F.lit(1)) < "4", "val").otherwise("train"))
    return rows.join(split, "filename").select("filename", "class", "split")


#: The columns of an annotation.
REQUIRED = ("filename", "width", "height", "class", "xmin", "ymin", "xmax", "ymax")


def required_minus_present(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(missing, rows) over JSON lines in column `value`: required keys that records lack, and how many lack them."""
    lacking = F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    return rows.select(F.explode(lacking).alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("rows"))


@register("required_minus_present", "select missing, count(*) as rows from (select unnest(list_filter([case when filename like '%.jpg' then 'width' end, case when filename like '%.png' or filename like '%.jpg' then 'class' end], lambda m: m is not null)) as missing from v_annotations) group by missing")
def q_required(spark, sf):
    """Over annotation files in which records of some image kinds lack keys."""
    rows, jpg, png = view(spark, sf, "v_annotations"), F.col("filename").endswith(".jpg"), F.col("filename").endswith(".png")
    partial = rows.withColumn("width", F.when(~jpg, F.col("width"))).withColumn("class", F.when(~jpg & ~png, F.col("class")))
    path = new_path(spark, "annotations")
    partial.write.json(path)
    return required_minus_present(spark.read.text(path))


def prepare_dataset(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(part, name, split, content): label text of each image that is stored, a report of those that are not, and the manifest.

    Annotations get class ids, images a split; rows are written once, for three parts read them.
    """
    rows = split_grouped(rows.join(class_index(rows.select("class")), "class"), "filename").withColumn("row", yolo_row(F.col("class_id")))
    rows = stored(rows.select("filename", "split", "row", "class", "class_id"), "dataset")
    there = rows.join(files, "filename", "left_semi")
    labels = label_texts(there, "filename", "split").select(F.lit("label").alias("part"), F.col("filename").alias("name"), "split", "content")
    missing = rows.select("filename", "split").distinct().join(files, "filename", "left_anti").select(F.lit("missing"), "filename", "split", F.lit(""))
    names = rows.select("class_id", "class").distinct().agg(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "class"))), lambda c: c["class"]).alias("names"))
    return labels.union(missing).union(manifest(names).select(F.lit("manifest"), F.lit("classes"), F.lit(""), "manifest"))


_STORED = "cast(regexp_extract(filename, '[0-9]+') as bigint) % 23 <> 0"
_DATASET = f"""select a.filename, a.class, c.class_id, case when k.r <= k.v then 'val' else 'train' end as split, {_YOLO} as row from v_annotations a join ({_CLASSES}) c on c.class = a.class
 join (select filename, row_number() over (order by md5('42:' || filename)) as r, greatest(1, cast(floor((count(*) over ()) * 0.2) as bigint)) as v from (select distinct filename from v_annotations)) k on k.filename = a.filename"""


@register(
    "prepare_dataset",
    f"""select 'label' as part, filename as name, split, string_agg(row, chr(10) order by row) as content from ({_DATASET}) where {_STORED} group by filename, split
 union all select distinct 'missing', filename, split, '' from ({_DATASET}) where not {_STORED}
 union all select 'manifest', 'classes', '', '{{"names":[' || string_agg('"' || class || '"', ',' order by class_id) || '],"nc":' || count(*) || '}}' from ({_CLASSES})""",
)
def q_prepare_dataset(spark, sf):
    rows = view(spark, sf, "v_annotations")
    files = rows.select("filename").distinct().filter(F.regexp_extract("filename", "[0-9]+", 0).cast("long") % 23 != 0)
    return prepare_dataset(rows, files)


@register("job_dataset_labels", f"select case when right(md5(filename), 1) < '4' then 'val' else 'train' end as split, class_id, count(*) as rows from v_annotations a join ({_CLASSES}) c on c.class = a.class group by 1, 2")
def job_dataset_labels(spark, sf):
    rows = view(spark, sf, "v_annotations")
    rows = rows.join(class_index(rows.select("class")), "class")
    return rows.groupBy(F.when(F.right(F.md5("filename"), F.lit(1)) < "4", "val").otherwise("train").alias("split"), "class_id").agg(F.count(F.lit(1)).alias("rows"))


def box_quality(truth: DataFrame, boxes: DataFrame) -> DataFrame:
    """By label: true boxes, those that a kept detection of the image meets at IOU or more, rate, mean best IoU, and how many are contained.

    Detections are de-duplicated first, so a true box meets at most 15.
    """
    a, b = truth.alias("a"), dedup_detections(boxes).alias("b")
    both = a.join(b.hint("merge"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.label") == F.col("b.label")), "left")
    met = F.col("b.det_no").isNotNull()
    best = both.groupBy("a.image_id", "a.det_no", "a.label").agg(F.coalesce(F.max(F.when(met, box_iou())), F.lit(0.0)).alias("iou"), F.coalesce(F.max(F.when(met, containment_ratio())), F.lit(0.0)).alias("held"))
    found = F.count_if(F.col("iou") >= IOU)
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("truth"), found.alias("found"), F.round(found / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.count_if(F.col("held") >= CONTAINED).alias("contained"))


@register("job_box_quality", f"""select label, count(*) as truth, count(*) filter (iou >= {IOU}) as found, round(count(*) filter (iou >= {IOU}) / count(*), 6) as rate, round(avg(iou), 6) as mean_iou, count(*) filter (held >= {CONTAINED}) as contained from (
 select a.image_id, a.det_no, a.label, coalesce(max(case when b.det_no is not null then {_IOU} end), 0) as iou, coalesce(max(case when b.det_no is not null then {_CON} end), 0) as held
 from v_detections a left join ({KEPT_SQL}) b on a.image_id = b.image_id and a.label = b.label group by a.image_id, a.det_no, a.label) group by label""")
def job_box_quality(spark, sf):
    """All boxes are the truth, those that de-duplication keeps the detections."""
    boxes = view(spark, sf, "v_detections")
    return box_quality(boxes, boxes)


QUERIES, ORACLES = register.queries, register.oracles
