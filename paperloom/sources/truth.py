"""Truth labels: JSON arrays of {file, ground_truth} records, in two files or in one that is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boxes import kth_hash, seeded_hash
from ..plans.register import Registry
from ..plans.views import view
from .scratch import new_path

register = Registry()
#: Names of the label files, the share that trains, and how many records of each side are looked at.
TRAIN, VAL, ALL = "labels_train.json", "labels_val.json", "labels.json"
SHARE, PREVIEW = 0.8, 30


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, ground_truth, malformed) of a JSON array, or of a folder of them, a task for each file.

    A file that is no JSON is one row with its text in malformed; nested JSON comes as its text.
    """
    reader = spark.read.schema("file string, ground_truth string, malformed string").option("columnNameOfCorruptRecord", "malformed")
    return reader.option("multiLine", True).option("recursiveFileLookup", True).json(path)


def scan_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) labels of a folder.

    The two files of a made split come first. If one of them lacks, the one file of all labels is split by
    a seeded hash of the file's name: int(0.8 n) records train. The first read also refuses malformed files.
    """
    folder = folder.rstrip("/")
    paths = [f"{folder}/{n}" for n in (TRAIN, VAL, ALL)]
    if _exists(spark, paths[0]) and _exists(spark, paths[1]):
        return tuple(whole(read_labels(spark, p)) for p in paths[:2])
    if not _exists(spark, paths[2]):
        raise FileNotFoundError(f"no label files in {folder}")
    rows = whole(read_labels(spark, paths[2]))
    n = rows.count()
    hashed, k = seeded_hash("file"), int(SHARE * n)
    cut = kth_hash(rows.select(hashed.alias("h")), k) if k else ""
    return rows.filter(hashed <= cut), rows.filter(hashed > cut)


def whole(labels: DataFrame) -> DataFrame:
    """(file, ground_truth), failing the job at a file that is no JSON, rather than training on what is left."""
    broken = F.raise_error(F.concat(F.lit("malformed labels: "), F.substring("malformed", 1, 80)))
    return labels.select("file", F.when(F.col("malformed").isNull(), F.col("ground_truth")).otherwise(broken.cast("string")).alias("ground_truth"))


def truth_map(col: str = "ground_truth") -> Column:
    """JSON text as a map; malformed text gives null."""
    return F.when(F.trim(col).startswith("{"), F.from_json(col, "map<string,string>"))


def is_blank(col: str = "ground_truth") -> Column:
    """Whether a record says nothing: an object with blank strings only, or JSON that is no object, or no text at all.

    Malformed JSON says something, as do nulls and numbers within an object.
    """
    made = F.try_parse_json(F.coalesce(F.col(col), F.lit("{}")))
    values = F.map_values(F.from_json(F.coalesce(F.col(col), F.lit("{}")), "map<string,string>"))
    blank = F.forall(values, lambda v: F.coalesce(v.rlike(r"(?U)^\s*$"), F.lit(False)))
    return F.when(made.isNull(), False).when(~F.schema_of_variant(made).startswith("OBJECT"), True).otherwise(F.coalesce(blank, F.lit(False)))


def guardrail(train: DataFrame, val: DataFrame, most: int = PREVIEW) -> None:
    """Raises where the first records of both sides, at most 30 of each, are all blank."""
    looked = train.limit(most).select("ground_truth").unionByName(val.limit(most).select("ground_truth"))
    r = looked.agg(F.bool_and(is_blank()).alias("blank")).first()  # null without a record
    if r["blank"]:
        raise ValueError("the labels are empty: make them again from texts")


def write_labels(labels: DataFrame, path: str, per_file: int = 1000) -> None:
    """(id, file, ground_truth) as JSON arrays of about per_file records each in a folder; ids are longs."""
    part = F.floor(F.col("id") / per_file)
    made = labels.groupBy(part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("file", "ground_truth")))).alias("value"))
    # partitionBy makes a file of each row
    made.write.partitionBy("part").text(path)


_TRUTH = "select doc_id, case when doc_id % 10 = 0 then 'not json' when doc_id % 10 = 1 then '{\"total\": \"\"}' else concat('{\"total\": \"', cast(doc_id as string), '\", \"date\": \"\"}') end as ground_truth from v_docs"
_FILE = "cast(doc_id as string) || '.png'"
_TOTAL = "case when doc_id % 10 > 1 then cast(doc_id as varchar) when doc_id % 10 = 1 then '' end as total"


@register(
    "scan_truth_json",
    f"select 'two' as layout, case when doc_id % 5 = 0 then 'val' else 'train' end as split, {_FILE} as file, {_TOTAL} from ({_TRUTH}) union all select 'one', case when row_number() over (order by md5('42:' || {_FILE})) <= cast(floor(0.8 * count(*) over ()) as bigint) then 'train' else 'val' end, {_FILE}, {_TOTAL} from ({_TRUTH})",
)
def scan_truth_json(spark, sf):
    """Labels written in both layouts and read back, past the guardrail."""
    text = F.when(F.col("doc_id") % 10 == 0, "not json").when(F.col("doc_id") % 10 == 1, '{"total": ""}').otherwise(F.concat(F.lit('{"total": "'), F.col("doc_id").cast("string"), F.lit('", "date": ""}')))
    labels = view(spark, sf, "v_docs").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file"), text.alias("ground_truth"))
    two, one = new_path(spark, "truth"), new_path(spark, "truth")
    write_labels(labels.filter("id % 5 <> 0"), f"{two}/{TRAIN}")
    write_labels(labels.filter("id % 5 = 0"), f"{two}/{VAL}")
    write_labels(labels, f"{one}/{ALL}")
    out = []
    for layout, folder in (("two", two), ("one", one)):
        sides = scan_truth(spark, folder)
        guardrail(*sides)
        out += [s.select(F.lit(layout).alias("layout"), F.lit(split).alias("split"), "file", F.try_element_at(truth_map(), F.lit("total")).alias("total")) for s, split in zip(sides, ("train", "val"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


QUERIES, ORACLES = register.queries, register.oracles
