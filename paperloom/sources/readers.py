"""Readers and writers: binary objects, labelled folders, annotation CSV, region JSON, caches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as V
from ..plans.register import Registry
from ..plans.views import view
from .scratch import new_path

register = Registry()
ANNOTATION = T.StructType([T.StructField(c, T.StringType() if c in ("filename", "class") else T.DoubleType()) for c in ("filename", "width", "height", "class", "xmin", "ymin", "xmax", "ymax")])
REGION = "struct<label:string,confidence:double,xyxy:array<double>,region_index:int,text:string,lines:array<string>,line_count:int>"


def scan_binary(spark: SparkSession, path: str) -> DataFrame:
    """Objects by path: (path, modificationTime, length, content); unread content is not loaded."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _image_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The listed files as (path), none of them opened, and the decoded images as (path, image).

    A file that is no image is a row without height, and a truncated one makes the reader give up the file.
    Files of no bytes are in neither, as Spark's file sources leave them out.
    """
    where = F.col("_metadata.file_path").alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(where)
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return files, images.filter("image.height > 0").select(where, F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))


def _folders() -> list:
    return [F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", k).alias(c) for k, c in ((1, "split"), (2, "category"))]


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(split, category, path, image) of every file under split/category, both taken from the path.

    `image` is the decoded image (height, width, nChannels, data), or null for a file that is no readable
    image: such files stay as rows. Only paths are shuffled to find them, never pixels; for that images
    are decoded once more.
    """
    files, images = _image_files(spark, path)
    bad = files.join(images.select("path").hint("merge"), "path", "left_anti")
    return images.unionByName(bad, allowMissingColumns=True).select(*_folders(), "path", "image")


def scan_labeled_dirs(spark: SparkSession, path: str) -> DataFrame:
    """(split, category, n, errors): readable and unreadable images of each folder."""
    files, images = _image_files(spark, path)
    rows = files.join(images.select("path", F.lit(True).alias("good")).hint("merge"), "path", "left").select(*_folders(), "good")
    return rows.groupBy("split", "category").agg(F.count("good").alias("n"), F.count_if(F.col("good").isNull()).alias("errors"))


def png(gray: np.ndarray) -> bytes:
    """A grey PNG of 8 bits."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = gray.shape
    lines = np.zeros((h, w + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def write_pages(pages: DataFrame, path: str) -> None:
    """A file for each row of (split, category, name, h, w, gray as bytes, damage) under path/split/category, by tasks.

    damage: null writes a PNG, "cut" half of it, anything else its own letters. A task that runs again
    writes the same bytes to the same names.
    """

    def write(batches):
        out, root = FileSystem.from_uri(path)
        made = set()
        for b in batches:
            for r in b.to_pylist():
                folder = f"{root}/{r['split']}/{r['category']}"
                if folder not in made:
                    out.create_dir(folder, recursive=True)
                    made.add(folder)
                body = png(np.frombuffer(r["gray"], np.uint8).reshape(r["h"], r["w"]))
                body = body if r["damage"] is None else body[: len(body) // 2] if r["damage"] == "cut" else r["damage"].encode()
                with out.open_output_stream(f"{folder}/{r['name']}") as f:
                    f.write(body)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, pa.schema([("n", pa.int64())]))

    pages.select("split", "category", "name", "h", "w", "gray", "damage").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def scan_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows by explicit schema; rows whose numbers do not parse, or without name, go."""
    header = spark.read.option("header", True).csv(path)
    clean = [c.lstrip("\ufeff") for c in header.columns]
    if missing := sorted(set(ANNOTATION.names) - set(clean)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    rows = header.toDF(*clean)
    typed = rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in ANNOTATION))
    return typed.dropna()


def scan_region_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, region_index, label, line_no, line) of region payloads."""
    rows = spark.read.schema(f"doc_id long, regions array<{REGION}>").json(path)
    regions = rows.select("doc_id", F.explode("regions").alias("r"))
    return regions.select("doc_id", "r.region_index", "r.label", F.posexplode("r.lines").alias("line_no", "line"))


def cached(df: DataFrame, name: str) -> DataFrame:
    """Computed once, then read: a feature cache as Parquet in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@register("scan_binary")
def q_scan_binary(spark, sf):
    return scan_binary(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


_BAD = "(doc_id % 7 in (3, 5))"
_PAGES = "(select doc_id, case when doc_id % 5 = 0 then 'val' else 'train' end as split, coalesce(lang, 'none') as category from documents where length(text) > 0)"


def _images(spark, sf) -> str:
    """The documents' pages as PNGs in labelled folders; two of seven are damaged."""
    path, rest = new_path(spark, "labelled"), F.col("doc_id") % 7
    rows = V.packed_pages(view(spark, sf, "documents"), "doc_id", "lang")
    write_pages(rows.select(F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"), F.coalesce("lang", F.lit("none")).alias("category"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), "h", "w", "gray", F.when(rest == 3, "cut").when(rest == 5, "not an image").alias("damage")), path)
    return path


@register("scan_labeled_dirs", f"select split, category, count(*) filter (not {_BAD}) as n, count(*) filter ({_BAD}) as errors from {_PAGES} group by 1, 2")
def q_labeled_dirs(spark, sf):
    return scan_labeled_dirs(spark, _images(spark, sf))


@register("scan_images", f"select d.split, d.category, d.doc_id, r.ink, m.top_margin, m.right_margin, e.edge_mean, e.edge_std from {_PAGES} d join ({V.ORACLES['raster_density']}) r on r.doc_id = d.doc_id join ({V.ORACLES['raster_margins']}) m on m.doc_id = d.doc_id join ({V.ORACLES['raster_edges']}) e on e.doc_id = d.doc_id where not {_BAD.replace('doc_id', 'd.doc_id')}")
def q_images(spark, sf):
    """Raster features of the images in labelled folders, read back from their files."""
    images = scan_images(spark, _images(spark, sf)).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    keys = ("split", "category", "doc_id")
    found = V.raster_features(V.image_pages(images, *keys), *keys)
    return found.select(*keys, *(F.round(c, 7).alias(c) for c in ("ink", "top_margin", "right_margin")), *(F.round(c, 6).alias(c) for c in ("edge_mean", "edge_std")))


@register("scan_annotations_csv", "select filename, class, xmin, ymax from v_annotations")
def q_annotations(spark, sf):
    path = new_path(spark, "annotations")
    view(spark, sf, "v_annotations").write.option("header", True).csv(path)
    return scan_annotations_csv(spark, path).select("filename", "class", "xmin", "ymax")


@register("scan_region_json", "select doc_id, region as region_index, 'paragraph' as label, row_number() over (partition by doc_id, region order by line_no) - 1 as line_no, text as line from v_invoice_lines")
def q_region_json(spark, sf):
    lines = view(spark, sf, "v_invoice_lines")
    regions = lines.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]).alias("lines"))
    payload = regions.groupBy("doc_id").agg(F.collect_list(F.struct(F.lit("paragraph").alias("label"), F.col("region").alias("region_index"), "lines")).alias("regions"))
    path = new_path(spark, "regions")
    payload.write.json(path)
    return scan_region_json(spark, path)


@register("feature_cache", "select doc_id, length(text) as n_chars from documents")
def feature_cache(spark, sf):
    return cached(view(spark, sf, "documents").select("doc_id", F.length("text").alias("n_chars")), "features")


QUERIES, ORACLES = register.queries, register.oracles
