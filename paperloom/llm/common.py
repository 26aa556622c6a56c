"""Shared helpers: input tables, and tables written out to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all runs in one process (tests) a temporary folder takes its place;
    on a cluster that would scatter the files over machines, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The tables of each scratch() around the code that runs; threads have their own.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def written(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what is above) and gives
    Spark true sizes for later joins. The files go at the end of the scratch() around the call, or of the
    one around that if they are kept, or else when the Spark application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    jpath, fs = _file(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    scopes = _open.get()[:-1] if keep else _open.get()
    if scopes:
        scopes[-1].append(out)
    return out


def _file(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for t in tables:
        jpath, fs = _file(t.sparkSession, t._written_to)
        fs.delete(jpath, True)


@contextmanager
def scratch():
    """Tables written inside go at its end, but for those that are kept: what is returned must read only these."""
    own: list[DataFrame] = []
    before = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(before)
        discard(*own)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that no operator uses, and the new name of each column: a caller's columns can't clash with an operator's."""
    names = {c: f"own{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


PART_ROWS, PART_BYTES = 2_000, 8 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def over_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for tables of texts, in batches of at most BATCH_ROWS rows.

    A batch exists in the JVM and in the worker at once, for each task, so the default of 10,000 rows
    costs hundreds of MB an executor. The setting is the session's and is only ever lowered.
    """
    rows = int(df.sparkSession.conf.get(BATCH_CONF))
    if not 0 < rows <= BATCH_ROWS:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, rows: int = PART_ROWS, size: int = PART_BYTES):
    """Parts of a batch with at most `rows` rows and, but for a longer single one, `size` bytes of text or items of a list."""
    length = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))
        n = max(1, min(rows, upto - k))
        yield batch.slice(k, n)
        k += n


def ascii_lower(col):
    """Lower-case A-Z only. Pure ASCII text takes the fast path of lower()."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))
