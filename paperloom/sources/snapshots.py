"""Tables that change: versioned folders, of which a manifest that is written last makes one version.

A store is a folder. Its tables lie in hash buckets of their key; a change writes the buckets that it touches
to a new folder and then a manifest that names, for every table, the folder of each bucket. Readers take the
newest manifest, so a failure before it leaves the old version, and several tables move at once. A run that
is repeated finds its name among the manifests and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.register import Registry
from ..plans.views import view
from .scratch import new_path

register = Registry()
BUCKETS = 32


class Conflict(RuntimeError):
    """Another run made the version first; run again."""


class Store:
    """Tables under a folder that all executors share.

    keys: the key column of each table; its values are not null. A change rewrites whole buckets, so more of
    them make small changes cheaper; their number must stay the same for a store. Manifests are published by
    a rename that never replaces a file, which object stores without such a rename do not give.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def version(self) -> int:
        """The newest version, 0 for none; names of manifests alone are read."""
        folder = self._fs.Path(f"{self.root}/manifests")
        system = folder.getFileSystem(self._conf)
        return max((int(f.getPath().getName()[:12]) for f in system.listStatus(folder)), default=0) if system.exists(folder) else 0

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        draft, final = (self._fs.Path(f"{self.root}/{n}") for n in (f"drafts/{uuid.uuid4().hex}", f"manifests/{manifest['version']:012d}.json"))
        system = final.getFileSystem(self._conf)
        system.mkdirs(final.getParent())
        out = system.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, plain)
        except Exception as e:  # the gateway's error names the class of Hadoop's
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {manifest['version']} is there") from e
            raise

    def done(self, run: str) -> int | None:
        """The version that a run made, if it did."""
        if not self.version():
            return None
        made = self.spark.read.schema("version long, run string").json(f"{self.root}/manifests").filter(F.col("run") == run).first()
        return made and made["version"]

    def _rows(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["tables"][table]
        paths = [p for b, p in held["buckets"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is named."""
        return self._rows(self._manifest(version), name)

    def commit(self, run: str, changes: dict[str, tuple[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]] | DataFrame]) -> int:
        """One version from changes to tables; its number.

        A change is a whole new table, or (keyed, f): rows that carry the table's key, and f(old, keyed), the
        new rows of those buckets in which the keys lie. f must keep to its keys; it is not called if no
        key is given.
        """
        if (made := self.done(run)) is not None:
            return made
        before = self._manifest()
        after = {"version": before["version"] + 1, "run": run, "tables": dict(before["tables"])}
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, change in changes.items():
            key = self.keys[name]
            bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
            if isinstance(change, DataFrame):
                rows, kept = change, {}
            else:
                keyed, f = change
                touched = [r[0] for r in keyed.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
                if not touched:
                    continue
                held = before["tables"][name]["buckets"]
                rows, kept = f(self._rows(before, name, touched), keyed), {b: p for b, p in held.items() if int(b) not in touched}
            rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{data}/{name}")
            folder = self._fs.Path(f"{data}/{name}")
            names = [s.getPath().getName() for s in folder.getFileSystem(self._conf).listStatus(folder) if s.isDirectory()]
            new = {n.partition("=")[2]: f"{data}/{name}/{n}" for n in names if n.startswith("_bucket=")}
            after["tables"][name] = {"schema": json.loads(rows.schema.json()), "buckets": {**kept, **new}}
        self._publish(after)
        return after["version"]

    def upsert(self, run: str, name: str, new: DataFrame, at: str) -> int:
        """Rows of `new` replace those of their key; of several, the one with the largest `at` stays."""
        key = self.keys[name]

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), at).alias("r")).select("r.*")
            return old.join(new.select(key), key, "left_anti").unionByName(last.select(*old.columns))

        return self.commit(run, {name: (new, merged)})

    def delete(self, run: str, gone: DataFrame) -> int:
        """Rows of every table whose key is in the one column of `gone`, all in one version."""
        tables = self._manifest()["tables"]
        without = lambda key: lambda old, keyed: old.join(keyed, key, "left_anti")
        return self.commit(run, {n: (gone.toDF(self.keys[n]), without(self.keys[n])) for n in tables})


KEYS = {"docs": "doc_id", "class": "doc_id", "extract": "doc_id"}


def _store(spark, sf) -> Store:
    store = Store(spark, new_path(spark, "store"), KEYS)
    runs = view(spark, sf, "v_class").select("doc_id", "predicted_label", F.lit(0).alias("run"))
    store.commit("load", {"docs": view(spark, sf, "v_docs"), "class": runs, "extract": view(spark, sf, "v_extract")})
    return store


@register("upsert_result", "select doc_id, predicted_label, run from (select c.doc_id, predicted_label, 0 as run from v_class c where c.doc_id % 5 <> 0 union all select doc_id, 'resume', 2 from v_docs where doc_id % 5 = 0)")
def q_upsert(spark, sf):
    """Stored results, and two later runs over a fifth of the documents, the second one sent twice: the last run wins."""
    store = _store(spark, sf)
    fifth = view(spark, sf, "v_docs").filter("doc_id % 5 = 0").select("doc_id")
    for run, label in ((1, "email"), (2, "resume"), (2, "resume")):
        store.upsert(f"run-{run}", "class", fifth.select("doc_id", F.lit(label).alias("predicted_label"), F.lit(run).alias("run")), "run")
    return store.table("class")


@register("delete_document", "select 'docs' as tab, doc_id from v_docs where status <> 'error' union all select 'class', c.doc_id from v_class c where c.doc_id not in (select doc_id from v_docs where status = 'error') union all select 'extract', e.doc_id from v_extract e where e.doc_id not in (select doc_id from v_docs where status = 'error')")
def delete_document(spark, sf):
    """What stays of the three stored tables when the documents in error are deleted with their children."""
    store = _store(spark, sf)
    store.delete("errors", store.table("docs").filter("status = 'error'").select("doc_id"))
    return reduce(DataFrame.unionByName, [store.table(t).select(F.lit(t).alias("tab"), "doc_id") for t in KEYS])


QUERIES, ORACLES = register.queries, register.oracles
