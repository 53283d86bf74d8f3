"""A table of results that grows by runs: upserts by key, versions, readers that never see half a run, compaction.

Rows lie in buckets of their key's hash. A version is a manifest, a small JSON file that names for every bucket the folder
that holds it; it is created in one step and never overwritten, so of two writers one wins and the other merges again. An
upsert reads and writes only the buckets that its rows touch. A run that dies leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
TRIES = 5


class Conflict(RuntimeError):
    """Other writers were faster, again and again."""


class RunStore:
    """The store below ``path``, on any file system that Spark reads; ``keys`` identify a row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    # -- manifests

    def versions(self) -> list[int]:
        found = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifests")))
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first run."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}; known: {known}")
        if not known:
            return {"version": 0, "schema": None, "buckets": {}}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version or known[-1]:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Creates the manifest; False where another writer has created it before."""
        target = self._path(f"{self.path}/manifests/{manifest['version']:08d}.json")
        try:
            stream = self._fs.create(target, False)
        except Exception:  # noqa: BLE001  the file system says in its own way that the file is there
            if self._fs.exists(target):
                return False
            raise
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    # -- rows

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, the newest unless one is named; None while there are none. Only named buckets are read, if given."""
        return self._rows(self._manifest(version), buckets)

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if m["schema"] is None:
            return None
        wanted = sorted(m["buckets"].items()) if buckets is None else [(str(b), m["buckets"][str(b)]) for b in buckets if str(b) in m["buckets"]]
        schema = T.StructType.fromJson(m["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{folder}/__bucket={b}" for b, folder in wanted])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in, in place of those with their keys; returns the new version. Of rows with one key in ``rows`` the greatest stays.

        The rows are written first, so what computes them runs once however often the merge is tried.
        """
        own = f"staged-{uuid.uuid4().hex}"
        columns = rows.columns
        rest = [c for c in columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*self.keys, "__r.*").select(*columns) if rest else rows.distinct()
        self._bucketed(one).write.parquet(f"{self.path}/data/{own}")
        staged = self.spark.read.parquet(f"{self.path}/data/{own}")
        touched = sorted(r[0] for r in staged.select("__bucket").distinct().collect())  # at most ``buckets``
        for _ in range(TRIES):
            m = self._manifest()
            folder = uuid.uuid4().hex
            merged = staged
            old = self._rows(m, touched)
            if old is not None:
                if [f.name for f in old.schema] != columns:
                    raise ValueError(f"the store's columns are {old.columns}")
                keep = self._bucketed(old).join(staged.select(*self.keys).withColumnsRenamed({k: f"__{k}" for k in self.keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")
                merged = keep.unionByName(staged)
            if touched:
                merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
            schema = json.loads(T.StructType([f for f in staged.schema if f.name != "__bucket"]).json())
            new = {"version": m["version"] + 1, "schema": schema, "buckets": {**m["buckets"], **{str(b): folder for b in touched}}}
            if self._commit(new):
                self._fs.delete(self._path(f"{self.path}/data/{own}"), True)
                return new["version"]
        raise Conflict(f"{TRIES} merges were overtaken")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose keys the store lacks."""
        have = self.read()
        if have is None:
            return wanted
        have = have.select(*self.keys).withColumnsRenamed({k: f"__{k}" for k in self.keys})
        return wanted.join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")

    def run(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], steps: int = 1) -> int:
        """Computes what is missing and puts it in, in ``steps`` slices by key, each a version: a run that dies goes on after its
        last slice, a second one computes nothing. Returns the number of slices that had rows."""
        done = 0
        for k in range(steps):
            part = wanted.where(F.pmod(F.xxhash64(*self.keys, F.lit(3)), F.lit(steps)) == k)
            todo = self.missing(part)
            if not todo.isEmpty():
                self.upsert(compute(todo))
                done += 1
        return done

    def compact(self, keep: int = 2) -> int:
        """Writes all buckets into one folder as a new version and drops manifests and folders that the last ``keep`` versions don't need."""
        m = self._manifest()
        rows = self._rows(m)
        if rows is None:
            return 0
        folder = uuid.uuid4().hex
        self._bucketed(rows).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        new = {**m, "version": m["version"] + 1, "buckets": dict.fromkeys(m["buckets"], folder)}
        if not self._commit(new):
            raise Conflict("a run went on meanwhile")
        kept = self.versions()[-keep:]
        needed = {f for v in kept for f in self._manifest(v)["buckets"].values()}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:08d}.json"), False)
        for f in self._fs.listStatus(self._path(f"{self.path}/data")):
            if f.getPath().getName() not in needed:
                self._fs.delete(f.getPath(), True)
        return new["version"]
