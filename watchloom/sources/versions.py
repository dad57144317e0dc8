"""A versioned table: immutable files, and a manifest for each version that names them.

A commit writes new files first and then its manifest, by a rename that fails if the version is there already. Readers open a version by its
manifest, so they see all of a commit or nothing of it, and go on reading their version while later ones are made; a write that breaks off leaves
files that no manifest names. Two writers that start from one version can't both commit: the second gets ``Conflict`` and may try again.

Rows are dealt to buckets by a hash of the key. Deleting, expiring and merging rewrite only buckets they touch; all other files are named again.
The bucket of a key is fixed by the table, which its first manifest records. The file system must rename in one step and not over a file that is there
(HDFS, ABFS; on a POSIX mount the check before the rename leaves a short gap); object stores without such a rename need one writer at a time.
A manifest names folders, at most one a bucket and commit that is still in use, so it stays small against the data; many small appends are
joined by the next change of their buckets.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made this version; read the table anew and repeat the change."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        latest = self.latest()
        if latest:
            kept = self.manifest(latest)
            self.key, self.buckets = kept["key"], kept["buckets"]
        else:
            self.buckets = buckets

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path("versions", f"{version:012d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, parent: int, schema: StructType, files: dict[str, list[str]], what: str) -> int:
        """``files``: the folders of each bucket. The rename is what makes the version."""
        version = parent + 1
        target = self._path("versions", f"{version:012d}.json")
        aside = self._path("versions", f"_{uuid.uuid4().hex}.json")
        body = {"version": version, "parent": parent, "key": self.key, "buckets": self.buckets, "at": time.time(), "what": what, "schema": schema.jsonValue(), "files": files}
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    # Files

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New files of ``rows`` by bucket; nobody sees them before a commit names them."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(self.key, F.lit(7)), F.lit(8))).sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(name))]
        return {n.split("=")[1]: [f"{name}/{n}"] for n in found if n.startswith("bucket=")}

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for b, own in manifest["files"].items() if buckets is None or int(b) in buckets for p in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Reading

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version, the last one by default; with ``keys`` only their buckets are opened."""
        at = self.latest() if version is None else version
        if not at:
            raise ValueError(f"{self.path} has no version")
        manifest = self.manifest(at)
        if keys is None:
            return self._read(manifest)
        wanted = self.spark.createDataFrame([(str(k),) for k in keys], "k string")
        found = [r.b for r in wanted.select(self.bucket("k").alias("b")).distinct().collect()]  # at most ``buckets``
        return self._read(manifest, found).filter(F.col(self.key).isin(keys))

    # Changes

    def append(self, rows: DataFrame) -> int:
        parent = self.latest()
        files = dict(self.manifest(parent)["files"]) if parent else {}
        for b, own in self._write(rows).items():
            files[b] = files.get(b, []) + own
        return self._commit(parent, rows.schema, files, "append")

    def _replace(self, manifest: dict, touched: list[int], kept: DataFrame, what: str) -> int:
        """Buckets in ``touched`` hold ``kept`` from the next version on."""
        files = {b: own for b, own in manifest["files"].items() if int(b) not in touched}
        return self._commit(manifest["version"], StructType.fromJson(manifest["schema"]), files | self._write(kept), what)

    def _touched(self, keyed: DataFrame) -> list[int]:
        return [r.b for r in keyed.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``

    def delete(self, keys: DataFrame) -> int:
        """Take all rows of some keys out."""
        manifest = self.manifest(self.latest())
        gone = keys.select(self.key).distinct()
        touched = self._touched(gone)
        if not touched:
            return manifest["version"]
        return self._replace(manifest, touched, self._read(manifest, touched).join(gone, self.key, "left_anti"), "delete")

    def expire(self, now, max_age_hours: int = 24, created: str = "created_at") -> int:
        """Take rows older than ``max_age_hours`` out; those without a time stay."""
        manifest = self.manifest(self.latest())
        old = F.col(created) < F.lit(now) - F.expr(f"interval {max_age_hours} hours")
        touched = self._touched(self._read(manifest).filter(old))
        if not touched:
            return manifest["version"]
        return self._replace(manifest, touched, self._read(manifest, touched).filter(F.col(created).isNull() | ~old), "expire")

    def merge(self, new: DataFrame, count: str | None = None) -> int:
        """Insert or replace by key, one row a key in ``new``; ``count`` names a column that goes up by one each time a key is written."""
        manifest = self.manifest(self.latest())
        touched = self._touched(new)
        if not touched:
            return manifest["version"]
        old = self._read(manifest, touched)
        own = [c for c in old.columns if c not in (self.key, count)]
        before = old.select(self.key, F.struct(*old.columns).alias("_old"))
        after = new.select(self.key, F.struct(*own).alias("_new"))
        value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c)
        times = [(F.coalesce(F.col("_old")[count], F.lit(0)) + F.col("_new").isNotNull().cast("long")).alias(count)] if count else []
        both = before.join(after, self.key, "full_outer").select(self.key, *[value(c) for c in own], *times).select(*old.columns)
        return self._replace(manifest, touched, both, "merge")

    def vacuum(self, keep: int = 1) -> list[int]:
        """Forget all but the last ``keep`` versions, and delete files that none of those names and that no commit is being written with.

        Run it while nobody writes: files of an unfinished commit are named by no version yet.
        """
        versions = self.versions()
        gone, left = versions[:-keep], versions[-keep:]
        named = {p for v in left for own in self.manifest(v)["files"].values() for p in own}
        for v in gone:
            self._fs.delete(self._path("versions", f"{v:012d}.json"), False)
        for commit in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = f"data/{commit.getPath().getName()}"
            parts = [f"{name}/{p.getPath().getName()}" for p in self._fs.listStatus(commit.getPath())]
            unused = [p for p in parts if p not in named]
            if len(unused) == len(parts):
                self._fs.delete(commit.getPath(), True)
            else:
                for p in unused:
                    self._fs.delete(self._path(p), True)
        return gone
