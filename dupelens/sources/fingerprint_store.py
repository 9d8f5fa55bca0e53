"""A table of fingerprints in buckets of paths, of which an update rewrites only those it touches.

A store is a folder with parquet files, each of one bucket, and a manifest that names the files of the present version.
An update reads the buckets of its paths, writes them anew beside the old ones, and then puts a new manifest in the place
of the old one, in one step: a writer that dies leaves the version before as it was, and readers have one or the other.
Rows are those of ``cache.FILE_CACHE``. Writers come one at a time; one that finds another's version in place raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import FILE_CACHE, cache_upsert
from ..session import qualified

MANIFEST = "manifest.json"
#: Buckets of a new store: a file each, so about a thousandth of the table is rewritten for one path.
BUCKETS = 1024


class Conflict(RuntimeError):
    """Another writer has put its version in place since this one was read."""


class FingerprintStore:
    """``FingerprintStore(spark, folder)``; the folder may be on any store that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder = spark, qualified(spark, folder).rstrip("/")
        jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.jvm, self.path = jvm, jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(self.conf)
        self.buckets = buckets

    def manifest(self) -> dict:
        """version, buckets (their number) and files (of each bucket that has any)."""
        at = self.path(f"{self.folder}/{MANIFEST}")
        if not self.fs.exists(at):
            return {"version": 0, "buckets": self.buckets, "files": {}}
        found = self.fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def _swap(self, manifest: dict, before: int) -> None:
        if self.manifest()["version"] != before:
            raise Conflict(self.folder)
        tmp = self.path(f"{self.folder}/.{MANIFEST}.{uuid.uuid4().hex}")
        out = self.fs.create(tmp)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.conf).rename(tmp, self.path(f"{self.folder}/{MANIFEST}"), options)

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        files = [f"{self.folder}/{f}" for b, fs in manifest["files"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(FILE_CACHE).parquet(*files) if files else self.spark.createDataFrame([], FILE_CACHE)

    def read(self) -> DataFrame:
        """The present version."""
        return self._read(self.manifest())

    @staticmethod
    def _bucket(path: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")

    def upsert(self, new: DataFrame) -> list[int]:
        """Put ``new`` in, by the rules of ``cache.cache_upsert``; the buckets that were rewritten.

        ``new`` is read twice. Old files stay until ``vacuum``, as readers may still be at them.
        """
        now = self.manifest()
        n = now["buckets"]
        touched = sorted(r[0] for r in new.select(self._bucket(F.col("path"), n)).distinct().collect())  # at most n numbers
        if not touched:
            return []
        rows = cache_upsert(self._read(now, touched), new).withColumn("bucket", self._bucket(F.col("path"), n))
        version = f"v{now['version'] + 1}-{uuid.uuid4().hex}"
        rows.repartition(min(n, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        files = now["files"] | {str(b): self._files(version, b) for b in touched}
        self._swap({"version": now["version"] + 1, "buckets": n, "files": files}, now["version"])
        return touched

    def _files(self, version: str, bucket: int) -> list[str]:
        at = f"{version}/bucket={bucket}"
        return [f"{at}/{s.getPath().getName()}" for s in self.fs.listStatus(self.path(f"{self.folder}/{at}")) if s.getPath().getName().endswith(".parquet")]

    def clear(self) -> None:
        """An empty version."""
        now = self.manifest()
        self._swap({"version": now["version"] + 1, "buckets": now["buckets"], "files": {}}, now["version"])

    def vacuum(self) -> int:
        """Delete version folders of which the present version uses no file, also those of writers that died; how many."""
        used = {f.split("/")[0] for fs in self.manifest()["files"].values() for f in fs}
        old = [s.getPath() for s in self.fs.listStatus(self.path(self.folder)) if s.isDirectory() and s.getPath().getName() not in used]
        for at in old:
            self.fs.delete(at, True)
        return len(old)
