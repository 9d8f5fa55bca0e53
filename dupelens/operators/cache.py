"""Fingerprint tables between scans: look up, update, count. A table is a DataFrame; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import full_hash
from ..joins import few
from ..session import write_once

FILE_CACHE = "path string, size long, mtime double, full_hash string, turbo_hash string"
IMAGE_CACHE = "path string, size long, mtime double, dhash string, ahash string"
#: A lookup takes times that differ by less; an update compares exactly.
TOLERANCE = 0.001


def cache_lookup(inv: DataFrame, cache: DataFrame, kinds: tuple[str, ...] = ("full_hash", "turbo_hash")) -> DataFrame:
    """``inv`` with the cached fingerprints, null where path, size or time don't fit. No kind stands in for another."""
    known = cache.select(F.col("path").alias("_path"), F.col("size").alias("_size"), "mtime", *kinds)
    fits = (F.col("path") == F.col("_path")) & (F.col("size") == F.col("_size")) & (F.abs(F.col("modified") - F.col("mtime")) < TOLERANCE)
    return inv.join(known, fits, "left").drop("_path", "_size", "mtime")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after writing ``fresh`` (of its schema, a row a path).

    A new fingerprint wins; without one, the old stays if size and time are exactly the same, else it goes.
    """
    kinds = [c for c in cache.columns if c not in ("path", "size", "mtime")]
    new = fresh.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), *[F.col(k).alias(f"_{k}") for k in kinds])
    both = cache.join(new, F.col("path") == F.col("_path"), "full_outer")
    untouched = F.col("_path").isNull()
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return both.select(
        F.coalesce("_path", "path").alias("path"), F.when(untouched, F.col("size")).otherwise(F.col("_size")).alias("size"), F.when(untouched, F.col("mtime")).otherwise(F.col("_mtime")).alias("mtime"),
        *[F.when(untouched, F.col(k)).otherwise(F.coalesce(F.col(f"_{k}"), F.when(same, F.col(k)))).alias(k) for k in kinds],
    )


def image_cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table of picture hashes after writing ``fresh``: new rows replace old ones whole."""
    return cache.join(fresh.select("path"), "path", "left_anti").select(*cache.columns).unionByName(fresh.select(*cache.columns))


def cache_stats(files: DataFrame, pictures: DataFrame) -> DataFrame:
    """One row: rows of both tables."""
    n = F.count(F.lit(1))
    return files.agg(n.alias("files")).crossJoin(pictures.agg(n.alias("images")))  # one row each


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a stored table takes, over all its files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def cleared(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


#: Known fingerprints, or paths to hash, are broadcast up to this number (some 150 bytes each).
BROADCAST_KNOWN = 500_000


def incremental(inv: DataFrame, cache: DataFrame) -> DataFrame:
    """``inv`` with ``full`` instead of content and whether it is ``fresh``: hashed only where the cache has none, written once.

    While the known fingerprints are few, one scan does it: they are sent to the rows. Beyond, slim rows meet
    them first, and the paths left are sent to the scan of the contents; if these are too many as well, all
    contents are hashed where they are read. No content crosses a shuffle.
    """
    known = cache.filter(F.col("full_hash").isNotNull()).select("path", "size", "mtime", "full_hash")
    digest = full_hash(F.col("content"))
    if few(known, BROADCAST_KNOWN):
        found = cache_lookup(inv, F.broadcast(known), ("full_hash",))
        rows = found.withColumn("fresh", F.col("full_hash").isNull()).withColumn("full", F.coalesce("full_hash", digest))
        return write_once(rows.drop("content", "full_hash"), "fingerprints")
    slim = write_once(cache_lookup(inv.drop("content"), known, ("full_hash",)).withColumn("fresh", F.col("full_hash").isNull()), "looked-up")
    todo = slim.filter("fresh").select("path")
    of = inv.select("path", digest.alias("_full"))
    of = inv.join(F.broadcast(todo), "path", "left_semi").select("path", digest.alias("_full")) if few(todo, BROADCAST_KNOWN) else of
    return write_once(slim.join(of, "path", "left").withColumn("full", F.coalesce("full_hash", "_full")).drop("full_hash", "_full"), "fingerprints")


def incremental_hashes(inv: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, full_hash of every row, hashing contents only where the cache has none; the updated table)."""
    rows = incremental(inv, cache)
    new = rows.filter("fresh").select("path", "size", F.col("modified").alias("mtime"), F.col("full").alias("full_hash"), F.lit(None).cast("string").alias("turbo_hash"))
    return rows.select("path", F.col("full").alias("full_hash")), cache_upsert(cache, new)
