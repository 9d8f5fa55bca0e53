"""Inventories: the table of files that all operators work on, and adapters that make one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import category, ext

#: Fixed values of the documents adapter: extensions by size modulo 12.
EXTENSIONS = (".jpg", ".ts", ".py", ".tmp", ".bak", ".log", ".zzz", "", ".pdf", ".mp3", ".zip", ".txt")


def derived(rows: DataFrame) -> DataFrame:
    """``rows`` with ext and category from name (a category other than ``other`` stays)."""
    kind = category(F.col("name"))
    if "category" in rows.columns:
        kind = F.when(F.col("category") == "other", kind).otherwise(F.col("category"))
    return rows.withColumn("ext", ext(F.col("name"))).withColumn("category", kind)


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) as files: a rule gives names, times and inodes, so that all
    criteria find something and each something else."""
    size = F.octet_length("text").cast("long")
    i = F.col("doc_id")
    number = F.when(i % 4 == 0, i % 200).otherwise(F.col("size") % 97)
    plain = F.concat(F.lit("doc_"), number.cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("size") % 12 + 1).cast("int")))
    rows = docs.withColumn("size", size).withColumn("name", F.when(i % 5 == 0, F.upper(plain)).otherwise(plain))
    return derived(rows.select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit("/"), "name").alias("path"), "name", "size",
        i.cast("double").alias("created"), (i * 7919 % 86400).cast("double").alias("modified"), F.lit(1).cast("long").alias("dev"),
        F.when(i % 101 == 0, 0).when(i % 50 == 49, i).otherwise(i + 1).cast("long").alias("ino"), i.alias("walk_ord"), F.encode("text", "UTF-8").alias("content"),
    ))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as files."""
    name = F.regexp_extract("url", r"([^/]*)/?$", 1)
    return derived(pages.select(
        F.col("url").alias("path"), name.alias("name"), F.octet_length("html").cast("long").alias("size"), F.col("page_id").cast("double").alias("created"), F.col("page_id").cast("double").alias("modified"),
        F.lit(1).cast("long").alias("dev"), F.lit(0).cast("long").alias("ino"), F.col("page_id").alias("walk_ord"), F.encode("html", "UTF-8").alias("content"),
    ))


def from_binary_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Files of any store Spark reads; no inodes there, so dev and ino are 0, and the walk order is by path hash."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    at = F.regexp_replace("path", "^file:(//)?", "")
    time = F.col("modificationTime").cast("double")
    return derived(files.select(
        at.alias("path"), F.regexp_extract(at, r"(?s)([^/]*)$", 1).alias("name"), F.col("length").alias("size"), time.alias("created"), time.alias("modified"),
        F.lit(0).cast("long").alias("dev"), F.lit(0).cast("long").alias("ino"), F.xxhash64("path").alias("walk_ord"), "content",
    ))


def grids_from_embeddings(vectors: DataFrame, hash_size: int = 7) -> DataFrame:
    """Vectors as grey grids of ``hash_size`` rows of ``hash_size + 1`` values."""
    i = F.col("vec_id")
    return vectors.select(i.alias("id"), F.format_string("vec_%d", i).alias("name"), (i * 7919 % 86400).cast("double").alias("modified"), i.alias("walk_ord"), F.slice("embedding", 1, hash_size * (hash_size + 1)).alias("grid"))


def union(*inventories: DataFrame) -> DataFrame:
    """Several roots, one after another in walk order; aliases are left to physical identity."""
    out = None
    for k, inv in enumerate(inventories):
        one = inv.withColumn("walk_ord", F.col("walk_ord") + F.lit(k << 48))
        out = one if out is None else out.unionByName(one)
    return out
