"""Small stores: JSON tables that tolerate damage and are replaced whole, bin folders, priority folders."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expr import path_key
from ..functions.python_udfs import bin_record

#: Bytes of a bin record that are read: more than any path needs.
RECORD = 1 << 17


def _place(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a store; plain paths are local ones."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getRawFileSystem() if fs.getScheme() == "file" else fs, p  # no checksum beside a local file, which others may edit


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, on any file system, as a table; a missing or damaged file is an empty one."""
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(p.toString(), wholetext=True).filter(F.ltrim(F.col("value")).startswith("["))
    rows = whole.select(F.explode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})).alias("r"))
    return rows.filter("r IS NOT NULL").select("r.*")


def write_json(rows: DataFrame, path: str) -> None:
    """Replace the store by ``rows``, a bounded table (a journal, a history), on any file system: the new file appears whole."""
    spark = rows.sparkSession
    fs, p = _place(spark, path)
    jvm, tmp = spark.sparkContext._jvm, p.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp)
    try:
        out.write(bytearray(("[\n" + ",\n".join(rows.toJSON().toLocalIterator()) + "\n]\n").encode()))
    finally:
        out.close()
    replace = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    replace.rename(tmp, p, options)


class BinReader(DataSourceReader):
    """Files of bins: those of a root and of its folders one level below, whose names don't begin with ``$``."""

    def __init__(self, options: dict) -> None:
        self.roots = [r for r in json.loads(options["roots"]) if os.path.isdir(r)]

    def partitions(self) -> list[InputPartition]:
        below = lambda r: [e.path for e in os.scandir(r) if e.is_dir() and not e.name.startswith("$")]
        return [InputPartition(f) for r in self.roots for f in [r, *sorted(below(r))]]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        try:
            entries = sorted(os.scandir(partition.value), key=lambda e: e.name)
        except OSError:  # another user's folder
            return
        for e in entries:
            kind = e.name[:2].upper()
            if kind == "$I" and e.is_file():
                try:
                    with open(e.path, "rb") as f:
                        yield (e.path, f.read(RECORD), False)
                except OSError:
                    continue
            elif kind == "$R":
                yield (e.path, None, e.is_dir())


class BinFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recycle_bins"

    def schema(self) -> str:
        return "path string, content binary, is_directory boolean"

    def reader(self, schema) -> BinReader:
        return BinReader(dict(self.options))


def scan_bins(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Entries of the recycle bins at ``roots``, each read with the folders right below it; bins that aren't there are empty."""
    spark.dataSource.register(BinFolders)
    return bin_entries(spark.read.format("recycle_bins").option("roots", json.dumps(roots)).load())


def bin_entries(files: DataFrame) -> DataFrame:
    """Entries of recycle bins from their files (path, content, and optionally is_directory).

    ``$I`` records pair with the ``$R`` data beside them, whatever the case; records that can't be decoded are
    left out; an entry without data has data_exists false.
    """
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    rows = files.withColumn("_folder", path_key(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1))).withColumn("_kind", F.lower(F.substring(name, 1, 2))).withColumn("_tail", F.lower(F.substr(name, F.lit(3))))
    folder = F.col("is_directory") if "is_directory" in files.columns else F.lit(False)
    data = rows.filter("_kind = '$r'").select("_folder", "_tail", F.col("path").alias("data_path"), folder.alias("is_directory"))
    index = rows.filter("_kind = '$i'").select("_folder", "_tail", F.col("path").alias("index_path"), bin_record("content").alias("r")).filter("r.original_path IS NOT NULL")
    out = index.join(data, ["_folder", "_tail"], "left")
    return out.select("index_path", F.coalesce("data_path", F.lit("")).alias("data_path"), "r.original_path", "r.size", "r.deleted_ts", F.coalesce("is_directory", F.lit(False)).alias("is_directory"), F.col("data_path").isNotNull().alias("data_exists"))


def bin_roots(drives: list[str], names: tuple[str, ...] = ("$Recycle.Bin", "RECYCLER")) -> list[str]:
    """Bin folders of the drives."""
    return [f"{d.rstrip('/')}/{n}" for d in drives for n in names]
