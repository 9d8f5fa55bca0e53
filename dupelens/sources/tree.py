"""Real directory trees, with inodes, walked by all executors.

A walk goes in rounds. Each lists the folders that are open, deals them anew by path, and lets every task go down
from its folders until it has seen ``BUDGET`` entries; what it leaves open is listed in the next round, so neither a deep
folder nor a wide one is one task's for long. A round is written once. Places in the walk are numbered by ranges
afterwards, from keys that sort as a walk does: a folder's files by name, then its folders by name.

A shared file system is needed, as for any tree. Links are not followed; never-entered folders are pruned at their
top; what can't be read is skipped, as are names that are no UTF-8. Bodies are read only where they are asked for:
``content`` is a column that is computed from the path, so a plan without it opens no file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cancel import Handle
from ..functions.python_udfs import link_candidates
from ..joins import numbered
from ..operators.dedup import Criteria, looked_at, size_candidates
from ..operators.filters import NEVER_ENTERED, dedup_physical
from ..session import write_once
from .inventory import derived

#: Entries that a task lists before it leaves the rest to the next round; it lists all of each folder that it opens.
BUDGET = 20_000
#: Bodies of more bytes aren't columns: ``content`` is null, and digests are made from the file (``fingerprints``).
LARGEST_BODY = (1 << 31) - (1 << 20)
#: kind is file, dir, closed (a pruned or unreadable folder, a link, or what holds something that can't be shown) or open (a folder for the next round).
ENTRY = "kind string, root int, key string, path string, name string, size long, created double, modified double, dev long, ino long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in ENTRY.split(", "))])
_BLANK = {"name": None, "size": None, "created": None, "modified": None, "dev": None, "ino": None}


def _closed(entry: os.DirEntry) -> bool:
    return entry.name.lower() in NEVER_ENTERED or entry.is_symlink() or entry.is_junction()


def _utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _listed(folder: str, root: int, key: str) -> Iterator[dict]:
    """Rows of one folder's entries, in walk order; a folder's key is its parent's, a mark that is greater than that of files, its name and an end."""
    try:
        with os.scandir(folder) as found:
            entries = list(found)
    except OSError:
        entries = None
    if entries is None or not all(_utf8(e.name) for e in entries):
        yield {"kind": "closed", "root": root, "key": key, "path": folder, **_BLANK}
    entries = sorted((e for e in entries or () if _utf8(e.name)), key=lambda e: e.name)
    for e in entries:
        row = {"root": root, "path": e.path}
        try:
            if e.is_dir(follow_symlinks=False) or e.is_junction():
                yield {"kind": "closed" if _closed(e) else "dir", "key": f"{key}\x01{e.name}\0", **row, **_BLANK}
            elif e.is_symlink():
                yield {"kind": "closed", "key": f"{key}\x01{e.name}\0", **row, **_BLANK}
            else:
                s = e.stat(follow_symlinks=False)
                yield {"kind": "file", "key": f"{key}\0{e.name}", **row, "name": e.name, "size": s.st_size, "created": s.st_ctime, "modified": s.st_mtime, "dev": s.st_dev, "ino": s.st_ino}
        except OSError:  # it holds its folder all the same
            yield {"kind": "closed", "key": f"{key}\x01{e.name}\0", **row, **_BLANK}


def _walked(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    seen, rows = 0, []
    for batch in batches:
        for start in batch.to_pylist():
            stack, first = [(start["path"], start["key"])], True
            while stack:
                folder, key = stack.pop()
                if seen >= budget and not first:
                    rows.append({"kind": "open", "root": start["root"], "key": key, "path": folder, **_BLANK})
                else:
                    below = []
                    for row in _listed(folder, start["root"], key):
                        rows.append(row)
                        seen += 1
                        if row["kind"] == "dir":
                            below.append((row["path"], row["key"]))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows = []
                    stack.extend(reversed(below))
                first = False
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def walk(spark: SparkSession, roots: Sequence[str], handle: Handle | None = None) -> DataFrame:
    """All entries below the roots (see ``ENTRY``), each round's written once; missing roots have none.

    Where ``handle`` is cancelled, the walk ends with the rounds that are written, and ``handle.partial`` is set. The
    folders that were still open count as closed, so that none that wasn't looked into is taken for empty.
    """
    there = [(k, "", os.path.abspath(r)) for k, r in enumerate(r for r in roots if os.path.isdir(r))]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    open_, out, budget = spark.createDataFrame(there, "root int, key string, path string"), None, BUDGET
    try:
        while not open_.isEmpty():
            if handle:
                handle.check()
            found = write_once(open_.repartition(tasks, "path", "root").mapInArrow(lambda batches: _walked(batches, budget), ENTRY), "walk")
            out = found if out is None else out.unionByName(found)
            open_ = found.filter("kind = 'open'").select("root", "key", "path")
    except Exception:
        if not (handle and handle.cancelled):
            raise
        handle.partial = True
        unseen = open_.select(F.lit("closed").alias("kind"), "root", "key", "path")
        out = unseen if out is None else out.unionByName(unseen, allowMissingColumns=True)
    none = spark.createDataFrame([], ENTRY)
    return none if out is None else none.unionByName(out, allowMissingColumns=True)


@F.pandas_udf(T.BinaryType())
def body(path: pd.Series) -> pd.Series:
    """The file's bytes; null where it can't be read, or is larger than a value may be."""

    def read(p: str) -> bytes | None:
        try:
            with open(p, "rb") as f:
                return f.read() if os.fstat(f.fileno()).st_size <= LARGEST_BODY else None
        except OSError:
            return None

    return path.map(read)


def scan_tree(spark: SparkSession, roots: Sequence[str], content: bool = True, handle: Handle | None = None) -> DataFrame:
    """The inventory of directory trees, roots in order; bodies are read where ``content`` is used, each time it is."""
    files = numbered(walk(spark, roots, handle).filter("kind = 'file'"), ["root", "key"], "walk_ord")
    rows = derived(files.select("path", "name", "size", "created", "modified", "dev", "ino", "walk_ord"))
    return rows.withColumn("content", body("path") if content else F.lit(None).cast("binary"))


def scan_dirs(spark: SparkSession, roots: Sequence[str], handle: Handle | None = None) -> DataFrame:
    """All folders and links below the roots: path, closed (pruned, link, or not to be read as a whole) and walk_ord."""
    rows = walk(spark, roots, handle).filter("kind IN ('dir', 'closed')")
    each = rows.groupBy("path").agg(F.bool_or(F.col("kind") == "closed").alias("closed"), F.min(F.struct("root", "key")).alias("at"))
    return numbered(each, ["at"], "walk_ord").drop("at")


@F.pandas_udf(T.BooleanType())
def is_there(path: pd.Series) -> pd.Series:
    return path.map(lambda p: p is not None and os.path.exists(p)).astype(bool)


def scan_shortcuts(spark: SparkSession, roots: Sequence[str], handle: Handle | None = None) -> DataFrame:
    """Shortcut files (path, name, size, modified) with ``target``: of what each may mean the first that exists, else the first; null if nothing.

    Folders that are never entered, links and junctions are pruned as in any walk. Only shortcut files are opened.
    """
    files = scan_tree(spark, roots, handle=handle).filter(F.lower("name").endswith(".lnk"))
    rows = files.select("path", "name", "size", "modified", "walk_ord", link_candidates("content").alias("may"))
    each = rows.select("path", F.posexplode("may").alias("at", "target"))
    found = each.filter(is_there("target")).groupBy("path").agg(F.min(F.struct("at", "target"))["target"].alias("found"))
    return rows.join(found, "path", "left").select("path", "name", "size", "modified", "walk_ord", F.coalesce("found", F.get("may", F.lit(0))).alias("target"))


def broken_shortcuts(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Shortcuts whose target isn't there though its drive is."""
    links = scan_shortcuts(spark, roots).filter(F.col("target").isNotNull() & (F.col("target") != ""))
    drive = F.regexp_extract("target", r"^([A-Za-z]:|[\\\\/]{2}[^\\\\/]+[\\\\/][^\\\\/]+)", 1)
    rows = links.filter(~is_there("target")).withColumn("drive", drive)
    return rows.filter((F.col("drive") == "") | is_there(F.concat("drive", F.lit(os.sep)))).drop("drive")


def _turbo(path: str, size: int, partial: int) -> str | None:
    """As ``expr.turbo_hash``, reading no more than the parts that count."""
    try:
        with open(path, "rb") as f:
            h = hashlib.md5(f.read(partial), usedforsecurity=False)
            if size > 2 * partial:
                f.seek(size - partial)
                h.update(f.read(partial))
    except OSError:
        return None
    h.update(str(size).encode())
    return h.hexdigest()


def _full(path: str) -> str | None:
    """As ``expr.full_hash``, a piece at a time."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


@F.pandas_udf(T.StringType())
def partial_digest(path: pd.Series, size: pd.Series, partial: pd.Series) -> pd.Series:
    return pd.Series([_turbo(*x) for x in zip(path, size, partial, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def whole_digest(path: pd.Series) -> pd.Series:
    return path.map(_full)


#: Bytes that the first round of a byte comparison reads of each file; each next round reads ``STEP`` times as many.
FIRST_RANGE, STEP = 1 << 16, 8


@F.pandas_udf(T.StringType())
def range_digest(path: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    """SHA-256 of bytes of the files from ``offset`` on, read a piece at a time; null where it can't be read."""

    def one(p: str, start: int, left: int) -> str | None:
        h = hashlib.sha256()
        try:
            with open(p, "rb") as f:
                f.seek(start)
                while left > 0 and (piece := f.read(min(left, 1 << 20))):
                    h.update(piece)
                    left -= len(piece)
        except OSError:
            return None
        return h.hexdigest()

    return pd.Series([one(*x) for x in zip(path, offset, length, strict=True)], dtype="object")


def refined(files: DataFrame, by: Sequence[str] = ("size",)) -> tuple[DataFrame, DataFrame]:
    """Files (path, size and ``by``) that equal another byte for byte: (path, full: equal for equal files of one ``by``), and (path, bytes_read) of all.

    Groups are split by one range of bytes after another, as wide again by ``STEP`` each round, and a file leaves as soon as
    nothing is left that it could equal: files that differ early are hardly read, and no file is read twice. A round is
    written once; its files are dealt anew by path.
    """
    state, offset, length = files.select("path", "size", *[c for c in by if c != "size"]).withColumn("chain", F.lit("")), 0, FIRST_RANGE
    out = counts = None
    while not state.isEmpty():
        part = range_digest("path", F.lit(offset).cast("long"), F.lit(length).cast("long"))
        read = state.repartition("path").withColumn("part", part).filter("part IS NOT NULL").withColumn("chain", F.sha2(F.concat("chain", "part"), 256)).drop("part")
        read = write_once(read, "ranges")
        often = read.groupBy(*by, "chain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        alike = read.join(often, [*by, "chain"], "left_semi")
        ended = F.col("size") <= offset + length
        done = alike.filter(ended).select("path", F.col("chain").alias("full"))
        bytes_ = read.select("path", F.least("size", F.lit(offset + length)).alias("bytes_read"))
        out, counts = (done, bytes_) if out is None else (out.unionByName(done), counts.unionByName(bytes_))
        state = write_once(alike.filter(~ended), "alike")
        offset, length = offset + length, length * STEP
    if out is None:
        return files.select("path", F.lit(None).cast("string").alias("full")).limit(0), files.select("path", F.lit(0).cast("long").alias("bytes_read")).limit(0)
    return out, counts.groupBy("path").agg(F.max("bytes_read").alias("bytes_read"))


def fingerprints(spark: SparkSession, roots: list[str], criteria: Criteria = Criteria(), known: DataFrame | None = None) -> DataFrame:
    """The inventory of the trees with ``full``, for ``find_duplicates``; files are read as little as may be.

    Files of unique size aren't opened. In turbo mode the others show their ends first, and only those with equal
    ends are read whole; else all are, except where bytes alone are compared: these are read range by range while they
    still equal another (``refined``). ``known`` (path, full_hash): files that need no reading. ``full`` is null
    for files that can equal no other, and for those that can't be read. Each step is written once, and files
    are spread over tasks by path, wherever they lie.
    """
    rows = write_once(dedup_physical(looked_at(scan_tree(spark, roots, content=False).drop("content"), criteria, roots)), "files")
    todo = size_candidates(rows).drop("block_ord") if criteria.by_size else rows
    if known is not None:
        todo = todo.join(known.filter(F.col("full_hash").isNotNull()).select("path"), "path", "left_anti")
    if criteria.by_byte and not criteria.by_hash and known is None:
        by = ["size"] + ["low_name"] * criteria.by_name
        full, _ = refined(todo.withColumn("low_name", F.lower("name")), by)
        return rows.join(write_once(full, "digests"), "path", "left")
    todo = todo.select("path", "size")
    if criteria.turbo and known is None:
        parts = write_once(todo.repartition("path").withColumn("part", partial_digest("path", "size", F.lit(criteria.partial))), "ends")
        again = parts.filter(F.col("part").isNotNull()).groupBy("size", "part").count().filter("count > 1").drop("count")
        todo = parts.join(again, ["size", "part"], "left_semi").select("path", "size")
    full = todo.repartition("path").select("path", whole_digest("path").alias("full"))
    if known is not None:
        full = full.unionByName(known.filter(F.col("full_hash").isNotNull()).select("path", F.col("full_hash").alias("full")))
    return rows.join(write_once(full, "digests"), "path", "left")
