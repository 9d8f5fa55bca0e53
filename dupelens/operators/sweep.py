"""Sweeping: empty folders, broken links, emptied parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parent, path_key


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last, as an array of paths."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _holding(paths: DataFrame) -> DataFrame:
    """All folders above any of ``paths``, each once: of many files in a folder, the folder goes on alone."""
    folders = paths.filter(F.contains("path", F.lit("/"))).select(parent(F.col("path")).alias("path")).distinct()
    return folders.select(F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("path")).distinct()


def empty_dirs(dirs: DataFrame, inv: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """Folders (path, depth) that hold nothing, or only such folders; roots are never among them.

    ``dirs`` (path, and optionally ``closed``: pruned, linked or unreadable, and ``walk_ord``, which is kept) are all folders. A folder is not
    empty if any file or closed folder lies below it, so no recursion over levels is needed: the ancestors of
    those are subtracted.
    """
    closed = dirs.filter("closed") if "closed" in dirs.columns else dirs.limit(0)
    full = _holding(inv.select("path").unionByName(closed.select("path")))
    open_ = dirs.join(closed.select("path"), "path", "left_anti") if "closed" in dirs.columns else dirs
    each = open_.groupBy("path").agg(F.min("walk_ord").alias("walk_ord")) if "walk_ord" in dirs.columns else open_.select("path").distinct()
    out = each.join(full, "path", "left_anti")
    if roots:
        out = out.filter(~path_key(F.col("path")).isin([r.rstrip("/").lower() for r in roots]))
    return out.withColumn("depth", (F.size(F.split("path", "/")) - 1).cast("long"))


def report_order(dirs: DataFrame) -> DataFrame:
    """Empty folders as they are reported: against the walk, so that each stands before the one that holds it."""
    return dirs.orderBy(F.col("walk_ord").desc())


def link_targets(links: DataFrame, existing: DataFrame) -> DataFrame:
    """``links`` (path, content, ...) with ``target`` instead of content: of what may be meant the first that is among ``existing`` (path), else the first."""
    from ..functions.python_udfs import link_candidates

    rows = links.withColumn("_may", link_candidates("content")).drop("content")
    each = rows.select("path", F.posexplode("_may").alias("_at", "_target")).withColumn("_key", path_key(F.col("_target")))
    there = each.join(existing.select(path_key(F.col("path")).alias("_key")).distinct(), "_key", "left_semi")
    found = there.groupBy("path").agg(F.min(F.struct("_at", "_target"))["_target"].alias("_found"))
    return rows.join(found, "path", "left").withColumn("target", F.coalesce("_found", F.get("_may", F.lit(0)))).drop("_may", "_found")


def deletion_order(dirs: DataFrame) -> DataFrame:
    """Deepest folders first, each once."""
    return dirs.dropDuplicates(["path"]).orderBy(F.col("depth").desc(), F.col("path").desc())


def broken_links(links: DataFrame, existing: DataFrame, drives: DataFrame | None = None) -> DataFrame:
    """Links (path, name, target, size, modified) whose target isn't among ``existing`` (path).

    With ``drives`` (drive), only links to a drive that is there count; links without target never do.
    """
    rows = links.filter(F.col("target").isNotNull() & (F.col("target") != "")).withColumn("_key", path_key(F.col("target")))
    rows = rows.join(existing.select(path_key(F.col("path")).alias("_key")).distinct(), "_key", "left_anti")
    if drives is not None:
        rows = rows.withColumn("_drive", F.regexp_extract("_key", r"^([a-z]:)", 1))
        rows = rows.join(drives.select(F.lower("drive").alias("_drive")).distinct(), "_drive", "left_semi").drop("_drive")
    return rows.drop("_key")


def emptied_parents(gone: DataFrame, inv: DataFrame) -> DataFrame:
    """Direct parents of the removed paths that hold no other file; never their parents in turn."""
    folders = gone.select(parent(F.col("path")).alias("path")).distinct()
    left = _holding(inv.join(gone.select("path"), "path", "left_anti").select("path"))
    return folders.join(left, "path", "left_anti")
