"""Predicates over an inventory: pruning, exclusion patterns, sizes, system paths, physical identity, junk."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ancestors, components, ext, once, one_of, parent, path_key, under
from ..joins import spread_join, unused
from ..session import write_once

# Folders that no scan enters, system folders, junk.
NEVER_ENTERED = ("$recycle.bin", "system volume information")
SYSTEM_TOP = (
    "$recycle.bin", "system volume information", "$windows.~bt", "$windows.~ws", "recovery", "boot",
    "config.msi", "msocache", "windows", "program files", "program files (x86)", "programdata",
)
SYSTEM_ANYWHERE = ("system32", "syswow64", "winsxs")
SYSTEM_ROOTS = ("c:/windows", "c:/program files", "c:/program files (x86)", "c:/programdata")
JUNK_EXTENSIONS = (".tmp", ".bak", ".old", ".dmp", ".log", ".gid", ".chk")
JUNK_NAMES = ("thumbs.db", ".ds_store", "$recycle.bin")
KEPT_JUNK = (".bak", ".dmp", ".old")
JUNK_LIMIT = 100 * 1024 * 1024


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def prune(inv: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """Drop what lies in a never-entered folder or a junction below its root; a root itself is always entered.

    The root of a row is the first of ``roots`` it lies under; without one, the whole path counts as below.
    A boolean column ``in_junction``, if present, marks rows reached through a junction.
    """
    folder = path_key(parent(F.col("path")))
    below = folder
    for r in reversed([posixpath.normpath(x.replace("\\", "/")).lower() for x in roots]):
        below = F.when((folder == r) | folder.startswith(r.rstrip("/") + "/"), F.substring(folder, len(r) + 1, 1 << 20)).otherwise(below)
    entered = ~F.exists(components(below), lambda c: c.isin(*NEVER_ENTERED))
    if "in_junction" in inv.columns:
        entered &= ~F.coalesce("in_junction", F.lit(False))
    return inv.filter(entered)


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[..]``, ``[!..]``) as a regular expression for a whole component."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negate = body.startswith("!")
            body = re.sub(r"([\\\[\]&^~])", r"\\\1", body[negate:])
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return f"(?s)^{''.join(out)}(?!.)"


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches: one with a separator or a last ``:`` as a path prefix, else any whole component.

    Case doesn't count; blank patterns are ignored; components of the scan's root count too. The plan has at most five
    tests, however many patterns there are: prefixes, whole names, ``name*`` and ``*name`` are looked up by hash, by
    the path's ancestors, its components and their first or last characters; all other shell patterns are
    alternatives of one regular expression.
    """
    kinds: dict[str, set[str]] = {"under": set(), "whole": set(), "head": set(), "tail": set(), "glob": set()}
    for p in (p.strip().lower() for p in patterns):
        if p:
            kinds[_kind(p)].add(p)
    parts, tests = components(path), []
    if kinds["under"]:
        tests.append(under(path, sorted(kinds["under"])))
    if kinds["whole"]:
        tests.append(F.exists(parts, lambda c: one_of(c, kinds["whole"])))
    if kinds["head"]:
        tests.append(_cut(parts, F.left, {p[:-1] for p in kinds["head"]}))
    if kinds["tail"]:
        tests.append(_cut(parts, F.right, {p[1:] for p in kinds["tail"]}))
    if kinds["glob"]:
        any_of = "|".join(f"(?:{glob_regex(p)})" for p in sorted(kinds["glob"]))
        tests.append(F.exists(parts, lambda c: c.rlike(any_of)))
    return _any(tests)


def _kind(pattern: str) -> str:
    if "/" in pattern or "\\" in pattern or pattern.endswith(":"):
        return "under"
    if not re.search(r"[*?\[]", pattern):
        return "whole"
    if pattern.count("*") == 1 and not re.search(r"[?\[]", pattern) and (pattern[0] == "*" or pattern[-1] == "*"):
        return "tail" if pattern[0] == "*" else "head"
    return "glob"


def _cut(parts: Column, cut: Callable[[Column, Column], Column], texts: set[str]) -> Column:
    """Whether the first (last) characters of any part are one of ``texts``, of which only the lengths are tried."""
    lengths = F.array(*[F.lit(n) for n in sorted({len(t) for t in texts})])
    return F.exists(parts, lambda c: F.exists(lengths, lambda n: one_of(cut(c, n), texts)))


def exclude(inv: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return inv.filter(~excluded(F.col("path"), patterns))


#: Folders of a table that are sent to all tasks, through the driver's memory.
FOLDERS_SENT = 20_000


def longest_prefix(inv: DataFrame, folders: DataFrame, name: str = "prefix", column: str = "prefix") -> DataFrame:
    """``inv`` with ``name``: the longest of ``folders`` that the row's path is or lies below, by whole parts; else null.

    For tables of prefixes of any size: the plan doesn't depend on it. Only the distinct folders of the inventory climb;
    their ancestors meet the prefixes by a hash join, and rows meet what their folder found, a hot folder's spread over
    many tasks. Both as ``path_key`` gives them; blank and null prefixes are ignored, repeated ones count once, a null
    path has none. A column of that name in ``inv`` is replaced. The prefixes, the distinct folders and what they found are
    written once; ``inv`` is read twice.
    """
    inv = inv.drop(name)
    own, folder, up, found, at = (unused(c, [*inv.columns, name]) for c in ("own", "folder", "up", "found", "at"))
    known = write_once(_folder_keys(folders, column).select(F.col("prefix").alias(up)), "prefixes")
    above_it = once(ancestors(F.col("path")), lambda a: F.get(a, F.size(a) - 2))
    rows = inv.withColumn(own, path_key(F.col("path"))).withColumn(folder, F.coalesce(above_it, F.lit("")))
    climbing = write_once(rows.select(folder).distinct().filter(F.col(folder) != ""), "folders")
    climbed = climbing.withColumn(up, F.explode(ancestors(F.col(folder))))
    above = write_once(spread_join(climbed, known, [up], FOLDERS_SENT, by=folder).groupBy(folder).agg(F.max_by(up, F.length(up)).alias(found)), "above")
    rows = spread_join(rows, above, [folder], FOLDERS_SENT, how="left", by=own)
    rows = spread_join(rows, known.select(F.col(up).alias(own), F.col(up).alias(at)), [own], FOLDERS_SENT, how="left", by=folder)
    return rows.select(*[F.col(f"`{c}`") for c in inv.columns], F.coalesce(at, found).alias(name))


def exclude_under(inv: DataFrame, folders: DataFrame, column: str = "prefix") -> DataFrame:
    """Rows that lie neither at nor below any folder of a table of any size; rows of a null path stay."""
    name = unused("prefix", inv.columns)
    return longest_prefix(inv, folders, name, column).filter(F.col(name).isNull()).drop(name)


def split_patterns(field: str) -> list[str]:
    """Patterns of a comma-separated field."""
    return [p.strip() for p in field.split(",") if p.strip()]


def size_range(inv: DataFrame, min_size: int = 0, max_size: int | None = None, ignore_empty: bool = True) -> DataFrame:
    """Rows of ``min_size`` to ``max_size`` bytes (null: no limit), empty ones left out by default."""
    if max_size is not None and max_size < min_size:
        raise ValueError("the largest size is below the smallest")
    out = inv.filter(F.col("size") >= min_size)
    if max_size is not None:
        out = out.filter(F.col("size") <= max_size)
    return out.filter(F.col("size") > 0) if ignore_empty else out


def kb_range(min_kb: int, max_kb: int | None) -> tuple[int, int | None]:
    """Bytes of a range in KB; a limit of 0 or less is none."""
    top = max_kb * 1024 if max_kb and max_kb > 0 else None
    if top is not None and top < min_kb * 1024:
        raise ValueError("the largest size is below the smallest")
    return min_kb * 1024, top


def is_system_path(path: Column, roots: Sequence[str] = SYSTEM_ROOTS) -> Column:
    """Whether a path belongs to the system: by its first folder, by any system folder, or by a system root."""
    parts = F.filter(components(path), lambda c: ~c.rlike(r"^[a-z]:$"))
    key = path_key(path)
    below = _any([(key == r) | key.startswith(r + "/") for r in roots])
    return F.coalesce(F.get(parts, F.lit(0)).isin(*SYSTEM_TOP), F.lit(False)) | F.arrays_overlap(parts, F.array(*map(F.lit, SYSTEM_ANYWHERE))) | below


def dedup_physical(inv: DataFrame) -> DataFrame:
    """The first row, in walk order, of each (dev, ino); rows without inode (0 or null) all stay.

    Those rows are keyed by their path, so that they make no hot key.
    """
    none = F.coalesce(F.col("ino"), F.lit(0)) == 0
    w = Window.partitionBy(F.when(~none, F.col("dev")), F.when(~none, F.col("ino")), F.when(none, F.col("path"))).orderBy("walk_ord")
    return inv.withColumn("_nth", F.row_number().over(w)).filter((F.col("_nth") == 1) | none).drop("_nth")


def is_junk(inv_name: Column, path: Column) -> Column:
    """Left-over files by extension or name, outside the system's folders."""
    return (ext(inv_name).isin(*JUNK_EXTENSIONS) | F.lower(inv_name).isin(*JUNK_NAMES)) & ~is_system_path(path)


def junk_files(inv: DataFrame) -> DataFrame:
    return inv.filter(is_junk(F.col("name"), F.col("path")))


def junk_preselected(junk: DataFrame) -> DataFrame:
    """Of junk, what is marked for removal at first: up to 100 MB, and no backups, dumps or old versions."""
    return junk.filter((F.col("size") <= JUNK_LIMIT) & ~ext(F.col("name")).isin(*KEPT_JUNK))


def _folder_keys(folders: DataFrame, column: str) -> DataFrame:
    return folders.select(path_key(F.trim(F.col(column), F.lit(" \t\n\v\f\r"))).alias("prefix")).filter(F.col("prefix") != "").distinct()


def normalize_folders(folders: DataFrame, column: str = "prefix") -> DataFrame:
    """Distinct folders in comparison form, blanks left out, sorted."""
    return _folder_keys(folders, column).orderBy("prefix")
