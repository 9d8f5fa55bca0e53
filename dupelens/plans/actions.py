"""Plans of clean-up actions. Spark checks and plans; nothing here changes a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parent, path_key, same_volume
from ..joins import numbered, running
from ..operators.sweep import emptied_parents
from ..session import write_once

#: Times of a snapshot may differ by this much.
TOLERANCE = 0.001
#: Rows an executor takes at once, between tests for cancellation.
CHUNK = 200


def verify_snapshot(snapshot: DataFrame, inv: DataFrame) -> DataFrame:
    """``snapshot`` (path, size, mtime) with ``ok`` and ``reason``: access, size or mtime, tested in this order."""
    now = inv.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    reason = (
        F.when(F.col("_path").isNull(), "access").when(F.col("size") != F.col("_size"), "size")
        .when(F.abs(F.col("mtime") - F.col("_modified")) > TOLERANCE, "mtime")
    )
    out = snapshot.join(now, F.col("path") == F.col("_path"), "left").withColumn("reason", reason)
    return out.withColumn("ok", F.col("reason").isNull()).drop("_path", "_size", "_modified")


def snapshot_of(members: DataFrame, selection: DataFrame) -> DataFrame:
    """(path, size, mtime) of the selected members."""
    return members.join(selection.select("path").distinct(), "path", "left_semi").select("path", "size", F.col("modified").alias("mtime")).distinct()


def chunked(plan: DataFrame, order: str = "path", size: int = CHUNK) -> DataFrame:
    """``plan`` with the number of each row's chunk."""
    return numbered(plan, [order], "chunk").withColumn("chunk", F.floor(F.col("chunk") / size))


def delete_plan(members: DataFrame, selection: DataFrame, inv: DataFrame) -> DataFrame:
    """path, size, mtime, ok, reason and freed bytes of a deletion."""
    return verify_snapshot(snapshot_of(members, selection), inv).withColumn("freed", F.when(F.col("ok"), F.col("size")).otherwise(0).cast("long"))


def hardlink_plan(members: DataFrame, selection: DataFrame, inv: DataFrame) -> DataFrame:
    """original, duplicate, size, reason and freed bytes: selected members of a group become links to its first.

    ``inv`` is the inventory as it is now, with hash. Reasons of refusal, in this order: the duplicate's
    snapshot (access, size, mtime), missing-original, same-path, cross-volume, already-linked, size-diff,
    content-diff. Already linked pairs and refused ones free nothing.
    """
    first = members.filter("member_ord = 0").select("group_key", F.col("path").alias("original"))
    picked = members.join(selection.select("path").distinct(), "path", "left_semi").filter("member_ord > 0 AND size > 0")
    pairs = picked.select("group_key", F.col("path").alias("duplicate"), "size", F.col("modified").alias("mtime")).join(first, "group_key").drop("group_key")
    cols = ("path", "size", "modified", "dev", "ino", "hash")
    o, d = (inv.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "od")
    rows = pairs.join(o, F.col("original") == F.col("o_path"), "left").join(d, F.col("duplicate") == F.col("d_path"), "left")
    windows = F.col("original").rlike("^[A-Za-z]:")
    reason = (
        F.when(F.col("d_path").isNull(), "access").when(F.col("d_size") != F.col("size"), "size").when(F.abs(F.col("d_modified") - F.col("mtime")) > TOLERANCE, "mtime")
        .when(F.col("o_path").isNull(), "missing-original").when(path_key(F.col("original")) == path_key(F.col("duplicate")), "same-path")
        .when((F.col("o_dev") != F.col("d_dev")) | (windows & ~same_volume(F.col("original"), F.col("duplicate"))), "cross-volume")
        .when((F.col("o_ino") != 0) & (F.col("o_ino") == F.col("d_ino")), "already-linked")
        .when(F.col("o_size") != F.col("d_size"), "size-diff").when(~F.col("o_hash").eqNullSafe(F.col("d_hash")) | F.col("o_hash").isNull(), "content-diff")
    )
    return rows.select("original", "duplicate", "size", reason.alias("reason")).withColumn("freed", F.when(F.col("reason").isNull(), F.col("size")).otherwise(0).cast("long"))


def _family(name: Column) -> tuple[Column, Column, Column]:
    """(stem without a number, number or null, suffix) of a name as ``stem (n).ext``."""
    suffix = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    number = F.nullif(F.regexp_extract(stem, r"(?s) \(([1-9][0-9]{0,17})\)$", 1), F.lit("")).cast("long")
    bare = F.when(number.isNull(), stem).otherwise(F.substr(stem, F.lit(1), F.length(stem) - F.length(number.cast("string")) - 3))
    return bare, number, suffix


def move_plan(members: DataFrame, selection: DataFrame, inv: DataFrame, destination: str) -> DataFrame:
    """src, dst, ok and reason: targets in one folder, none of which is taken or given twice, whatever their case.

    A name that isn't taken goes to the first path, in path order, that asks for it. The others get `` (n)`` before
    their suffix, with the least numbers that are neither taken there nor asked for by others: names with numbers come
    from one stem and suffix only, so each family of names counts for itself. Refused rows get no target. Families are
    numbered by ranges (``joins.running``), so a name that all files have is no one task's.
    """
    checked = verify_snapshot(snapshot_of(members, selection), inv)
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    dest = destination.rstrip("/")
    there = inv.filter(parent(F.col("path")) == dest).select(F.lower(name).alias("low")).distinct()
    rows = write_once(checked.withColumn("name", name).withColumn("low", F.lower(name)), "moves")
    asked = rows.filter("ok").groupBy("low").agg(F.min("path").alias("path")).join(there, "low", "left_anti").withColumn("first", F.lit(True))
    rows = rows.join(asked.select("path", "first"), "path", "left")
    # the others, by family: the i-th of it, from 1
    suffix = _family(F.col("name"))[2]
    own = F.substr("name", F.lit(1), F.length("name") - F.length(suffix))
    others = rows.filter("ok AND first IS NULL").select("path", own.alias("stem"), suffix.alias("suffix"))
    others = others.withColumn("low_stem", F.lower("stem")).withColumn("low_suffix", F.lower("suffix"))
    family = ["low_stem", "low_suffix"]
    ith = running(others, family, ["path"], {"i": F.lit(1)})
    # before the j-th used number u (j from 0) stand u - 1 - j free ones, so the i-th free number has passed it if u - j <= i
    bare, number, after = _family(F.col("low"))
    used = there.unionByName(asked.select("low")).select(bare.alias("low_stem"), after.alias("low_suffix"), number.alias("u")).filter("u IS NOT NULL")
    used = used.join(others.select(*family).distinct(), family, "left_semi")
    passed = running(used, family, ["u"], {"j": F.lit(1)}).select(*family, (F.col("u") - F.col("j") + 1).alias("i"), F.lit(1).alias("mark"))
    both = ith.select(*family, "i", F.lit(0).alias("mark"), "path", "stem", "suffix").unionByName(passed, allowMissingColumns=True)
    numbered_ = running(both, family, ["i", F.col("mark").desc()], {"before": F.col("mark")}).filter("mark = 0")
    given = numbered_.select("path", F.concat("stem", F.lit(" ("), (F.col("i") + F.col("before")).cast("string"), F.lit(")"), "suffix").alias("given"))
    out = rows.join(given, "path", "left")
    target = F.when(F.col("ok"), F.concat(F.lit(dest + "/"), F.when(F.col("first"), F.col("name")).otherwise(F.col("given"))))
    return out.select(F.col("path").alias("src"), target.alias("dst"), "ok", "reason")


def parents_to_remove(plan: DataFrame, inv: DataFrame) -> DataFrame:
    """Folders that a deletion empties: direct parents of its paths only."""
    return emptied_parents(plan.filter("ok").select("path"), inv)
