"""Difference of two trees: rows of either side only, and common entries with their likeness.

Contents are hashed where they are read; slim rows are joined. Bodies move only for pairs of lines to compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import full_hash, which
from ..joins import spread_join
from ..session import write_once

#: Pairs whose lines are compared are broadcast up to this number (their places only).
BROADCAST_PAIRS = 200_000


def _side(tree: DataFrame, case_insensitive: bool, prefix: str) -> DataFrame:
    """The last row in walk order of each key, columns prefixed."""
    key = F.lower("rel_path") if case_insensitive else F.col("rel_path")
    w = Window.partitionBy("rel_key").orderBy(F.col("walk_ord").desc())
    slim = tree.select("path", "name", "size", "modified", "walk_ord", key.alias("rel_key"), full_hash(F.col("content")).alias("digest"))
    one = slim.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return one.select("rel_key", *[F.col(c).alias(f"{prefix}_{c}") for c in ("path", "name", "size", "modified", "digest", "walk_ord")])


def _bodies(tree: DataFrame, pairs: DataFrame, prefix: str) -> DataFrame:
    """(rel_key, content) of one side of ``pairs``."""
    wanted = pairs.select("rel_key", F.col(f"{prefix}_path").alias("path"), F.col(f"{prefix}_walk_ord").alias("walk_ord"))
    found = spread_join(tree.select("path", "walk_ord", "content"), wanted, ["path", "walk_ord"], BROADCAST_PAIRS)
    return found.select("rel_key", F.col("content").alias(f"{prefix}_content"))


def diff_trees(a: DataFrame, b: DataFrame, case_insensitive: bool = True, line_similarity: bool = False) -> DataFrame:
    """rel_key, side (a, b or common), similarity, newer, larger, and each side's path, size and time.

    Common entries of equal size and bytes are 1.0 alike. The others are compared by lines if
    ``line_similarity`` (in Python, for these pairs only), else their similarity is null.
    """
    both = _side(a, case_insensitive, "a").join(_side(b, case_insensitive, "b"), "rel_key", "full_outer")
    side = F.when(F.col("b_path").isNull(), F.lit("a")).when(F.col("a_path").isNull(), F.lit("b")).otherwise(F.lit("common"))
    equal = (F.col("a_size") == F.col("b_size")) & (F.col("a_digest") == F.col("b_digest"))
    rows = both.withColumn("side", side).withColumn("similarity", F.when(F.col("side") == "common", F.when(equal, F.lit(1.0))))
    if line_similarity:
        from ..functions.python_udfs import line_similarity as ratio

        odd = (F.col("side") == "common") & F.col("similarity").isNull()
        rows = write_once(rows, "diff")
        pairs = rows.filter(odd)
        bodies = _bodies(a, pairs, "a").join(_bodies(b, pairs, "b"), "rel_key").select("rel_key", ratio("a_content", "b_content").alias("_ratio"))
        rows = rows.join(bodies, "rel_key", "left").withColumn("similarity", F.coalesce("similarity", "_ratio")).drop("_ratio")
    common = F.col("side") == "common"
    return rows.select(
        "rel_key", "side", "similarity", F.when(common, which(F.col("a_modified"), F.col("b_modified"))).alias("newer"),
        F.when(common, which(F.col("a_size"), F.col("b_size"))).alias("larger"), "a_path", "a_size", "a_modified", "b_path", "b_size", "b_modified",
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: unique_a, unique_b, common, total, overlap per cent, identical and modified common entries."""
    n = {s: F.count_if(F.col("side") == s) for s in ("a", "b", "common")}
    same = F.count_if((F.col("side") == "common") & (F.coalesce("similarity", F.lit(0.0)) == 1.0))
    return diff.agg(
        n["a"].alias("unique_a"), n["b"].alias("unique_b"), n["common"].alias("common"), F.count(F.lit(1)).alias("total"), same.alias("identical"), (n["common"] - same).alias("modified"),
    ).withColumn("overlap", F.when(F.col("total") > 0, F.round(100.0 * F.col("common") / F.nullif("total", F.lit(0)), 4)).otherwise(0.0))
