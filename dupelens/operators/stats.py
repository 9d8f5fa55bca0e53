"""Totals over duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _groups(members: DataFrame) -> DataFrame:
    return members.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("member_ord") > 0, F.col("size"))), F.lit(0)).alias("wasted"),
        F.max(F.when(F.col("member_ord") == 0, F.col("category"))).alias("category"),
    )


def group_wasted(members: DataFrame) -> DataFrame:
    """Bytes of each group beside its first member."""
    return _groups(members).select("group_key", "n", "wasted")


def wasted_totals(members: DataFrame) -> DataFrame:
    """One row: groups, surplus files, wasted bytes."""
    g = _groups(members)
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("surplus"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def category_rollup(members: DataFrame) -> DataFrame:
    """Groups and wasted bytes by the first member's category, and of ``all``."""
    out = _groups(members).rollup("category").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"), F.grouping("category").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("category")).alias("category"), "groups", "wasted")


def category_share(members: DataFrame) -> DataFrame:
    """Per cent of the wasted bytes by category, where any."""
    by = _groups(members).groupBy("category").agg(F.sum("wasted").alias("wasted")).filter("wasted > 0")
    all_ = F.sum("wasted").over(Window.partitionBy(F.lit(1)))  # a row for each of the seven categories
    return by.select("category", "wasted", F.round(100.0 * F.col("wasted") / all_, 4).alias("share"))


def selected_kpi(members: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: selected files that are members, and their bytes."""
    return members.join(selection.select("path").distinct(), "path", "left_semi").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def action_summary(results: DataFrame, shown: int = 5) -> DataFrame:
    """One row of results (path, ok, freed, error): done, failed, freed bytes and the first errors by path."""
    failed = results.filter(~F.col("ok")).select("path", "error").orderBy("path", "error").limit(shown)
    first = F.transform(F.array_sort(F.collect_list(F.struct("path", "error"))), lambda x: x["error"])  # of ``shown`` rows at most
    sums = results.agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("freed"))), F.lit(0)).alias("freed_bytes"))
    return sums.crossJoin(failed.agg(first.alias("errors")))
