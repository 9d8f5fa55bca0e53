"""Choosing what to keep, filtering and sorting groups.

Rules give the members to remove. They act on the groups in view (with several members); afterwards
``protect`` gives back the first member of any group that would lose all. Ties go to the earliest member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import under
from ..joins import numbered_within
from .filters import longest_prefix

YEAR = 365 * 86400
PAGE = 50
RULES = ("first", "last", "newest", "oldest", "largest_res", "priority", "shortest", "all", "none", "invert")


def _with(members: DataFrame, *values: Column, several: bool = True) -> DataFrame:
    """``members`` with values of their groups, of which a join splits those of very many members.

    Values come from aggregates, which add up a group's rows where they are. ``several``: only groups of several.
    """
    groups = members.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n"), *values)
    return members.join(groups.filter("_n > 1") if several else groups, "group_key").drop("_n")


def _least(*order: Column) -> Column:
    """member_ord of the first member in ``order``."""
    return F.min(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)], F.col("member_ord").alias("at")))["at"]


def _scoped(scope: DataFrame, rule: str, priorities: Sequence[str] | DataFrame) -> DataFrame:
    """Members of groups of several that the rule removes."""
    kept = {"newest": [-F.col("modified")], "oldest": [F.col("modified")], "shortest": [F.length("path")], "last": [-F.col("member_ord")]}
    if rule == "largest_res":
        kept[rule] = [F.col("pixels").isNull(), -F.col("pixels")]
    if rule in kept:
        return _with(scope, _least(*kept[rule]).alias("_at")).filter("member_ord <> _at")
    if rule == "first":
        return _with(scope).filter("member_ord > 0")
    if rule == "priority":
        if isinstance(priorities, DataFrame):
            scope = longest_prefix(scope, priorities, "_priority")
            own = F.col("_priority").isNotNull()
        else:
            own = under(F.col("path"), priorities)
        return _with(scope, F.bool_or(own).alias("_any")).filter(F.when(F.col("_any"), ~own).otherwise(F.col("member_ord") > 0))
    if rule in ("all", "none"):
        return _with(scope).filter(F.lit(rule == "all"))
    raise ValueError(f"no such rule: {rule}")


def select_members(members: DataFrame, rule: str, priorities: Sequence[str] | DataFrame = (), view: DataFrame | None = None, selection: DataFrame | None = None) -> DataFrame:
    """Paths to remove by ``rule``; ``view``: the members of the groups in view, all by default.

    ``invert`` takes the paths in view less ``selection``; every other rule starts from none. ``largest_res``
    needs a column ``pixels``. ``priorities``: folders, or a table of any number of them in a column ``prefix``.
    """
    scope = members if view is None else view
    if rule == "invert":
        chosen = _with(scope).select("path")
        if selection is not None:
            chosen = chosen.join(selection.select("path").distinct(), "path", "left_anti")
    else:
        chosen = _scoped(scope, rule, priorities).select("path")
    return protect(members, chosen)


def _marked(members: DataFrame, selection: DataFrame) -> DataFrame:
    sel = selection.select("path").distinct().withColumn("selected", F.lit(True))
    return members.join(sel, "path", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def protect(members: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection without the first members of groups (of several) that it takes whole."""
    m = _marked(members, selection).select("group_key", "member_ord", "path", "selected")
    m = _with(m, F.bool_and("selected").alias("_all"), F.count(F.lit(1)).alias("_of"), several=False)
    return m.filter("selected AND NOT (_all AND _of > 1 AND member_ord = 0)").select("path").distinct()


def endangered_groups(members: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: groups of several members of which all are selected."""
    g = _marked(members, selection).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("selected").alias("gone"))
    return g.agg(F.count_if(F.col("gone") & (F.col("n") > 1)).alias("endangered"))


def default_selection(members: DataFrame, content_verified: bool, allow_hardlink: bool = True, by_picture: bool = False) -> DataFrame:
    """All but first members, of groups whose first isn't empty; only where contents have been proved equal."""
    if not (allow_hardlink and content_verified and not by_picture):
        return members.select("path").limit(0)
    first = F.max(F.when(F.col("member_ord") == 0, F.col("size"))).alias("_first")
    return _with(members, first, several=False).filter("member_ord > 0 AND _first <> 0").select("path")


def filter_groups(members: DataFrame, category: str | None = None, search: str = "", min_size: int = 0, age: str | None = None, now: float = 0.0) -> DataFrame:
    """Members of the groups in view.

    The category and size tested are the first member's; the search text may be in any member's name or path;
    ``age`` tests the newest member: ``year`` is at most 365 days before ``now``, ``older`` is longer ago.
    """
    first = lambda c: F.max(F.when(F.col("member_ord") == 0, F.col(c)))
    keep = F.lit(True)
    if category and category != "all":
        keep &= first("category") == category
    if text := search.strip().lower():
        keep &= F.bool_or(F.contains(F.lower("name"), F.lit(text)) | F.contains(F.lower("path"), F.lit(text)))
    if min_size > 0:
        keep &= first("size") >= min_size
    if age:
        recent = F.max("modified") >= now - YEAR
        keep &= recent if age == "year" else ~recent
    return _with(members, keep.alias("_keep"), several=False).filter("_keep").drop("_keep")


def sort_groups(members: DataFrame, by: str = "wasted") -> DataFrame:
    """A row a group with its measures, greatest first, ties in group order."""
    g = members.groupBy("group_key", "block_ord", "group_ord").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.when(F.col("member_ord") > 0, F.col("size"))), F.lit(0)).alias("wasted"),
        F.max(F.when(F.col("member_ord") == 0, F.col("size"))).alias("size"),
    )
    if by not in ("wasted", "count", "size"):
        raise ValueError(f"no such order: {by}")
    return g.orderBy(F.col(by).desc(), "block_ord", "group_ord")


def page(rows: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    """A page of ordered rows."""
    return rows.offset(number * size).limit(size) if number else rows.limit(size)


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of the groups without the paths ``gone``; groups of one vanish, members are counted anew."""
    left = members.join(gone.select("path").distinct(), "path", "left_anti")
    return numbered_within(_with(left).withColumnRenamed("member_ord", "_was"), ["group_key"], ["_was"], "member_ord").drop("_was").select(members.columns)
