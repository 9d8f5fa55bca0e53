"""Joins and numbering that bring neither a hot key's rows nor all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import write_once


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, underscored until no column of ``taken`` has it, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def few(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than it needs to know."""
    return df.limit(bound + 1).count() <= bound


def shuffled(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` by a shuffle, whatever their estimated sizes; a hot key's rows are split by adaptive execution.

    Spark's estimate of a table's size follows the compressed files and leaves out what ``explode`` adds, so it sends tables
    of many times its threshold through the driver. For joins of what grows with the input.
    """
    return rows.join(other.hint("merge"), list(keys), how)


def spread_join(rows: DataFrame, other: DataFrame, keys: Sequence[str], bound: int, how: str = "inner", by: str | None = None, salts: int = 32) -> DataFrame:
    """``rows`` joined with ``other``, a row a key, without bringing a hot key's rows into one task.

    Up to ``bound`` rows ``other`` is broadcast; beyond, each of its rows goes to ``salts`` tasks and ``rows``
    spread over them, by the hash of column ``by`` (of the whole row where none is named). Null keys meet nothing.
    """
    if few(other, bound):
        return rows.join(F.broadcast(other), list(keys), how)
    salt = unused("salt", [*rows.columns, *other.columns])
    copies = other.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(*([by] if by else rows.columns)), F.lit(salts)).cast("int"))
    return shuffled(spread, copies, [*keys, salt], how).drop(salt)


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with their number from 0 in ``order``.

    Rows are dealt by range and written once; a range counts its own rows, and only the counts, a row a range,
    come together. ``order`` should leave no ties.
    """
    part, upto = unused("part", rows.columns), unused("upto", rows.columns)
    dealt = write_once(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(upto))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, own).join(F.broadcast(starts), part).withColumn(name, (F.col(name) + F.col(upto)).cast("long")).drop(part, upto)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums (and exclusive ors) of the rows of the same ``by`` up to each row in ``order``.

    Rows are dealt by range of ``by`` and ``order`` and written once, so a group of any size spans as many ranges as
    it needs. A range adds up its own rows; only the totals of the first and last group of each range, two rows a
    range, come together to say what a group had before. ``order`` should leave no ties within a group; nulls of
    ``by`` are one group.
    """
    xors = xors or {}
    taken = [*rows.columns, *sums, *xors]
    part, low, high = (unused(c, taken) for c in ("part", "low", "high"))
    ins = {name: unused(f"{name}_in", taken) for name in [*sums, *xors]}
    total = lambda name: F.sum(ins[name]) if name in sums else F.bit_xor(ins[name])
    plus = lambda name, a, b: a + b if name in sums else a.bitwiseXOR(b)
    given = rows.withColumns({ins[name]: c.cast("long") for name, c in (sums | xors).items()})
    dealt = write_once(given.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    group = F.struct(*by)
    edges = dealt.groupBy(part).agg(F.min(group).alias(low), F.max(group).alias(high))  # a row a range
    at_edge = dealt.join(F.broadcast(edges), part).filter((group == F.col(low)) | (group == F.col(high)))
    totals = at_edge.groupBy(part, *by).agg(*[total(name).alias(name) for name in ins])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # at most a row a range
    kind = {name: (F.sum if name in sums else F.bit_xor)(name).over(before).alias(name) for name in ins}
    starts = totals.select(part, *[F.col(c).alias(f"{part}_{k}") for k, c in enumerate(by)], *kind.values()).filter(F.col(next(iter(ins))).isNotNull())
    upto = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({name: total(name).over(upto) for name in ins})
    on = own[part] == starts[part]
    for k, c in enumerate(by):
        on &= own[c].eqNullSafe(starts[f"{part}_{k}"])
    kept = [own[c] for c in rows.columns]
    return own.join(F.broadcast(starts), on, "left").select(*kept, *[plus(name, own[name], F.coalesce(starts[name], F.lit(0))).alias(name) for name in ins])


#: Groups of more rows than this are numbered by ranges.
HOT_GROUP = 100_000


def numbered_within(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with their number from 0 in ``order`` among those of the same ``by``.

    Groups of up to ``HOT_GROUP`` rows are sorted by a task each; the rows of larger ones are dealt by range. Groups are
    counted map-side first, so ``rows`` is read twice.
    """
    large = rows.groupBy(*by).count().filter(F.col("count") > HOT_GROUP).select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)])
    small = lambda df: df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    if large.isEmpty():
        return small(rows)
    on = F.lit(True)
    for k, c in enumerate(by):
        on &= rows[c].eqNullSafe(large[f"_{k}"])
    hot = running(rows.join(large, on, "left_semi"), by, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)
    return small(rows.join(large, on, "left_anti")).unionByName(hot)
