"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every source gets a budget of words. Whole passes over a source ("epochs") fill the budget first; the rest
is a weighted sample without replacement: a document's key is ``-ln(u) / weight`` with u from its id, and
documents are taken by rising key until the budget is met.

No task sorts a whole source. Keys are cut into ``BINS`` bins by a monotone map to (0, 1); the words of each
(source, bin) are summed map-side, prefix sums over these few rows find the bin in which the budget ends, and
only that bin's documents are put in order.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; sizes of 0 are
taken 0 times; null weights count as 1; ties of key go by doc_id (nulls first); equal rows are interchangeable.
An empty table gives an empty result. Columns of the input pass through, whatever their names; only those named
like a column of the result (``size``, ``source_size``, ``target``, ``taken``) are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bins of the key, at least and at most; the exact order is needed only within one bin of each source. There are
#: eight times the root of the number of rows, so that bins and the rows of one grow alike.
BINS, MOST_BINS = 4096, 1 << 20
#: Sources up to this number are broadcast (about 100 bytes each); beyond, a salted join is used.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: Quality labels up to this number are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_QUALITY = 200_000
WEIGHTS = (5, 2, 1)
RESULT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and the controls 9 to 13; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Word budgets of the sources (source, source_size): shares by weight, none above ``cap`` times its size.

    Weights repeat over the sources in code point order, null last. What a cap cuts off is shared among the
    others by weight until none is above: with sources in order of cap / weight, the level at which all
    budgets are met follows from prefix sums.
    """
    one = Window.partitionBy(F.lit(1))  # one row for each source
    at = (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    total = F.sum("source_size").over(one) * F.lit(float(share))
    order = one.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (total - before) / rest
    s = s.withColumn("level", level).withColumn("open", F.col("ratio") >= F.col("level"))
    # the first source (by ratio) that its cap doesn't stop sets the level for all after it
    lam = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(one)["level"]
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.when(lam.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * lam))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0, quality: DataFrame | None = None, seed: str = "mix-1", keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken.

    ``taken`` is size times the passes that take the document. The document in which the budget ends is taken
    if that brings the source nearer to its target. ``quality``: rows (_q_id, _q) of
    unique ids and positive weights, as ``quality_weights`` makes them; higher is likelier taken.
    """
    docs = docs.drop(*RESULT)
    cols = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    own = {c: c if c in ("doc_id", "source", "text") else f"in{i}" for i, c in enumerate(cols)}  # no clash with names below
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], word_count(F.col("text")).alias("size"))
    if quality is not None:
        small = quality.count() <= BROADCAST_QUALITY
        rows = rows.join(F.broadcast(quality) if small else quality, F.col("doc_id") == F.col("_q_id"), "left")
    else:
        rows = rows.withColumn("_q", F.lit(1.0))
    rows = rows.withColumn("_key", -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce(F.col("_q"), F.lit(1.0)))
    if not keep_text:  # slim rows: the texts are read once
        rows = materialize(rows, "sizes")
    n_bins = min(MOST_BINS, max(BINS, 1 << math.ceil(math.log2(8 * math.sqrt(max(1, (docs if keep_text else rows).count()))))))
    rows = rows.withColumn("_bin", F.least(F.lit(n_bins - 1), F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * n_bins)).cast("int"))
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("words"))
    budget = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    budget = budget.withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    budget = budget.withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # at most MOST_BINS rows
    ends = (
        bins.withColumn("upto", F.sum("words").over(run)).alias("b").join(budget.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .groupBy(F.col("t.source").alias("_source"), "source_size", "target", "_passes", "_rest")
        .agg(F.min(F.when(F.col("upto") > F.col("_rest"), F.struct("_bin", (F.col("upto") - F.col("words")).alias("before")))).alias("end"))
        .select("_source", "source_size", "target", "_passes", "_rest", F.col("end._bin").alias("_end"), F.col("end.before").alias("_before"))
    )
    ends = materialize(ends, "ends")
    n_sources = ends.count()
    if n_sources <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("_source")))
    else:  # a hot source is spread over the salts
        salted = ends.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_key", "size"), F.lit(SALTS)).cast("int")).withColumnRenamed("_salt", "_salt_")
        rows = rows.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt_") == F.col("_salt")))
    edge = F.coalesce(F.col("_bin") == F.col("_end"), F.lit(False))
    whole = rows.filter(~edge).withColumn("_more", F.when(F.coalesce(F.col("_bin") < F.col("_end"), F.lit(True)) & (F.col("_rest") > 0), F.lit(1)).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    # the end bin: one of at least BINS of a source, so its window is small
    part = rows.filter(edge).withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    gap = F.col("_rest") - F.col("_sum")
    part = part.withColumn("_more", F.when((F.col("_rest") > 0) & (gap > 0) & (F.col("size") <= gap * 2), F.lit(1)).otherwise(F.lit(0))).drop("_sum")
    out = whole.unionByName(part)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "size", "source_size", "target", (F.col("size") * (F.col("_passes") + F.col("_more"))).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(_q_id, _q) of labels (doc_id, quality): 2 where a label says good, 0.5 where it says bad, else 1."""
    q = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_q_id")).agg(F.max("quality").alias("v"))
    return q.select("_q_id", F.when(F.col("v") == 1, F.lit(2.0)).when(F.col("v") == 0, F.lit(0.5)).otherwise(F.lit(1.0)).alias("_q"))
