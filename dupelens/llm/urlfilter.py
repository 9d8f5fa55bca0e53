"""URL verdicts: stated rules first, else a path-template tree of each host.

A path's segments that vary (any with a digit, or very long) become wildcards, which leaves few shapes; the
pages are summed by (host, shape) before anything else. Level by level, as deep as a node has several shapes,
some support and labels (else its shapes are its templates), a node's branches of little support and without
labels become one wildcard branch. Branches of a node, however many, whose shares of bad labels don't differ
significantly are merged: those of equal counts are one bin, and bins are compared in order of their shares, so
that a task holds a node's distinct counts, not its branches. A template, the path of merged branches down to a
leaf, is rejected if its smoothed purity - bad labels plus ``BAD_PRIOR``, over all labels plus both priors -
reaches ``REJECT``; templates without labels stay.

Labels: what a rule says; else, where html is given, what its text shows (``html_label``): much punctuation or few
distinct words are bad, a text of some length without either is good, any other says nothing. So labels vary
within a host, and a template stands for its pages that say nothing themselves.

Defined results: a null url, or one without ``://``, has an empty host and path and is a template of its own;
labels that are null don't count; a null or empty html says nothing; equal urls get equal verdicts; rows keep null and repeated ids; no rows
give no rows; further columns pass through, save those named like a result's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joins import spread_join, unused
from .common import materialize

SUPPORT = 2
#: Merged branches are named by all their segments up to this many; beyond, by the least one and their number.
NAMED = 32
BAD_PRIOR, GOOD_PRIOR = 1.0, 3.0
REJECT = 0.6
#: Tables of finished templates are written as one when there are so many.
PARTS = 16
#: A text is bad from this share of punctuation among its characters on, or this many distinct words over the root of all.
PUNCTUATION, DISTINCT = 0.1, 4.0
#: Words of a text that may be bad by its words, or good.
ENOUGH = 50
#: Two branches are alike up to this many standard errors between their shares.
ALIKE = 1.96
#: Templates are broadcast up to this many (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_TEMPLATES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("host", "path", "rule", "verdict")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits; ``rules``: (verdict, ``host/path``)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments, the variable ones as ``*``."""
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(s, lambda x: F.when(x.rlike(r"[0-9]") | (F.length(x) > 40), F.lit("*")).otherwise(x))


def html_label(html: Column) -> Column:
    """1 where a page's text is bad, 0 where it is good, null where it doesn't say."""
    # what isn't closed goes to the end, and a tag ends before the next: no start is scanned from twice
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|title)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"\s+", " "))
    words = F.split(F.lower(text), " ")
    punctuation = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / F.nullif(F.length(text), F.lit(0))
    enough = F.size(words) >= ENOUGH
    few = F.size(F.array_distinct(words)) < DISTINCT * F.sqrt(F.size(words))
    return F.when((punctuation >= PUNCTUATION) | (enough & few), F.lit(1)).when(enough, F.lit(0))


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bins of one node's branches with equal counts: similar ones get one group."""
    rate = pdf["bad"] / pdf["labels"].where(pdf["labels"] > 0)
    pdf = pdf.assign(rate=rate).sort_values(["rate", "labels"], na_position="last").reset_index(drop=True)
    group, n, a, of = -1, 0, 0, []
    for labels, bad, width in zip(pdf["labels"].tolist(), pdf["bad"].tolist(), pdf["width"].tolist(), strict=True):
        m, b = labels * width, bad * width
        if n == 0 or m == 0:
            same = group >= 0 and n == m
        else:
            p = (a + b + 1) / (n + m + 2)
            same = abs(a / n - b / m) <= ALIKE * (p * (1 - p) * (1 / n + 1 / m)) ** 0.5
        group, n, a = (group, n + m, a + b) if same else (group + 1, m, b)
        of.append(group)
    by = pdf.assign(group=of).groupby("group")
    pdf = pdf.assign(group=of, width=by["width"].transform("sum"), least=by["least"].transform("min"))
    return pdf[["host", "prefix", "labels", "bad", "group", "width", "least"]]


def _names(stats: DataFrame) -> DataFrame:
    """(host, prefix, seg, branch) of branches (host, prefix, seg, labels, bad); a literal segment has no digit, so no two names meet."""
    bins = stats.groupBy("host", "prefix", "labels", "bad").agg(F.count(F.lit(1)).alias("width"), F.min("seg").alias("least"))
    merged = materialize(bins.groupBy("host", "prefix").applyInPandas(_merge, "host string, prefix string, labels long, bad long, group long, width long, least string"), "merged")
    each = spread_join(stats, merged, ["host", "prefix", "labels", "bad"], BROADCAST_TEMPLATES)
    wide = F.col("width") > NAMED
    by = Window.partitionBy("host", "prefix", "group", F.when(wide, F.col("seg")))
    plain = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("%7C"))
    some = F.array_join(F.array_sort(F.collect_list(plain("seg")).over(by)), "|")
    many = F.concat(plain("least"), F.lit("|+"), (F.col("width") - 1).cast("string"))
    return each.select("host", "prefix", "seg", F.when(wide, many).otherwise(some).alias("branch"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity, rejected) of pages (host, path, label); label 1 is bad, 0 good, null unknown."""
    one = pages.select("host", shape(F.col("path")).alias("shape"), "label").groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad"))
    at, done, level = materialize(one.withColumn("prefix", F.lit("")), "shapes"), [], 0
    while True:
        level += 1
        deeper = F.size("shape") >= level
        nodes = at.filter(deeper).groupBy("host", "prefix").agg((F.count(F.lit(1)) > 1).alias("many"), F.sum("n").alias("pages"), F.sum("labels").alias("known"))
        nodes = nodes.filter(F.col("many") & (F.col("pages") >= SUPPORT) & (F.col("known") > 0)).select("host", "prefix", F.lit(True).alias("open"))
        nodes = materialize(nodes, "nodes")
        at = materialize(spread_join(at, nodes, ["host", "prefix"], BROADCAST_TEMPLATES, "left").withColumn("open", deeper & F.col("open").isNotNull()), "level")
        tail = F.array_join(F.slice("shape", F.lit(level), F.greatest(F.size("shape") - (level - 1), F.lit(0))), "/")
        done.append(at.filter(~F.col("open")).withColumn("prefix", F.when(deeper, F.concat("prefix", F.lit("/"), tail)).otherwise(F.col("prefix"))).drop("open"))
        if len(done) == PARTS:
            done = [materialize(reduce(DataFrame.unionByName, done), "done")]
        at = at.filter("open").drop("open").withColumn("seg", F.get("shape", F.lit(level - 1)))
        if at.isEmpty():
            break
        sums = at.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
        apart = (F.col("n") >= SUPPORT) | (F.col("labels") > 0)
        sums = materialize(sums.withColumn("as", F.when(apart, F.col("seg")).otherwise(F.lit("*"))), "sums")
        names = _names(sums.groupBy("host", "prefix", F.col("as").alias("seg")).agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")))
        names = materialize(names.withColumnRenamed("seg", "as"), "names")
        names = materialize(spread_join(sums.select("host", "prefix", "seg", "as"), names, ["host", "prefix", "as"], BROADCAST_TEMPLATES).drop("as"), "branches")
        at = materialize(spread_join(at, names, ["host", "prefix", "seg"], BROADCAST_TEMPLATES).withColumn("prefix", F.concat("prefix", F.lit("/"), "branch")).drop("seg", "branch"), "level")
    at = reduce(DataFrame.unionByName, done)
    total = at.groupBy("host", F.col("prefix").alias("template")).agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + BAD_PRIOR) / (F.col("labels") + BAD_PRIOR + GOOD_PRIOR)
    judged = materialize(total.select("host", "template", purity.alias("purity"), (purity >= REJECT).alias("rejected")), "judged")
    return spread_join(at.select("host", "shape", F.col("prefix").alias("template")), judged, ["host", "template"], BROADCAST_TEMPLATES)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], label: Column | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and template.

    ``label``: of a row with host, path and rule, 1 for bad, 0 for good, null for unknown, where no rule speaks.
    """
    pages = pages.drop(*RESULT, "template")
    host, path = parts(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    said = F.when(by_rule == "block", F.lit(1)).when(by_rule == "allow", F.lit(0))
    found = materialize(templates(rows.select("host", "path", (said if label is None else F.coalesce(said, label)).alias("label"))), "templates")
    of, bad = unused("shape", rows.columns), unused("rejected", rows.columns)
    found = found.select("host", F.col("shape").alias(of), "template", F.col("rejected").alias(bad))
    out = spread_join(rows.withColumn(of, shape(F.col("path"))), found, ["host", of], BROADCAST_TEMPLATES, "left", "path")
    verdict = F.coalesce(by_rule, F.when(F.col(bad), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*pages.columns, "host", "path", "rule", verdict.alias("verdict"), "template")
