"""Reports over all groups: rows for CSV, and JSON, text and HTML documents.

``json_groups`` and the like give a group a row, for pages of groups that people look at. ``export`` writes all groups
to one file: a row is a member, so a group of any size is written, and ranges of rows are rendered side by side.
"""

from __future__ import annotations

import csv
import io
import os
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import human_size, time_text
from ..operators.stats import wasted_totals
from ..session import shared_folder

HEADER = ["Group", "File Name", "Path", "Size (bytes)", "Size (formatted)", "Modified", "Category"]
ORDER = ("block_ord", "group_ord")


def export_rows(members: DataFrame) -> DataFrame:
    """A row a member with the report's columns, times in the session's zone."""
    return members.select(
        F.col("group_key").alias("group"), F.col("name").alias("file_name"), "path", F.col("size").alias("size_bytes"), human_size(F.col("size")).alias("size_formatted"),
        time_text(F.col("modified")).alias("modified"), "category",
    )


def _by_group(members: DataFrame, member: Column) -> DataFrame:
    """group_key, the order columns, n, first size, wasted and ``rows``: ``member`` of each, in member order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("member_ord", member.alias("v")))), lambda x: x["v"])
    return members.groupBy("group_key", *ORDER).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("member_ord") == 0, F.col("size"))).alias("first_size"),
        F.coalesce(F.sum(F.when(F.col("member_ord") > 0, F.col("size"))), F.lit(0)).alias("wasted"), rows.alias("rows"),
    )


def _json_line() -> Column:
    return F.struct("name", "path", "size", "modified", "category")


def json_groups(members: DataFrame) -> DataFrame:
    """group_key, the order columns, wasted, and ``files``: a JSON array of name, path, size, modified, category."""
    g = _by_group(members, _json_line())
    return g.select("group_key", *ORDER, "wasted", F.to_json("rows").alias("files"))


def _text_line() -> Column:
    return F.concat(F.lit("  - "), "path", F.lit(" ("), human_size(F.col("size")), F.lit(")"))


def _text_head() -> Column:
    return F.concat(F.lit("=== Group: "), "group_key", F.lit(" ("), F.col("n").cast("string"), F.lit(" files, "), human_size(F.col("first_size")), F.lit(" each) ==="))


def text_groups(members: DataFrame) -> DataFrame:
    """group_key, the order columns and ``body``: a headline and a line a member."""
    g = _by_group(members, _text_line())
    return g.select("group_key", *ORDER, F.concat_ws("\n", F.array(_text_head()), F.col("rows")).alias("body"))


def html_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _html_line() -> Column:
    cells = [html_text(F.col("name")), html_text(F.col("path")), human_size(F.col("size")), time_text(F.col("modified")), F.col("category")]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _html_head() -> Column:
    return F.concat(F.lit('<tr class="group"><th colspan="5">'), html_text(F.col("group_key")), F.lit(" &middot; "), F.col("n").cast("string"), F.lit(" files &middot; "), human_size(F.col("wasted")), F.lit(" reclaimable</th></tr>"))


def html_groups(members: DataFrame) -> DataFrame:
    """group_key, the order columns and ``body``: table rows, with the bytes that each group would give back."""
    g = _by_group(members, _html_line())
    return g.select("group_key", *ORDER, F.concat_ws("\n", F.array(_html_head()), F.col("rows")).alias("body"))


def _csv_line() -> Column:
    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    row = [F.col("group_key"), F.col("name"), F.col("path"), F.col("size"), human_size(F.col("size")), time_text(F.col("modified")), F.col("category")]
    return F.concat_ws(",", *map(cell, row))


def _json_text(c: Column) -> Column:
    """As a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def rendered(members: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """(the report's order and ``text``, a row a member; what stands between rows): a group of any size is as many rows."""
    totals = members.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("member_ord") == 0, F.col("size"))).alias("first_size"),
        F.coalesce(F.sum(F.when(F.col("member_ord") > 0, F.col("size"))), F.lit(0)).alias("wasted"),
    )
    rows, first = members.join(totals, "group_key"), F.col("member_ord") == 0
    if kind == "csv":
        text, between = _csv_line(), "\r\n"
    elif kind == "json":
        last = F.when(F.col("member_ord") == F.col("n") - 1, "]").otherwise("")
        text, between = F.concat(F.when(first, F.concat(F.lit(" "), _json_text(F.col("group_key")), F.lit(": ["))).otherwise(""), F.to_json(_json_line()), last), ","
    elif kind in ("txt", "html"):
        head, line = (_text_head(), _text_line()) if kind == "txt" else (_html_head(), _html_line())
        before = F.lit("\n" if kind == "txt" else "")
        text, between = F.concat(F.when(first, F.concat(before, head, F.lit("\n"))).otherwise(""), line), "\n"
    else:
        raise ValueError(f"no such format: {kind}")
    return rows.select(*ORDER, "group_key", "member_ord", text.alias("text")), between


def _ends(kind: str, total: Row) -> tuple[str, str]:
    """What stands before and after the rows."""
    if kind == "csv":
        line = io.StringIO()
        csv.writer(line).writerow(HEADER)
        return "\ufeff" + line.getvalue(), ""
    if kind == "json":
        return f'{{"total_groups": {total["groups"]}, "wasted_space": {total["wasted"]}, "groups": {{', "}}"
    if kind == "txt":
        return f"Duplicate report\nGroups: {total['groups']}\nReclaimable bytes: {total['wasted']}\n", ""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Duplicate report</title></head><body><h1>{total["groups"]} groups</h1><table>\n', "</table></body></html>\n"


def export(members: DataFrame, path: str, kind: str) -> None:
    """Write one local file: csv (UTF-8 with mark), json, txt or html. The file appears whole or not at all.

    Executors render the ranges of the report's order and write them side by side; the driver joins their files in
    order, as bytes, and no row passes it.
    """
    spark = members.sparkSession
    rows, between = rendered(members, kind)
    order = [*ORDER, "group_key", "member_ord"]
    parts = f"{shared_folder(spark)}/parts"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.option("lineSep", between).text(parts)
    head, foot = _ends(kind, wasted_totals(members).first())
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8", newline="") as f:
            f.write(head)
        start = os.path.getsize(tmp)
        _append(spark, parts, tmp, skip=1 if kind == "json" else 0)  # the first group needs no space before it
        if kind == "json" and os.path.getsize(tmp) > start:
            os.truncate(tmp, os.path.getsize(tmp) - len(between))
        with open(tmp, "a", encoding="utf-8", newline="") as f:
            f.write(foot)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def _append(spark: SparkSession, folder: str, path: str, skip: int) -> None:
    """Append the files of ``folder`` in order to a local file, without the first ``skip`` bytes, through the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    found = sorted((s.getPath().getName(), s) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen())
    out = jvm.java.io.FileOutputStream(path, True)
    try:
        for k, (_, status) in enumerate(found):
            part = fs.open(status.getPath())
            try:
                if k == 0:
                    part.seek(skip)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
