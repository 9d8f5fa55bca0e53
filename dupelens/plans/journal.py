"""The operation journal and the scan history, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = "struct<src:string,dst:string>"
RESULT = "struct<restored:int,errors:array<string>,ts:double>"
JOURNAL = f"id string, type string, ts double, paths array<string>, freed_bytes long, details struct<trash:boolean,destination:string,pairs:array<{PAIR}>,restore_result:{RESULT}>, undone boolean"
HISTORY = "date string, folders array<string>, duplicates long, wasted long"
KEPT_OPERATIONS, KEPT_SCANS, SHOWN = 100, 30, 10


def newest(rows: DataFrame, by: str = "ts", k: int = SHOWN, tie: str = "id") -> DataFrame:
    """The k newest rows, newest first."""
    return rows.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def journal_append(journal: DataFrame, entry: DataFrame) -> DataFrame:
    """The journal with new entries (without id): each gets one; only the newest are kept."""
    new = entry.withColumn("id", F.expr("uuid()")).withColumn("undone", F.lit(False))
    return newest(journal.unionByName(new.select(*journal.columns)), k=KEPT_OPERATIONS)


def entry_of(plan: DataFrame, kind: str, now: float, **details) -> DataFrame:
    """One entry of the rows (path, freed) of a plan that succeeded; none if none did. ``details`` are Columns."""
    null = {"trash": "boolean", "destination": "string", "pairs": f"array<{PAIR}>", "restore_result": RESULT}
    d = F.struct(*[details.get(k, F.lit(None)).cast(t).alias(k) for k, t in null.items()])
    one = plan.agg(F.array_sort(F.collect_list("path")).alias("paths"), F.coalesce(F.sum("freed"), F.lit(0)).cast("long").alias("freed_bytes"))
    return one.filter(F.size("paths") > 0).select(F.lit(kind).alias("type"), F.lit(float(now)).alias("ts"), "paths", "freed_bytes", d.alias("details"))


def link_pairs(plan: DataFrame, succeeded: DataFrame) -> DataFrame:
    """(src, dst) of a link plan (original, duplicate) whose duplicates are among ``succeeded`` (path)."""
    done = succeeded.select(F.col("path").alias("duplicate")).distinct()
    return plan.join(done, "duplicate", "left_semi").select(F.col("original").alias("src"), F.col("duplicate").alias("dst"))


def pairs_column(pairs: DataFrame) -> DataFrame:
    """One row: the pairs of one operation as the journal's array, in order of their targets."""
    return pairs.agg(F.array_sort(F.collect_list(F.struct("dst", "src"))).alias("_p")).select(F.transform("_p", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("pairs"))


def history_append(history: DataFrame, entry: DataFrame) -> DataFrame:
    """The history with a scan that found something; the newest scans are kept."""
    return newest(history.unionByName(entry.filter("duplicates > 0").select(*history.columns)), "date", KEPT_SCANS, "date")


def history_total(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def latest_per_key(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The newest row of each key, by one map-side aggregate: no window, so a hot key makes no large task."""
    rest = [c for c in rows.columns if c not in (key, by, tie)]
    best = rows.groupBy(key).agg(F.max(F.struct(by, tie, *rest)).alias("_r"))
    return best.select(key, F.col(f"_r.{by}").alias(by), F.col(f"_r.{tie}").alias(tie), *[F.col(f"_r.{c}").alias(c) for c in rest])


def undo_eligible(journal: DataFrame) -> DataFrame:
    """Operations that can be undone: moves, links, and deletions into the bin; not those undone already."""
    return journal.filter(~F.col("undone") & (F.col("type").isin("move", "hardlink") | ((F.col("type") == "delete") & F.coalesce("details.trash", F.lit(False)))))


def undo_pairs(journal: DataFrame, op_id: str) -> DataFrame:
    """(src, dst) of an operation that undoing moves back or splits, last first."""
    one = undo_eligible(journal).filter(F.col("id") == op_id)
    return one.select(F.posexplode("details.pairs")).orderBy(F.col("pos").desc()).select("col.src", "col.dst")


def mark_undone(journal: DataFrame, results: DataFrame) -> DataFrame:
    """The journal after undoing ``results`` (id, errors): an operation is undone only if it left no error."""
    fine = results.groupBy("id").agg((F.sum("errors") == 0).alias("_fine"))
    return journal.join(fine, "id", "left").withColumn("undone", F.col("undone") | F.coalesce("_fine", F.lit(False))).select(*journal.columns)


def undo_overview(journal: DataFrame, restorable: DataFrame, k: int = SHOWN) -> DataFrame:
    """The newest operations with how many of their paths the bin can give back."""
    top = newest(journal, k=k)
    back = top.select("id", F.explode("paths").alias("path")).join(restorable.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("restorable"))
    return top.join(back, "id", "left").select("id", "type", "ts", "undone", F.size("paths").cast("long").alias("paths"), F.coalesce("restorable", F.lit(0)).cast("long").alias("restorable"))


def restore_plan(wanted: DataFrame, entries: DataFrame, existing: DataFrame) -> DataFrame:
    """path, data_path and state of wanted paths (path, size) from the bin's entries, newest first.

    restored: already in place with the same size; missing: no entry; directory, no-data, conflict: refused;
    ready: to be moved back.
    """
    from ..functions.expr import path_key

    w = Window.partitionBy("_key").orderBy(F.col("deleted_ts").desc(), "data_path")
    last = entries.withColumn("_key", path_key(F.col("original_path"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    there = existing.select(path_key(F.col("path")).alias("_key"), F.col("size").alias("_there")).dropDuplicates(["_key"])
    rows = wanted.withColumn("_key", path_key(F.col("path"))).join(last.select("_key", "data_path", F.col("size").alias("_size"), "is_directory", "data_exists"), "_key", "left").join(there, "_key", "left")
    state = (
        F.when(F.col("_there").isNotNull() & F.col("data_path").isNull(), "restored").when(F.col("data_path").isNull(), "missing").when(F.col("is_directory"), "directory")
        .when(~F.col("data_exists"), "no-data").when(F.col("_there").isNotNull(), "conflict").otherwise("ready")
    )
    return rows.select("path", "data_path", state.alias("state"))


def restorable_paths(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of ``paths`` that the bin has."""
    from ..functions.expr import path_key

    keys = entries.select(path_key(F.col("original_path")).alias("_key")).distinct()
    return paths.withColumn("_key", path_key(F.col("path"))).join(keys, "_key", "left_semi").drop("_key")
