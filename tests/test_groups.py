"""Selection, totals, plans, caches, journals and reports over small groups."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from dupelens.operators import cache as C
from dupelens.operators import select as S
from dupelens.operators import stats
from dupelens.plans import actions, journal, report


@pytest.fixture(scope="module")
def members(spark):
    rows = []
    for key, order, files in (("g1", 0, [("d1/a", 100, 1000.0), ("keep/bb", 100, 2000.0), ("d3/ccc", 100, 1500.0)]), ("g2", 5, [("x/long/p1", 50, 7.0), ("x/p2", 50, 7.0)])):
        for i, (path, size, t) in enumerate(files):
            rows.append((key, order, order, i, path, path.rsplit("/", 1)[-1], size, 0.0, t, "", "images" if key == "g1" else "other", "h", order + i))
    return spark.createDataFrame(rows, "group_key string, block_ord long, group_ord long, member_ord long, path string, name string, size long, created double, modified double, ext string, category string, hash string, walk_ord long")


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_rules(spark, members):
    want = {
        "first": {"keep/bb", "d3/ccc", "x/p2"}, "last": {"d1/a", "keep/bb", "x/long/p1"}, "newest": {"d1/a", "d3/ccc", "x/p2"}, "oldest": {"keep/bb", "d3/ccc", "x/p2"},
        "shortest": {"keep/bb", "d3/ccc", "x/long/p1"}, "all": {"keep/bb", "d3/ccc", "x/p2"}, "none": set(), "invert": {"keep/bb", "d3/ccc", "x/p2"},
    }
    for rule, gone in want.items():
        assert paths(S.select_members(members, rule)) == gone, rule
    assert paths(S.select_members(members, "priority", ["Keep/"])) == {"d1/a", "d3/ccc", "x/p2"}
    chosen = S.default_selection(members, True)
    assert paths(chosen) == {"keep/bb", "d3/ccc", "x/p2"} and S.default_selection(members, False).count() == 0
    assert paths(S.select_members(members, "invert", selection=chosen)) == {"d1/a", "x/long/p1"}
    big = members.withColumn("pixels", F.when(F.col("path") == "d3/ccc", 9).when(F.col("path") == "d1/a", 4))
    assert paths(S.select_members(big, "largest_res")) == {"d1/a", "keep/bb", "x/p2"}
    with pytest.raises(ValueError):
        S.select_members(members, "odd")


def test_selections_outside_the_view_vanish_on_invert(members):
    view = members.filter("group_key = 'g2'")
    assert paths(S.select_members(members, "invert", view=view, selection=members.filter("group_key = 'g1'"))) == {"x/p2"}


def test_groups_keep_one(spark, members):
    everything = members.select("path")
    assert S.endangered_groups(members, everything).first()[0] == 2
    assert S.endangered_groups(members, S.protect(members, everything)).first()[0] == 0


def test_zero_bytes_are_not_preselected(members):
    assert S.default_selection(members.withColumn("size", F.lit(0)), True).count() == 0


def test_view_filters_and_sorts(members):
    assert paths(S.filter_groups(members, category="images")) == {"d1/a", "keep/bb", "d3/ccc"}
    assert paths(S.filter_groups(members, search="KEEP")) == {"d1/a", "keep/bb", "d3/ccc"}
    assert paths(S.filter_groups(members, min_size=60)) == {"d1/a", "keep/bb", "d3/ccc"}
    assert paths(S.filter_groups(members, age="older", now=S.YEAR + 1999.0)) == {"x/long/p1", "x/p2"}
    assert paths(S.filter_groups(members, age="year", now=S.YEAR + 2000.0)) == {"d1/a", "keep/bb", "d3/ccc"}
    assert [r.group_key for r in S.sort_groups(members).collect()] == ["g1", "g2"]
    assert [r.group_key for r in S.page(S.sort_groups(members), 1, 1).collect()] == ["g2"]
    assert paths(S.remove_members(members, members.filter("path = 'x/p2'"))) == {"d1/a", "keep/bb", "d3/ccc"}


def test_totals(spark, members):
    assert stats.wasted_totals(members).first() == (2, 3, 250)
    assert {tuple(r) for r in stats.category_rollup(members).collect()} == {("all", 2, 250), ("images", 1, 200), ("other", 1, 50)}
    assert {(r.category, r.share) for r in stats.category_share(members).collect()} == {("images", 80.0), ("other", 20.0)}
    assert stats.wasted_totals(members.limit(0)).first() == (0, 0, 0)
    odd = spark.createDataFrame([("g", i, s) for i, s in enumerate([50, 80, 70])], "group_key string, member_ord long, size long").withColumn("category", F.lit("x"))
    assert stats.wasted_totals(odd).first()["wasted"] == 150


def now(members, changes=None):
    out = members.select("path", "size", "modified", F.lit(1).alias("dev"), F.col("walk_ord").alias("ino"), "hash")
    for path, column, value in changes or []:
        out = out.withColumn(column, F.when(F.col("path") == path, F.lit(value)).otherwise(F.col(column)))
    return out


def test_snapshots(members):
    later = now(members, [("keep/bb", "size", 7), ("d3/ccc", "modified", 1500.002), ("d1/a", "modified", 1000.0005)]).filter("path <> 'x/p2'")
    got = {r.path: r.reason for r in actions.verify_snapshot(actions.snapshot_of(members, members), later).collect()}
    assert got == {"keep/bb": "size", "d3/ccc": "mtime", "d1/a": None, "x/p2": "access", "x/long/p1": None}
    assert actions.delete_plan(members, members, later).agg(F.sum("freed")).first()[0] == 150


def test_hardlinks(members):
    changes = [("keep/bb", "hash", "other"), ("d3/ccc", "ino", 0), ("d1/a", "ino", 9), ("x/p2", "dev", 2)]
    got = {r.duplicate: (r.reason, r.freed) for r in actions.hardlink_plan(members, members, now(members, changes)).collect()}
    assert got == {"keep/bb": ("content-diff", 0), "d3/ccc": (None, 100), "x/p2": ("cross-volume", 0)}
    got = {r.duplicate: r.reason for r in actions.hardlink_plan(members, members, now(members, [("d3/ccc", "ino", 0)]).withColumn("ino", F.lit(4))).collect()}
    assert set(got.values()) == {"already-linked"}


def test_moves_never_collide(spark):
    rows = spark.createDataFrame([("g", i, p, 1, 1.0) for i, p in enumerate(["a/x.txt", "b/X.txt", "c/x.txt", "d/.hid", "e/n"])], "group_key string, member_ord long, path string, size long, modified double")
    there = spark.createDataFrame([("dest/x.txt", 1, 1.0), ("dest/x (2).txt", 1, 1.0)], "path string, size long, modified double").unionByName(rows.select("path", "size", "modified"))
    got = {r.src: r.dst for r in actions.move_plan(rows, rows, there, "dest/").collect()}
    assert got == {"a/x.txt": "dest/x (1).txt", "b/X.txt": "dest/X (3).txt", "c/x.txt": "dest/x (4).txt", "d/.hid": "dest/.hid", "e/n": "dest/n"}


def test_cache(spark):
    old = spark.createDataFrame([("a", 1, 10.0, "F", "T"), ("b", 1, 10.0, "F", None), ("c", 1, 10.0, "F", "T")], C.FILE_CACHE)
    inv = spark.createDataFrame([("a", 1, 10.0009), ("b", 1, 10.002), ("c", 2, 10.0), ("d", 1, 1.0)], "path string, size long, modified double")
    got = {r.path: (r.full_hash, r.turbo_hash) for r in C.cache_lookup(inv, old).collect()}
    assert got == {"a": ("F", "T"), "b": (None, None), "c": (None, None), "d": (None, None)}
    fresh = spark.createDataFrame([("a", 1, 10.0, None, "N"), ("b", 1, 10.0001, None, "N"), ("d", 4, 1.0, "X", None)], C.FILE_CACHE)
    got = {r.path: tuple(r)[1:] for r in C.cache_upsert(old, fresh).collect()}
    assert got == {"a": (1, 10.0, "F", "N"), "b": (1, 10.0001, None, "N"), "c": (1, 10.0, "F", "T"), "d": (4, 1.0, "X", None)}
    assert C.cache_stats(old, fresh).first() == (3, 3) and C.cleared(old).count() == 0


def test_warm_cache_hashes_nothing(spark, files):
    inv = files([("a", b"1", 1), ("b", b"1", 1)])
    _, table = C.incremental_hashes(inv, spark.createDataFrame([], C.FILE_CACHE))
    unreadable = inv.withColumn("content", F.lit(None).cast("binary"))
    hashes, _ = C.incremental_hashes(unreadable, table)
    assert hashes.filter("full_hash IS NULL").count() == 0


def test_journal(spark):
    plan = spark.createDataFrame([("a", 3), ("b", 4)], "path string, freed long")
    j = spark.createDataFrame([], journal.JOURNAL)
    for t in range(3):
        j = journal.journal_append(j, journal.entry_of(plan, "delete" if t else "move", t, trash=F.lit(t == 1)))
    rows = j.collect()
    assert [r.ts for r in rows] == [2.0, 1.0, 0.0] and len({r.id for r in rows}) == 3 and rows[0].paths == ["a", "b"] and rows[0].freed_bytes == 7
    fixed = spark.createDataFrame(rows, j.schema)
    assert {r.ts for r in journal.undo_eligible(fixed).collect()} == {0.0, 1.0}
    results = spark.createDataFrame([(rows[1].id, 0), (rows[2].id, 1)], "id string, errors int")
    assert {r.ts for r in journal.mark_undone(fixed, results).filter("undone").collect()} == {1.0}
    assert journal.entry_of(plan.limit(0), "delete", 1.0).count() == 0
    overview = journal.undo_overview(fixed, spark.createDataFrame([("a",)], "path string")).collect()
    assert [(r.paths, r.restorable) for r in overview] == [(2, 1)] * 3


def test_history(spark):
    h = spark.createDataFrame([(f"2024-01-{d:02d} 10:00", ["x"], 1, d) for d in range(1, 31)], journal.HISTORY)
    more = spark.createDataFrame([("2024-02-01 10:00", ["x"], 2, 100), ("2024-02-02 10:00", ["x"], 0, 0)], journal.HISTORY)
    out = journal.history_append(h, more)
    assert out.count() == 30 and journal.history_total(out).first()[0] == 100 + sum(range(2, 31))


def test_restoring(spark):
    entries = spark.createDataFrame([("C:/a", "r1", 5, 1.0, False, True), ("C:/A", "r2", 5, 2.0, False, True), ("C:/d", "r3", 5, 1.0, True, True), ("C:/n", "", 5, 1.0, False, False), ("C:/x", "r5", 5, 1.0, False, True)],
                                    "original_path string, data_path string, size long, deleted_ts double, is_directory boolean, data_exists boolean")
    wanted = spark.createDataFrame([(p,) for p in ("c:/a", "C:/d", "C:/n", "C:/x", "C:/m", "C:/here")], "path string")
    there = spark.createDataFrame([("C:/x", 1), ("C:/here", 1)], "path string, size long")
    got = {r.path: (r.state, r.data_path) for r in journal.restore_plan(wanted, entries, there).collect()}
    assert got == {"c:/a": ("ready", "r2"), "C:/d": ("directory", "r3"), "C:/n": ("no-data", ""), "C:/x": ("conflict", "r5"), "C:/m": ("missing", None), "C:/here": ("restored", None)}
    assert paths(journal.restorable_paths(wanted, entries)) == {"c:/a", "C:/d", "C:/n", "C:/x"}


def test_reports(members, tmp_path):
    odd = members.withColumn("name", F.when(F.col("path") == "d1/a", "<a> & \"b\"").otherwise(F.col("name")))
    for kind in ("csv", "json", "txt", "html"):
        report.export(odd, str(tmp_path / f"r.{kind}"), kind)
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines()))
    assert rows[0] == report.HEADER and len(rows) == 6 and rows[1][1] == '<a> & "b"' and rows[1][5] == "1970-01-01 00:16:40"
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["total_groups"] == 2 and data["wasted_space"] == 250 and [f["path"] for f in data["groups"]["g2"]] == ["x/long/p1", "x/p2"]
    assert "=== Group: g1 (3 files, 100 B each) ===" in (tmp_path / "r.txt").read_text()
    html = (tmp_path / "r.html").read_text()
    assert "&lt;a&gt; &amp; &quot;b&quot;" in html and "200 B reclaimable" in html
    with pytest.raises(ValueError):
        report.export(odd, str(tmp_path / "r.odd"), "odd")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.csv", "r.html", "r.json", "r.txt"]


def test_first_errors_are_a_bounded_top_k(spark):
    rows = [(None if i == 9 else f"/{i:04}", None if i == 8 else i % 2 == 0, i, f"e{i}") for i in range(3000)] + [("/0001", False, 7, None)]
    got = stats.action_summary(spark.createDataFrame(rows[::-1], "path string, ok boolean, freed long, error string"))
    assert tuple(got.first()) == (1499, 1501, sum(range(0, 3000, 2)) - 8, ["e9", None, "e1", "e3", "e5"])
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "path string, ok boolean, freed long, error string")
    assert tuple(stats.action_summary(empty).first()) == (0, 0, 0, [])
