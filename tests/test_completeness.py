"""Operators without a registered query, and rows that the driver's tables don't have."""

import itertools
import os
import random
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupelens import joins
from dupelens.cancel import Cancelled, cancellable
from dupelens.functions import expr as X
from dupelens.functions.python_udfs import grey_grid, link_candidates, link_may_mean, parse_bin_record, pixels
from dupelens.operators import cache as C
from dupelens.operators import dedup as D
from dupelens.operators import diff, filters, similar, sweep
from dupelens.plans import actions, journal
from dupelens.sources import inventory as I
from dupelens.sources import stores, tree


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


# ---- joins and numbering ----


def test_spread_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(300)] + [(None, 5), (9, 6)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c"), (None, "n")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = rows(left.join(right, "k", how))
        assert rows(joins.spread_join(left, right, ["k"], 100, how)) == want
        assert rows(joins.spread_join(left, right, ["k"], 0, how, by="v")) == want
    clash = joins.spread_join(left.withColumn("salt", F.lit(1)), right, ["k"], 0)
    assert clash.columns == ["k", "v", "salt", "w"] and clash.count() == 201


def test_numbers_are_those_of_one_window(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "v int, part string").repartition(5)
    got = joins.numbered(df, ["v"], "n")
    assert got.columns == ["v", "part", "n"] and all(r.n == r.v for r in got.collect())
    assert joins.numbered(df.limit(0), ["v"], "n").count() == 0
    plan = actions.chunked(spark.createDataFrame([(f"p{i:04d}",) for i in range(450)], "path string"))
    assert sorted((r.path, r.chunk) for r in plan.collect()) == [(f"p{i:04d}", i // 200) for i in range(450)]


# ---- duplicates ----


def test_contents_cross_no_shuffle(spark, files):
    inv = files([("/a/x", b"1" * 50, 1), ("/a/y", b"1" * 50, 2), ("/b/z", b"2" * 50, 3)])
    cache = spark.createDataFrame([("/a/x", 50, 1.0, "known", None)], C.FILE_CACHE)
    for df in (D.find_duplicates(inv), C.incremental(inv, cache)):  # what they return was written without contents
        assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    side = diff._side(inv.withColumn("rel_path", F.col("name")), True, "a")._jdf.queryExecution().executedPlan()
    moved = [node for node in (side.collectLeaves().apply(i) for i in range(side.collectLeaves().size()))]
    assert moved and all("content" not in line for line in side.toString().splitlines() if "Exchange" in line)
    window = next(line for line in side.toString().splitlines() if "Sort [" in line)
    assert "content" not in window


def test_a_group_of_very_many(spark):
    n = 100_000
    inv = spark.range(n).select(
        F.concat(F.lit("/d/"), F.col("id").cast("string"), F.lit("/same.txt")).alias("path"), F.lit("same.txt").alias("name"), F.lit(5).cast("long").alias("size"), F.lit(0.0).alias("created"), F.col("id").cast("double").alias("modified"),
        F.lit(1).cast("long").alias("dev"), F.lit(0).cast("long").alias("ino"), F.col("id").alias("walk_ord"), F.lit(".txt").alias("ext"), F.lit("documents").alias("category"), F.when(F.col("id") % 3 == 0, b"hello").otherwise(F.encode(F.lpad(F.col("id").cast("string"), 5, "0"), "UTF-8")).alias("content"),
    )
    got = D.find_duplicates(inv, D.Criteria(by_name=True, turbo=False))
    assert got.agg(F.count(F.lit(1)), F.max("member_ord"), F.countDistinct("group_key")).first() == (33_334, 33_333, 1)
    byte = D.find_duplicates(inv, D.Criteria(by_size=False, by_hash=False, by_byte=True))
    assert byte.select("group_key").distinct().collect()[0][0] == "_b0"
    sel = got.filter("member_ord > 0").select("path")
    plan = actions.move_plan(got, sel, inv, "/dest")
    assert plan.select("dst").distinct().count() == 33_333 and plan.filter("dst = '/dest/same (33332).txt'").count() == 1


def test_moves_step_over_taken_numbers(spark, files):
    there = files([(f"/dest/{n}", b"z", 1) for n in ("a.txt", "a (2).txt", "A (3).txt", "b (1).txt", "c.txt")])
    inv = files([(f"/d{k}/{n}", b"same", 1) for k in range(4) for n in ("a.txt", "b.txt")])
    got = D.find_duplicates(inv, D.Criteria(by_hash=False)).filter("member_ord > 0")
    plan = actions.move_plan(got, got.select("path"), inv.unionByName(there.withColumn("walk_ord", F.col("walk_ord") + 100)), "/dest/")
    by = {}
    for src, dst in sorted((r.src, r.dst) for r in plan.collect()):
        by.setdefault(src[-5:], []).append(dst.removeprefix("/dest/"))
    assert by["a.txt"] == ["a (1).txt", "a (4).txt", "a (5).txt"] and by["b.txt"] == ["b.txt", "b (2).txt", "b (3).txt", "b (4).txt"]


def test_incremental_ways_agree(spark, files, monkeypatch):
    inv = files([(f"/a/{i}", bytes([i % 5]) * 10, i) for i in range(40)])
    cache = inv.filter("walk_ord % 2 = 0").select("path", (F.col("size") + F.when(F.col("walk_ord") % 3 == 0, 1).otherwise(0)).alias("size"), F.col("modified").alias("mtime"), F.concat(F.lit("c"), F.col("walk_ord").cast("string")).alias("full_hash"), F.lit(None).cast("string").alias("turbo_hash"))
    want = [(f"/a/{i}", f"c{i}" if i % 2 == 0 and i % 3 else __import__("hashlib").sha256(bytes([i % 5]) * 10).hexdigest()) for i in range(40)]
    for bound in (1000, 30, 0):  # known sent; few left sent; all hashed in place
        monkeypatch.setattr(C, "BROADCAST_KNOWN", bound)
        hashes, table = C.incremental_hashes(inv, cache)
        assert rows(hashes) == sorted(want, key=repr)
        assert table.count() == 40


def test_trees_are_read_as_little_as_may_be(spark, tmp_path):
    r = random.Random(1)
    big = r.randbytes(200_000)
    contents = {"a/1": big, "b/2": big, "b/3": big[:-1] + b"x", "c/4": big[:100_000] + b"y" + big[100_001:], "c/5": b"one", "c/6": b"one", "d/7": b"only this size", "d/8": b"", "e/u:v": b"one"}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for c in (D.Criteria(), D.Criteria(turbo=False), D.Criteria(by_hash=False, by_byte=True)):
        found = tree.fingerprints(spark, [str(tmp_path)], c)
        assert found.filter("name = '7'").first().full is None
        got = D.find_duplicates(found, c)
        want = D.find_duplicates(tree.scan_tree(spark, [str(tmp_path)]), c)
        assert rows(got) == rows(want) and got.count() == 5
    half = tree.fingerprints(spark, [str(tmp_path)]).filter("path LIKE '%/a/%' OR path LIKE '%/c/%'").select("path", F.col("full").alias("full_hash"))
    assert rows(D.find_duplicates(tree.fingerprints(spark, [str(tmp_path)], known=half))) == rows(D.find_duplicates(tree.scan_tree(spark, [str(tmp_path)])))
    turbo = tree.scan_tree(spark, [str(tmp_path)]).select(X.turbo_hash(F.col("content"), F.col("size")).alias("a"), tree.partial_digest("path", "size", F.lit(65536)).alias("b"))
    assert all(x.a == x.b for x in turbo.collect())
    odd = tmp_path / "with:colon"
    odd.mkdir()
    (odd / "f").write_bytes(b"1")
    assert tree.scan_tree(spark, [str(odd), str(tmp_path / "missing")]).count() == 1


def test_roots_one_after_another(spark, files):
    a, b = files([("/r1/x", b"same", 5)]), files([("/r2/y", b"same", 1), ("/r2/z", b"same", 1)])
    both = I.union(a, b)
    assert [r.path for r in both.orderBy("walk_ord").collect()] == ["/r1/x", "/r2/y", "/r2/z"] and both.select("walk_ord").distinct().count() == 3
    assert I.union(a).count() == 1


# ---- paths and small functions ----


def test_paths_with_parents(spark):
    cases = {"/a/b/../c": "/a/c", "/../a": "/a", "a/../../b": "../b", "C:\\X\\..\\Y": "c:/y", "C:/../x": "c:/x", "/a/..": "/", "a/..": "", "..": "..", "/a/..b/c..": "/a/..b/c..", "/a/b/../../..": "/", "/a//./b/.": "/a/b", "": "", "/": "/"}
    assert column(spark, list(cases), "string", X.path_key) == list(cases.values())
    folders = spark.createDataFrame([(x,) for x in (" /B/ ", "/b", "", None, "/a/../c", "  ")], "prefix string")
    assert [r.prefix for r in filters.normalize_folders(folders).collect()] == ["/b", "/c"]


def test_binary_contents(spark):
    values = [b"", b"text", b"a\0b", b"x" * 1023 + b"\0", b"x" * 1024 + b"\0", None]
    assert column(spark, values, "binary", X.is_binary) == [False, False, True, True, False, True]


def png(grey):
    h, w = grey.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), grey], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def bmp(w, h):
    return b"BM" + bytes(16) + struct.pack("<ii", w, h) + bytes(20)


def test_pictures(spark):
    slope = np.tile(np.arange(256, dtype=np.uint8), (128, 1))
    values = [png(slope), png(slope[:, ::-1]), bmp(3, -4), b"GIF89a" + struct.pack("<HH", 7, 9), b"none", b"", None]
    assert column(spark, values, "binary", pixels) == [256 * 128, 256 * 128, 12, 63, None, None, None]
    grids = column(spark, values, "binary", grey_grid)
    assert grids[2:] == [None] * 5
    try:
        import PIL  # noqa: F401
    except ImportError:
        pytest.skip("pictures are decoded by Pillow only")
    assert [len(g) for g in grids[:2]] == [72, 72] and grids[0][0] < grids[0][8]
    got = similar.fingerprints(spark.createDataFrame([(1, grids[0]), (2, grids[1])], "id long, grid array<int>")).orderBy("id").collect()
    assert [r.hash for r in got] == ["0" * 16, "f" * 16]


# ---- shortcuts and bins ----


def link(target, end=b"\0", flags=2, info=1, at=28, ids=b""):
    body = target + end
    return b"\x4c\0\0\0" + bytes(16) + struct.pack("<I", flags) + bytes(0x4C - 24) + ids + struct.pack("<5I", 28 + len(body), 28, info, 0, at) + bytes(8) + body


def test_shortcuts(spark):
    assert link_may_mean(link(b"C:/a")) == ["C:/a"] and link_may_mean(link(b"C:/a", end=b"")) == []
    assert link_may_mean(link("C:/é".encode())) == ["C:/Ã©", "C:/é"] and link_may_mean(link("C:/é".encode("cp1252"))) == ["C:/é"]
    assert link_may_mean(link(b"C:/a", flags=3, ids=struct.pack("<H", 3) + b"xyz")) == ["C:/a"]
    assert [link_may_mean(x) for x in (link(b"C:/a", flags=0), link(b"C:/a", info=0), link(b"C:/a", at=0), link(b"C:/a", at=500), link(b"C:/a")[:80], b"", None)] == [[]] * 7
    links = spark.createDataFrame([("/l/1", link("C:/é".encode())), ("/l/2", link("C:/ü".encode())), ("/l/3", link(b"C:/a")[:50])], "path string, content binary")
    there = spark.createDataFrame([("c:\\É",)], "path string")
    assert rows(sweep.link_targets(links, there)) == [("/l/1", "C:/é"), ("/l/2", "C:/Ã¼"), ("/l/3", None)]
    assert column(spark, [link(b"C:/a"), None], "binary", link_candidates) == [["C:/a"], []]


def record(path, version=2, size=10, ts=100, n=None):
    head = struct.pack("<qqq", version, size, 116444736000000000 + ts * 10_000_000)
    return head + (struct.pack("<i", len(path) + 1 if n is None else n) + path.encode("utf-16-le") + b"\0\0" if version == 2 else path.encode("cp1252").ljust(256, b"\0"))


def test_bin_records():
    assert parse_bin_record(record("C:\\a.txt")) == ("C:\\a.txt", 10, 100.0) and parse_bin_record(record(" C:/ü ", 1)) == ("C:/ü", 10, 100.0)
    assert parse_bin_record(record("C:/a", n=500))[0] == "C:/a" and parse_bin_record(record("C:/abc")[:34])[0] == "C:/"
    assert parse_bin_record(record("C:/a\ud800".encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")))[0].startswith("C:/a")
    assert parse_bin_record(struct.pack("<qqq", 1, 5, 116444736000000000) + b"C:/s")[0] == "C:/s"
    assert [parse_bin_record(x) for x in (record("", 2), record("x", 3), record("x", n=-1), record("x", n=0), record("C:/a")[:27], b"", None)] == [None] * 7


def test_bins_are_read_with_one_level(spark, tmp_path):
    for name, data in {"$Iaa.txt": record("C:/x/a.txt"), "$Raa.txt": b"x", "S-1/$IBB": record("C:/x/b", ts=200), "S-1/$rbb/in": b"", "S-1/deep/$Icc": record("C:/c"), "$Rdir/$Idd": record("C:/d"), "S-1/$Iee": record("C:/e"), "S-1/$I": record("C:/f"), "S-1/$Rff": b"", "note.txt": b"?"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.original_path: (os.path.relpath(r.data_path, tmp_path) if r.data_path else "", r.is_directory, r.data_exists) for r in stores.scan_bins(spark, [str(tmp_path), "/no/such/bin"]).collect()}
    assert got == {"C:/x/a.txt": ("$Raa.txt", False, True), "C:/x/b": ("S-1/$rbb", True, True), "C:/e": ("", False, False), "C:/f": ("", False, False)}
    assert stores.bin_roots(["C:/", "D:"]) == ["C:/$Recycle.Bin", "C:/RECYCLER", "D:/$Recycle.Bin", "D:/RECYCLER"]


def test_stores_on_any_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/store.json"
    table = spark.createDataFrame([("1", 2.5), ("é", None)], "id string, ts double")
    for _ in range(2):
        stores.write_json(table, path)
        assert rows(stores.read_json(spark, path, "id string, ts double")) == rows(table)
    assert rows(stores.read_json(spark, f"{tmp_path}/store.json", "id string")) == [("1",), ("é",)]
    for bad in ("", "{}", '{"id": "1"}', "[{", "nothing"):
        (tmp_path / "bad.json").write_text(bad)
        assert stores.read_json(spark, f"{tmp_path}/bad.json", "id string").count() == 0
    assert stores.read_json(spark, f"{tmp_path}/none.json", "id string").columns == ["id"]
    table.write.parquet(f"{tmp_path}/t")
    assert C.table_bytes(spark, f"file://{tmp_path}/t") > 0


# ---- sweeping, journal, pictures' cache ----


def test_empty_folders_are_reported_against_the_walk(spark, files):
    dirs = spark.createDataFrame([("/r", 0), ("/r/a", 1), ("/r/a/b", 2), ("/r/a/b/c", 3), ("/r/d", 4)], "path string, walk_ord long")
    got = sweep.report_order(sweep.empty_dirs(dirs, files([("/r/d/f", b"1", 1)]), ["/r"]))
    assert [r.path for r in got.collect()] == ["/r/a/b/c", "/r/a/b", "/r/a"]


def test_journal_pairs_and_undo(spark):
    plan = spark.createDataFrame([("/o", "/d2"), ("/o", "/d1"), ("/p", "/d3")], "original string, duplicate string")
    pairs = journal.link_pairs(plan, spark.createDataFrame([("/d1",), ("/d2",), ("/d2",)], "path string"))
    assert rows(pairs) == [("/o", "/d1"), ("/o", "/d2")]
    done = spark.createDataFrame([("/d1", 5), ("/d2", 6)], "path string, freed long")
    details = [tuple(p) for p in journal.pairs_column(pairs).first().pairs]
    entry = journal.entry_of(done, "hardlink", 9.0, pairs=F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in details]))
    book = journal.journal_append(spark.createDataFrame([], journal.JOURNAL), entry)
    one = book.first()
    assert one.freed_bytes == 11 and one.paths == ["/d1", "/d2"]
    kept = spark.createDataFrame([one], journal.JOURNAL)
    assert [tuple(r) for r in journal.undo_pairs(kept, one.id).collect()] == [("/o", "/d2"), ("/o", "/d1")]
    assert journal.undo_pairs(kept, "other").count() == 0


def test_picture_cache_and_parents(spark, files):
    old = spark.createDataFrame([("/a", 1, 1.0, "x", None), ("/b", 2, 2.0, "y", "z")], C.IMAGE_CACHE)
    new = spark.createDataFrame([("/b", 3, 3.0, None, "n"), ("/c", 4, 4.0, "q", None)], C.IMAGE_CACHE)
    assert rows(C.image_cache_upsert(old, new)) == sorted([("/a", 1, 1.0, "x", None), ("/b", 3, 3.0, None, "n"), ("/c", 4, 4.0, "q", None)], key=repr)
    inv = files([("/r/a/1", b"1", 1), ("/r/a/2", b"1", 1), ("/r/b/3", b"1", 1), ("/r/b/4", b"2", 1)])
    plan = spark.createDataFrame([("/r/a/1", True), ("/r/a/2", True), ("/r/b/3", True), ("/r/b/4", False)], "path string, ok boolean")
    assert rows(actions.parents_to_remove(plan, inv)) == [("/r/a",)]


# ---- cancelling ----


def test_cancelling_ends_the_jobs(spark):
    @F.udf("int")
    def slow(x):
        time.sleep(0.3)
        return 1

    with pytest.raises(Cancelled), cancellable(spark) as handle:
        threading.Timer(1.5, handle.cancel).start()
        spark.range(0, 400, 1, 8).select(slow("id").alias("x")).agg(F.sum("x")).collect()
    with pytest.raises(Cancelled), cancellable(spark) as handle:
        handle.cancel()
        handle.check()
    with pytest.raises(ValueError), cancellable(spark):
        raise ValueError
    with cancellable(spark):
        assert spark.range(5).count() == 5


def moved(names, there):
    """Names given one after another: who asks for a free name first gets it, then the others take the least free numbers."""
    taken, out = {n.lower() for n in there}, {}
    for path in sorted(names):
        if (low := names[path].lower()) not in taken:
            out[path] = names[path]
            taken.add(low)
    for path in sorted(set(names) - set(out)):
        stem, suffix = os.path.splitext(names[path])
        n = next(n for n in itertools.count(1) if f"{stem} ({n}){suffix}".lower() not in taken)
        out[path] = f"{stem} ({n}){suffix}"
        taken.add(out[path].lower())
    return out


def test_moves_against_one_after_another(spark, monkeypatch):
    r = random.Random(12)
    rows_, there, want = [], [], {}
    stems = ["a", "A", "a (1)", "a (2)", "a (1) (1)", "b", ".h", "a.b", "a (01)", "é (3)", "é", "a (99999999999999999999)"]
    for k in range(120):  # selections of one folder each, planned at once: families of different folders don't meet
        ext = f".x{k}"
        names = {f"/d{i}/{n}": n for i in range(r.randrange(1, 9)) if (n := r.choice(stems) + r.choice([ext, ext.upper()]))}
        own = {r.choice(stems) + ext for _ in range(r.randrange(4))}
        given = moved(names, own)
        assert len({g.lower() for g in given.values()} | {o.lower() for o in own}) == len(names) + len({o.lower() for o in own})
        want |= {p: f"/dest/{g}" for p, g in given.items()}
        rows_ += [("g", i, p, 1, 1.0) for i, p in enumerate(names)]
        there += [(f"/dest/{o}", 1, 1.0) for o in own]
    members = spark.createDataFrame(rows_, "group_key string, member_ord long, path string, size long, modified double")
    inv = members.select("path", "size", "modified").unionByName(spark.createDataFrame(there, "path string, size long, modified double"))
    plan = {x.src: x.dst for x in actions.move_plan(members, members, inv, "/dest").collect()}
    assert plan == want


def test_refused_moves_take_no_name(spark):
    members = spark.createDataFrame([("g", 0, "/a/x", 1, 1.0), ("g", 1, "/b/x", 1, 1.0)], "group_key string, member_ord long, path string, size long, modified double")
    inv = members.withColumn("size", F.when(F.col("path") == "/a/x", 2).otherwise(1).cast("long")).select("path", "size", "modified")
    assert {tuple(x) for x in actions.move_plan(members, members, inv, "/dest").collect()} == {("/a/x", None, False, "size"), ("/b/x", "/dest/x", True, None)}
