"""Trees, sweeping, pictures, binary layouts, real folders and streams."""

import difflib
import itertools
import os
import struct

import pytest

from dupelens.functions import python_udfs as U
from dupelens.operators import diff, similar, sweep
from dupelens.operators.dedup import find_duplicates
from dupelens.sources import inventory, stores, tree
from dupelens.streaming import incremental


def side(spark, rows):
    return spark.createDataFrame([(p, p, p, len(c), t, c, i) for i, (p, c, t) in enumerate(rows)], "rel_path string, path string, name string, size long, modified double, content binary, walk_ord long")


def test_diff(spark):
    a = side(spark, [("only_a.txt", b"A", 1.0), ("same.bin", b"S" * 150, 3.0), ("Case.txt", b"c", 1.0), ("lines", b"x\r\ny\r\n", 1.0)])
    b = side(spark, [("only_b.txt", b"B", 1.0), ("same.bin", b"S" * 100, 2.0), ("case.TXT", b"c", 1.0), ("lines", b"x\ny\n", 1.0)])
    d = diff.diff_trees(a, b, line_similarity=True)
    got = {r.rel_key: (r.side, r.similarity, r.newer, r.larger) for r in d.collect()}
    assert got == {"only_a.txt": ("a", None, None, None), "only_b.txt": ("b", None, None, None), "same.bin": ("common", 0.0, "a", "a"), "case.txt": ("common", 1.0, "same", "same"), "lines": ("common", 1.0, "same", "a")}
    assert diff.diff_summary(d).first().asDict() == {"unique_a": 1, "unique_b": 1, "common": 3, "total": 5, "identical": 2, "modified": 1, "overlap": 60.0}
    assert diff.diff_summary(diff.diff_trees(a.limit(0), b.limit(0))).first()["overlap"] == 0.0
    twice = side(spark, [("k", b"1", 1.0), ("K", b"22", 1.0)])
    assert diff.diff_trees(twice, twice.limit(0)).first()["a_size"] == 2


def test_line_ratio():
    a, b = b"alpha\nbeta\ngamma\n", b"alpha\nbeta\ndelta\nepsilon\n"
    assert U.line_ratio(a, a) == 1.0 and U.line_ratio(b"", b"") == 1.0 and U.line_ratio(a, b) == pytest.approx(4 / 7)
    assert U.line_ratio(b"\0x", b"\0x") == 1.0 and U.line_ratio(b"\0x", b"\0y") == 0.0 and U.line_ratio(None, a) == 0.0
    many = [("\n".join(f"l{i % k}" for i in range(400)) + "\n").encode() for k in (3, 7)]
    lines = [m.decode().splitlines(True) for m in many]
    assert U.line_ratio(*many) == difflib.SequenceMatcher(None, *lines).ratio()


def test_empty_dirs(spark):
    dirs = spark.createDataFrame([(p, p == "r/locked") for p in ("r", "r/a", "r/a/b", "r/a/b/c", "r/full", "r/locked", "r/p", "r/p/q")], "path string, closed boolean")
    inv = spark.createDataFrame([("r/full/f.txt",), ("r/file.txt",)], "path string")
    got = sweep.empty_dirs(dirs, inv, ["r"])
    assert [r.path for r in sweep.deletion_order(got).collect()] == ["r/a/b/c", "r/p/q", "r/a/b", "r/p", "r/a"]
    dirs2 = spark.createDataFrame([("r/p", False), ("r/p/locked", True)], "path string, closed boolean")
    assert sweep.empty_dirs(dirs2, inv).count() == 0


def test_emptied_parents(spark):
    inv = spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/c/z",)], "path string")
    assert [r.path for r in sweep.emptied_parents(inv.filter("path like 'a/b%'"), inv).collect()] == ["a/b"]
    assert sweep.emptied_parents(inv.filter("path = 'a/b/x'"), inv).count() == 0
    assert {r.path for r in sweep.emptied_parents(inv, inv).collect()} == {"a/b", "a/c"}


def link(target=b"C:/x.txt", flags=2, offset=0x1C, ids=b""):
    head = b"\x4c\0\0\0" + bytes(16) + struct.pack("<I", flags) + bytes(0x4C - 24)
    return head + ids + struct.pack("<7I", 0x1C + len(target) + 1, 0x1C, 1, 0, offset, 0, 0) + target + b"\0"


def test_links(spark):
    assert U.parse_link(link()) == "C:/x.txt"
    assert U.parse_link(link(flags=3, ids=struct.pack("<H", 3) + b"abc")) == "C:/x.txt"
    for bad in (link(offset=0), link(flags=0), link(offset=999), link()[:60], b"", b"nope", None):
        assert U.parse_link(bad) is None
    rows = spark.createDataFrame([("l1", link(b"C:/here")), ("l2", link(b"C:/gone")), ("l3", link(b"Z:/gone")), ("l4", b"")], "path string, content binary")
    links = rows.select("path", U.link_target("content").alias("target"))
    got = sweep.broken_links(links, spark.createDataFrame([("c:/HERE",)], "path string"), spark.createDataFrame([("c:",)], "drive string"))
    assert [r.path for r in got.collect()] == ["l2"]


def record(path, version=2, size=5, seconds=1):
    head = struct.pack("<qqq", version, size, 116444736000000000 + seconds * 10_000_000)
    return head + (struct.pack("<i", len(path) + 1) + (path + "\0").encode("utf-16-le") if version == 2 else path.encode("cp1252").ljust(256, b"\0"))


def test_bins(spark):
    assert U.parse_bin_record(record("C:/ä.txt")) == ("C:/ä.txt", 5, 1.0)
    assert U.parse_bin_record(record("C:/b.txt", 1)) == ("C:/b.txt", 5, 1.0)
    for bad in (record("")[:30], record("x", 3), b"", None, record("")):
        assert U.parse_bin_record(bad) is None
    files = spark.createDataFrame([("b/$IAAA.txt", record("C:/a")), ("b/$raaa.TXT", b"x"), ("b/$IBBB", record("C:/b")), ("b/$ICCC", b"bad"), ("b/$RCCC", b"x")], "path string, content binary")
    got = {r.original_path: (r.data_path, r.data_exists) for r in stores.bin_entries(files).collect()}
    assert got == {"C:/a": ("b/$raaa.TXT", True), "C:/b": ("", False)}


def test_stores(spark, tmp_path):
    p = str(tmp_path / "h.json")
    schema = "date string, wasted long"
    assert stores.read_json(spark, p, schema).count() == 0
    stores.write_json(spark.createDataFrame([("x", 1), ("y", 2)], schema), p)
    assert {tuple(r) for r in stores.read_json(spark, p, schema).collect()} == {("x", 1), ("y", 2)}
    for bad in ("{", '{"a": 1}', ""):
        (tmp_path / "h.json").write_text(bad)
        assert stores.read_json(spark, p, schema).count() == 0


def codes(spark, values):
    return spark.createDataFrame([(i, f"n{i}", float(i), i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, name string, modified double, walk_ord long, fingerprint long")


def test_pairs_by_loop_and_by_bands(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << r.randrange(64) for _ in range(k)) for b in base for k in (0, 0, 2, 5)]
    values = [v & (2**64 - 1) for v in values]
    want = {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if (a ^ b).bit_count() <= 6}
    c = codes(spark, values)
    for limit in (10_000, 0):
        assert {tuple(x) for x in similar.hamming_pairs(c, 6, loop_codes=limit).collect()} == want


def test_no_group_holds_two_far_apart(spark):
    got = similar.find_similar(codes(spark, [0, 0x3F, 0xFFF]), 0.90).collect()
    assert sorted(r.id for r in got) == [0, 1]
    same = similar.find_similar(codes(spark, [7, 1 << 63, 7, 1 << 63, 0xF0F0F0F0]), 1.0).collect()
    assert sorted(r.id for r in same) == [0, 1, 2, 3]
    named = similar.named_groups(similar.find_similar(codes(spark, [7, 7, 1 << 40, 1 << 40]), 0.95))
    assert {r.group_key for r in named.collect()} == {"Photo Group 1: n0", "Photo Group 2: n2"}
    assert similar.find_similar(codes(spark, [1])).count() == 0


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in similar.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_real_tree(spark, tmp_path):
    for p, c in {"a/x.bin": b"same", "b/c/y.bin": b"same", "b/z.txt": b"other", "$RECYCLE.BIN/q": b"same", "top.txt": b"t"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(c)
    (tmp_path / "e" / "f").mkdir(parents=True)
    os.link(tmp_path / "a/x.bin", tmp_path / "b/alias.bin")
    os.symlink(tmp_path / "b", tmp_path / "a" / "loop")
    inv = tree.scan_tree(spark, [str(tmp_path), str(tmp_path / "missing")])
    names = sorted(r.name for r in inv.collect())
    assert names == ["alias.bin", "top.txt", "x.bin", "y.bin", "z.txt"]
    assert sorted(r.name for r in find_duplicates(inv).collect()) == ["x.bin", "y.bin"]
    assert find_duplicates(tree.scan_tree(spark, [str(tmp_path), str(tmp_path / "a")])).count() == 2
    empty = sweep.empty_dirs(tree.scan_dirs(spark, [str(tmp_path)]), inv, [str(tmp_path)])
    assert sorted(os.path.relpath(r.path, tmp_path) for r in empty.collect()) == ["e", "e/f"]
    binary = inventory.from_binary_files(spark, str(tmp_path / "b"))
    assert sorted(r.name for r in binary.collect()) == ["alias.bin", "y.bin", "z.txt"]


def test_stream(spark, tmp_path):
    schema = "path string, size long, walk_ord long, content binary"
    landing = tmp_path / "in"
    for k, rows in enumerate([[("a", 2, 0, b"11"), ("b", 2, 1, b"22")], [("c", 2, 2, b"11"), ("d", 2, 3, b"33"), ("e", 2, 4, b"33")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landing))
        q = incremental.stream_duplicates(incremental.read_landing(spark, str(landing), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.path, r.first_path) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("c", "a"), ("e", "d")}
