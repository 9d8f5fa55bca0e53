import fnmatch
import os
import re

import pytest
from pyspark.sql import functions as F

from dupelens.functions import expr as X
from dupelens.operators import filters as P


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_ext(spark):
    names = ["a.txt", ".tmp", "a.", "a.tar.GZ", "..x", "noext", ".a.b", "a.b.", "", "...", "x.TS"]
    got = column(spark, names).select(X.ext(F.col("v")).alias("e")).collect()
    assert [r.e for r in got] == [os.path.splitext(n)[1].lower() for n in names]


def test_category(spark):
    want = {"photo.jpg": "images", "PHOTO.PNG": "images", "clip.MP4": "videos", "track.flac": "audio", "report.pdf": "documents", "archive.zip": "archives", "main.py": "code", "unknown.zzz": "other", "x.ts": "videos"}
    got = column(spark, want).select("v", X.category(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == want


def test_human_size(spark):
    want = {512: "512 B", 1024: "1.00 KB", 1536: "1.50 KB", 1024**2: "1.00 MB", 1024**3: "1.00 GB", 1152: "1.12 KB", 0: "0 B", 5 * 1024**4: "5120.00 GB"}
    want |= {n: f"{n / 1024**2:.2f} MB" for n in (1_234_567, 99_999_999, 1024**3 - 1)}
    got = column(spark, want, "long").select("v", X.human_size(F.col("v")).alias("h")).collect()
    assert {r.v: r.h for r in got} == want


@pytest.mark.parametrize("size", [1, 15, 16, 17, 31, 32, 33, 100])
def test_partial_hash_windows(spark, size):
    import hashlib

    data = bytes(range(size))
    want = hashlib.md5(data[:16] + (data[-16:] if size > 32 else b"") + str(size).encode()).hexdigest()
    got = spark.createDataFrame([(data,)], "c binary").select(X.turbo_hash(F.col("c"), F.lit(size).cast("long"), 16).alias("h")).first().h
    assert got == want


def test_patterns(spark):
    paths = ["D:/Templates/a.txt", "D:/Temp/a.txt", "x/attempt_final", "D:/Games/mod/a.dll", "D:/Gamesome/a", "C:/node_modules/b.js", "e/a.LOG", "e/a.log.bak", "f/[x].txt", "g/b1.txt"]
    cases = {("Temp",): {1}, ("*.log",): {6}, ("d:/games",): {3}, ("D:",): {0, 1, 3, 4}, ("", "  "): set(), ("b[0-9].txt",): {9}, ("b[!0-9].txt",): set(), ("node_modules", "e"): {5, 6, 7}, ("[[]x].txt",): {8}}
    for patterns, want in cases.items():
        got = column(spark, paths).select("v", P.excluded(F.col("v"), patterns).alias("x")).collect()
        assert {i for i, p in enumerate(paths) if next(r.x for r in got if r.v == p)} == want, patterns


@pytest.mark.parametrize("pattern", ["*.tmp", "a?c", "[ab]*", "[!ab]*", "x.y", "a+b(c)", "[", "[]a]", "*", "a[b-d]e", "ü*"])
def test_glob(pattern):
    for text in ["a.tmp", "abc", "b", "cc", "x.y", "xzy", "a+b(c)", "[", "]", "a", "ace", "überall", ""]:
        assert bool(re.match(P.glob_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern), text


def test_sizes(files):
    rows = files([("a", b"", 1), ("b", b"12", 1), ("c", b"1234", 1)])
    assert {r.path for r in P.size_range(rows, 2, 2).collect()} == {"b"}
    assert P.size_range(rows, ignore_empty=False).count() == 3
    assert P.kb_range(1, 0) == (1024, None)
    with pytest.raises(ValueError):
        P.kb_range(5, 2)


def test_prune(files):
    rows = files([("r/$RECYCLE.BIN/a", b"1", 1), ("r/x/System Volume Information/b", b"1", 1), ("r/c", b"1", 1), ("$recycle.bin/root/d", b"1", 1)])
    assert {r.path for r in P.prune(rows, ["r", "$recycle.bin/root"]).collect()} == {"r/c", "$recycle.bin/root/d"}


def test_system_paths(spark):
    want = {"C:/Windows/x": True, "E:/bootcamp/notes.txt": False, "D:/Program Files/a": True, "D:/a/System32/b": True, "E:/Games/mod.dll": False, "c:/programdata": True, "/boot/x": True}
    got = column(spark, want).select("v", P.is_system_path(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == want


def test_physical_identity(spark):
    rows = spark.createDataFrame([("a", 1, 5, 0), ("b", 1, 5, 1), ("c", 1, 0, 2), ("d", 1, 0, 3), ("e", 2, 5, 4), ("f", None, None, 5), ("g", None, None, 6)], "path string, dev long, ino long, walk_ord long")
    assert {r.path for r in P.dedup_physical(rows).collect()} == set("acdefg")


def test_junk(files):
    rows = files([(f"d/x{e}", b"1", 1) for e in P.JUNK_EXTENSIONS] + [("d/Thumbs.db", b"1", 1), ("d/desktop.ini", b"1", 1), ("Windows/x.tmp", b"1", 1)])
    junk = P.junk_files(rows)
    assert junk.count() == 8
    assert {r.name for r in P.junk_preselected(junk).collect()} == {"x.tmp", "x.log", "x.gid", "x.chk", "Thumbs.db"}


def test_codes(spark):
    pairs = [("0" * 16, "f" * 16, 64), ("0" * 16, "0" * 15 + "1", 1), ("zz", "0", 64), ("a", "a", 0), ("f" * 17, "0", 64)]
    got = spark.createDataFrame(pairs, "a string, b string, d int").select("d", X.hamming_hex(F.col("a"), F.col("b")).alias("h")).collect()
    assert all(r.d == r.h for r in got)
    assert [X.max_distance(t) for t in (0.75, 0.80, 0.85, 0.90, 0.95, 1.0)] == [16, 12, 9, 6, 3, 0]


def test_dhash(spark):
    grid = [[r * 9 + (8 - c if r % 2 else c) for c in range(9)] for r in range(8)]
    want = 0
    for row in grid:
        for x, y in zip(row, row[1:]):
            want = want << 1 | (x > y)
    got = spark.createDataFrame([([v for r in grid for v in r],), ([1],)], "grid array<int>").select(X.code_hex(X.dhash_bits(F.col("grid"))).alias("h")).collect()
    assert [r.h for r in got] == [f"{want:016x}", None]


def test_paths(spark):
    one = spark.createDataFrame([("C:\\A\\.\\b\\", "/x//y/", "C:/" + "d" * 30 + "/e/" + "f" * 30)], "a string, b string, c string").select(
        X.path_key(F.col("a")).alias("a"), X.path_key(F.col("b")).alias("b"), X.short_path(F.col("c")).alias("c"), X.same_volume(F.col("a"), F.lit("c:/z")).alias("v"), X.same_volume(F.lit("/a"), F.lit("/b")).alias("w"),
        X.filetime_epoch(F.lit(116444736000000000 + 10_000_000)).alias("t"),
    ).first()
    assert one.a == "c:/a/b" and one.b == "/x/y" and one.c == "C:/" + "d" * 30 + "/.../" + "f" * 30 and one.v and not one.w and one.t == 1.0
