"""Real trees: walked by rounds in the order of a plain walk, bodies only where asked for, shortcuts to their targets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from dupelens.cancel import Cancelled, cancellable
from dupelens.operators import dedup as D
from dupelens.operators import sweep
from dupelens.sources import tree
from tests.test_trees import link


def plain(root):
    """Files as one process walks them."""
    out = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if not os.path.islink(os.path.join(folder, d)) and d.lower() not in ("$recycle.bin", "system volume information"))
        out += [os.path.join(folder, n) for n in sorted(names) if not os.path.islink(os.path.join(folder, n))]
    return out


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r, top = random.Random(2), tmp_path_factory.mktemp("walk")
    folders = [top]
    for k in range(60):  # deep and wide, names that sort oddly
        f = r.choice(folders[-8:]) / r.choice(["a", "A", "a b", "a.b", "a\x01", "é", "z", f"n{k}", "$Recycle.Bin", "ab"])
        f.mkdir(exist_ok=True)
        folders.append(f)
    for k in range(300):
        (r.choice(folders) / f"{r.choice('aAbzé')}{k % 40}.txt").write_bytes(r.choice([b"", b"same", b"SAME", b"%d" % k]))
    os.symlink(folders[3], folders[0] / "link")
    return str(top)


@pytest.mark.parametrize("budget", [1, 17, 20_000])
def test_rounds_give_the_order_of_a_walk(spark, root, monkeypatch, budget):
    monkeypatch.setattr(tree, "BUDGET", budget)
    got = tree.scan_tree(spark, [root, root + "/missing", root], content=False).orderBy("walk_ord").collect()
    want = plain(root)
    assert [r.path for r in got] == want + want and [r.walk_ord for r in got] == list(range(2 * len(want)))
    assert {(r.path, r.size, r.ino) for r in got} == {(p, os.stat(p).st_size, os.stat(p).st_ino) for p in want}
    dirs = {r.path: r.closed for r in tree.scan_dirs(spark, [root]).collect()}
    assert dirs[root + "/link"] and root not in dirs
    assert {p for p, closed in dirs.items() if not closed} == {f for f, _, _ in os.walk(root) if f != root and "ecycle" not in f}


def test_links_and_odd_names_hold_their_folders(spark, tmp_path):
    for name in ("link", "file_link", "odd", "empty"):
        (tmp_path / name).mkdir()
    os.symlink(tmp_path / "empty", tmp_path / "link" / "x")
    os.symlink(tmp_path / "none", tmp_path / "file_link" / "x")
    open(os.fsencode(tmp_path / "odd") + b"/\xff", "w").close()
    root = str(tmp_path)
    got = sweep.empty_dirs(tree.scan_dirs(spark, [root]), tree.scan_tree(spark, [root]), [root])
    assert [os.path.basename(r.path) for r in got.collect()] == ["empty"]


def test_no_body_is_read_unless_used(spark, root):
    inv = tree.scan_tree(spark, [root])
    assert "body(" not in inv.select("path", "size").filter("size > 3")._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p in plain(root):
        with open(p, "rb") as f:
            want[p] = f.read()
    assert {r.path: bytes(r.content) for r in inv.select("path", "content").collect()} == want
    groups = {}
    for r in D.find_duplicates(inv).collect():
        groups.setdefault(r.group_key, set()).add(want[r.path])
    assert len(groups) == 2 and all(len(g) == 1 for g in groups.values())


def test_files_larger_than_a_value(spark, tmp_path):
    for name, last in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        with open(tmp_path / name, "wb") as f:
            f.truncate((1 << 31) + 5)  # sparse
            f.seek((1 << 31) + 4)
            f.write(last)
    found = tree.fingerprints(spark, [str(tmp_path)])
    assert {r.path[-1] for r in D.find_duplicates(found).collect()} == {"a", "b"}
    assert tree.scan_tree(spark, [str(tmp_path)]).filter("content IS NOT NULL").count() == 0


def test_shortcuts_from_scan_to_report(spark, tmp_path):
    top, outside = tmp_path / "top", tmp_path / "outside"
    (top / "sub").mkdir(parents=True)
    outside.mkdir()
    (top / "here.txt").write_bytes(b"1")
    (top / "ñ.txt").write_bytes(b"1")
    links = {"ok.lnk": top / "here.txt", "sub/GONE.LNK": top / "gone.txt", "folder.lnk": top / "sub", "utf8.lnk": top / "ñ.txt", "share.lnk": "//server/share/x.txt", "drive.lnk": "Q:/x.txt"}
    for name, target in links.items():
        (top / name).write_bytes(link(str(target).encode()))
    (top / "bad.lnk").write_bytes(b"no shortcut")
    (top / "text.txt").write_bytes(link(b"/nowhere"))
    (outside / "behind.lnk").write_bytes(link(b"/nowhere"))
    os.symlink(outside, top / "junction")
    got = {os.path.relpath(r.path, top): r.target for r in tree.scan_shortcuts(spark, [str(top)]).collect()}
    assert got == {name: str(target) for name, target in links.items()} | {"bad.lnk": None}
    broken = tree.broken_shortcuts(spark, [str(top)]).collect()
    assert [(r.name, r.target) for r in broken] == [("GONE.LNK", str(top / "gone.txt"))]


def test_folders_are_climbed_once(spark):
    inv = spark.range(2000).select(F.concat(F.lit("r/a/b/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"))
    above = sweep._holding(inv)
    assert {r.path for r in above.collect()} == {"r", "r/a", "r/a/b", "r/a/b/0", "r/a/b/1", "r/a/b/2"}
    plan = above._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # folders are made distinct before they are climbed


def test_a_cancelled_walk_hands_out_what_it_has(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BUDGET", 1)
    whole = {r.path for r in tree.scan_tree(spark, [root], content=False).collect()}
    empty = {r.path for r in sweep.empty_dirs(tree.scan_dirs(spark, [root]), tree.scan_tree(spark, [root], content=False), [root]).collect()}
    rounds, written = [], tree.write_once
    with cancellable(spark, partial=True) as handle:

        def write(df, name):
            if name == "walk" and len(rounds) == 2:
                handle.cancel()
                raise RuntimeError("a job was cancelled")
            rounds.append(name)
            return written(df, name)

        monkeypatch.setattr(tree, "write_once", write)
        some = {r.path for r in tree.scan_tree(spark, [root], content=False, handle=handle).collect()}
        assert handle.partial and 0 < len(some) < len(whole) and some < whole
    with cancellable(spark, partial=True) as handle:
        rounds.clear()
        dirs = tree.scan_dirs(spark, [root], handle)
        part = {r.path for r in sweep.empty_dirs(dirs, spark.createDataFrame([(p,) for p in some], "path string"), [root]).collect()}
        assert part <= empty  # no folder that wasn't looked into
    with pytest.raises(Cancelled), cancellable(spark) as handle:
        rounds.clear()
        tree.scan_tree(spark, [root], content=False, handle=handle)
    with pytest.raises(RuntimeError):  # what isn't cancelled fails as ever
        rounds[:] = ["walk", "walk"]
        handle = None
        monkeypatch.setattr(tree, "write_once", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        tree.scan_tree(spark, [root], content=False)
