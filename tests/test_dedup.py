"""Duplicate groups against a plain model, over every combination of criteria."""

import hashlib
import itertools
from collections import defaultdict

import pytest

from dupelens.operators import dedup as D

TREE = [
    ("tree/a.txt", b"unique alpha", 5), ("tree/other.log", b"log line", 4), ("tree/dir1/dup.bin", b"X" * 1024, 30), ("tree/dir2/dup.bin", b"X" * 1024, 10), ("tree/dir3/dup.bin", b"X" * 1024, 20),
]
HEAD = b"h" * 100
MIXED = [
    ("m/a0", b"A" * 70, 3), ("m/a1", b"A" * 70, 2), ("m/b0", b"B" * 70, 1), ("n/A1", b"A" * 70, 1), ("m/b1", b"B" * 70, 1), ("m/c", b"C" * 77, 1), ("m/d", b"D" * 77, 1), ("m/u", b"U" * 33, 1), ("m/empty", b"", 1), ("n/empty", b"", 1),
    ("t/0", HEAD + b"A" * 50, 1), ("t/1", HEAD + b"A" * 50, 1), ("t/2", HEAD + b"B" * 50, 1), ("t/A1", HEAD + b"B" * 50, 0), ("x/c", b"A" * 70, 9),
]


def model(rows, c):
    """What equal means, written plainly: key -> paths, oldest first."""
    pool = [(p, p.rsplit("/", 1)[-1], b, m, k) for k, (p, b, m) in enumerate(rows) if not (c.ignore_empty and not b)]
    groups = defaultdict(list)
    for f in pool:
        key = [str(len(f[2]))] * c.by_size + [f[1].lower()] * c.by_name + [hashlib.sha256(f[2]).hexdigest()] * c.by_hash
        if c.by_hash and c.turbo:
            key = [f[1].lower()] * c.by_name + [str(len(f[2])), hashlib.sha256(f[2]).hexdigest()]
        groups["|".join(key)].append(f)
    out = {}
    for key, fs in groups.items():
        if c.by_byte and not c.by_hash:
            parts = defaultdict(list)
            for f in fs:
                parts[f[2]].append(f)
            for n, part in enumerate(p for p in parts.values() if len(p) > 1):
                out[f"{key}_b{n}"] = part
        elif len(fs) > 1:
            out[key] = fs
    by_walk = c.by_size and not (c.by_name or c.by_hash or c.by_byte)
    return {k: [f[0] for f in sorted(fs, key=(lambda f: f[4]) if by_walk else (lambda f: (f[3], f[4])))] for k, fs in out.items()}


def found(members):
    out = defaultdict(list)
    for r in sorted(members.collect(), key=lambda r: (r.group_key, r.member_ord)):
        assert r.member_ord == len(out[r.group_key])
        out[r.group_key].append(r.path)
    return dict(out)


COMBINATIONS = [(n, s, h, b, t) for n, s, h, b in itertools.product([False, True], repeat=4) if n or s or h or b for t in ([False, True] if h else [True])]


@pytest.mark.parametrize("name,size,hash_,byte,turbo", COMBINATIONS)
def test_criteria(files, name, size, hash_, byte, turbo):
    c = D.Criteria(by_name=name, by_size=size, by_hash=hash_, by_byte=byte, turbo=turbo, partial=16)
    assert found(D.find_duplicates(files(MIXED), c)) == model(MIXED, c)


def test_no_criteria():
    with pytest.raises(ValueError):
        D.Criteria(by_size=False, by_hash=False)


def test_basic_tree_oldest_first(files):
    got = found(D.find_duplicates(files(TREE)))
    assert list(got.values()) == [["tree/dir2/dup.bin", "tree/dir3/dup.bin", "tree/dir1/dup.bin"]]


def test_exclusion_drops_a_member(files):
    got = found(D.find_duplicates(files(TREE), D.Criteria(exclude=["DIR1"])))
    assert list(got.values()) == [["tree/dir2/dup.bin", "tree/dir3/dup.bin"]]


def test_unreadable_files_group_with_nothing(files):
    rows = [("a", b"xx", 1), ("b", b"xx", 1), ("c", None, 1), ("d", None, 1)]
    assert sorted(*found(D.find_duplicates(files(rows), D.Criteria(by_size=False))).values()) == ["a", "b"]


def test_excluded_alias_does_not_hide_a_file(files):
    rows = [("skip/a", b"same", 1, 7), ("keep/a", b"same", 2, 7), ("keep/b", b"same", 3, 8)]
    assert list(found(D.find_duplicates(files(rows), D.Criteria(exclude=["skip"]))).values()) == [["keep/a", "keep/b"]]
    assert list(found(D.find_duplicates(files(rows))).values()) == [["skip/a", "keep/b"]]


def test_first_of_an_inode_counts_even_if_its_size_is_unique(files):
    rows = [("a", b"1", 1, 5), ("b", b"22", 1, 5), ("c", b"22", 1, 6)]
    assert found(D.find_duplicates(files(rows))) == {}


def test_group_order_is_first_appearance(files):
    rows = [("a", b"x" * 500, 1), ("b", b"y" * 100, 1), ("c", b"x" * 500, 1), ("d", b"y" * 100, 1)]
    got = D.find_duplicates(files(rows), D.Criteria(by_hash=False)).orderBy("block_ord", "group_ord").select("size").distinct().collect()
    assert {r.size for r in got} == {100, 500}
    first = D.find_duplicates(files(rows)).orderBy("block_ord", "group_ord", "member_ord").first()
    assert first.size == 500


def test_stats(spark, files):
    rows = files([("a", b"x" * 100, 1), ("b", b"y" * 100, 1), ("u", b"z" * 101, 1), ("c", b"w" * 100, 1), ("v", b"q" * 202, 1)])
    assert D.candidate_stats(rows).first() == (1, 3)
    assert D.candidate_stats(rows, by_size=False).first() == (1, 5)
    assert D.candidate_stats(rows.limit(0)).first() == (0, 0)
    assert D.candidate_stats(rows.limit(1), by_size=False).first() == (0, 0)


def test_name_only_pool(files):
    rows = files([(f"d{i}/same.bin", b"x" * (i + 1), i) for i in range(150)])
    got = found(D.find_duplicates(rows, D.Criteria(by_name=True, by_size=False, by_hash=False)))
    assert {k: len(set(v)) for k, v in got.items()} == {"same.bin": 150}


def test_bars_in_names_do_not_join_groups(files):
    rows = files([("d/a|b", b"1", 1), ("e/a|b", b"1", 1), ("d/a", b"1", 1)])
    assert list(found(D.find_duplicates(rows, D.Criteria(by_name=True))).values()) == [["d/a|b", "e/a|b"]]


def test_known_hashes_are_used(spark, files):
    rows = files([("a", b"12", 1), ("b", b"34", 1), ("c", b"34", 1)])
    known = spark.createDataFrame([("a", hashlib.sha256(b"34").hexdigest())], "path string, full_hash string")
    assert list(found(D.find_duplicates(rows, hashes=known)).values()) == [["a", "b", "c"]]


def test_sample(files):
    rows = files([("src/sample.bin", b"SAMPLE" * 100, 1), ("dst/copy.bin", b"SAMPLE" * 100, 1), ("dst/sample.bin", b"SAMPLE" * 100, 1), ("dst/other.bin", b"OTHERR" * 100, 1), ("src/alias", b"SAMPLE" * 100, 1, 1)])
    sample = rows.filter("path = 'src/sample.bin'")
    assert {r.path for r in D.find_copies(rows, sample).collect()} == {"dst/copy.bin", "dst/sample.bin"}
    assert {r.path for r in D.find_copies(rows, sample, D.Criteria(by_name=True)).collect()} == {"dst/sample.bin"}
    assert D.find_copies(rows, sample.limit(0)).count() == 0
    together = D.with_sample_first(D.find_copies(rows, sample), sample).orderBy("member_ord").collect()
    assert together[0].path == "src/sample.bin" and len(together) == 3


def test_empty_inventory(files):
    none = files(TREE).limit(0)
    for c in (D.Criteria(), D.Criteria(by_hash=False), D.Criteria(by_size=False, by_hash=False, by_byte=True)):
        assert D.find_duplicates(none, c).count() == 0


def test_no_body_crosses_a_shuffle(files):
    plan = D.find_duplicates(files(MIXED))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line:
            assert "content" not in line
