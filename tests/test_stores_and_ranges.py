"""Byte comparison range by range, and the bucketed fingerprint store."""

import pytest
from pyspark.sql import functions as F

from dupelens.operators import cache as C
from dupelens.operators import dedup as D
from dupelens.sources import tree
from dupelens.sources.fingerprint_store import Conflict, FingerprintStore


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- bytes ----


def test_files_are_read_until_they_differ(spark, tmp_path):
    big = 3 << 20
    contents = {"a": b"x" * big, "b": b"x" * big, "early": b"y" + b"x" * (big - 1), "middle": b"x" * (1 << 19) + b"y" + b"x" * (big - (1 << 19) - 1), "late": b"x" * (big - 1) + b"y",
                "late2": b"x" * (big - 1) + b"y", "s1": b"small", "s2": b"small", "s3": b"smell", "only": b"one", "e1": b"", "e2": b""}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = tree.scan_tree(spark, [str(tmp_path)]).select("path", "size", F.lower("name").alias("low_name"))
    full, read = tree.refined(files)
    groups = {}
    for path, digest in full.collect():
        groups.setdefault(digest, set()).add(path.rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["e1", "e2"], ["late", "late2"], ["s1", "s2"]]
    read = {p.rsplit("/", 1)[1]: n for p, n in read.collect()}
    assert read == {"a": big, "b": big, "late": big, "late2": big, "early": 1 << 16, "middle": (1 << 16) + (1 << 19), "s1": 5, "s2": 5, "s3": 5, "only": 3, "e1": 0, "e2": 0}
    for c in (D.Criteria(by_hash=False, by_byte=True), D.Criteria(by_size=False, by_hash=False, by_byte=True), D.Criteria(by_name=True, by_hash=False, by_byte=True, ignore_empty=False)):
        found = D.find_duplicates(tree.fingerprints(spark, [str(tmp_path)], c), c)
        assert rows(found) == rows(D.find_duplicates(tree.scan_tree(spark, [str(tmp_path)]), c))
    assert [df.count() for df in tree.refined(files.limit(0))] == [0, 0]


# ---- store ----


@pytest.fixture
def store(spark, tmp_path):
    return FingerprintStore(spark, str(tmp_path / "store"), buckets=16)


def table(spark, ids, tag, mtime=1.0):
    return spark.createDataFrame([(f"/f{i}", i, mtime, f"{tag}{i}", None if i % 3 else f"t{tag}{i}") for i in ids], C.FILE_CACHE)


def test_an_update_rewrites_the_buckets_it_touches(spark, store):
    assert store.read().count() == 0 and store.upsert(table(spark, [], "n")) == []
    old = table(spark, range(200), "a")
    assert store.upsert(old) == list(range(16)) and rows(store.read()) == rows(old)
    before = store.manifest()
    new = table(spark, [3, 300], "b", 2.0).unionByName(spark.createDataFrame([("/f5", 5, 1.0, None, "kept")], C.FILE_CACHE))
    touched = store.upsert(new)
    after = store.manifest()
    assert 1 <= len(touched) <= 3 and {int(b) for b in after["files"] if after["files"][b] != before["files"].get(b)} == set(touched)
    assert rows(store.read()) == rows(C.cache_upsert(old, new))
    assert store.vacuum() == 0 and rows(store.read()) == rows(C.cache_upsert(old, new))  # most buckets are of the first version
    store.clear()
    assert store.read().count() == 0 and store.vacuum() == 2


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    old = table(spark, range(50), "a")
    store.upsert(old)
    fail = F.udf(lambda p: 1 / 0 if p == "/f7" else p)
    with pytest.raises(Exception):  # noqa: B017  a task fails while it writes
        store.upsert(table(spark, range(20), "b").withColumn("full_hash", fail("path")))
    assert rows(store.read()) == rows(old)
    monkeypatch.setattr(FingerprintStore, "_swap", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # the driver ends before the manifest is in place
        store.upsert(table(spark, range(20), "c"))
    monkeypatch.undo()
    again = FingerprintStore(spark, store.folder, buckets=4)  # the number of buckets is the store's
    assert rows(again.read()) == rows(old) and again.manifest()["buckets"] == 16
    assert again.vacuum() >= 1 and rows(again.read()) == rows(old)


def test_two_writers(spark, store):
    store.upsert(table(spark, range(5), "a"))
    stale = store.manifest()["version"] - 1
    with pytest.raises(Conflict):
        store._swap({"version": stale + 1, "buckets": 16, "files": {}}, stale)
    assert store.read().count() == 5
