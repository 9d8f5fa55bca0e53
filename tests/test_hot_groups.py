"""Groups of very many members: the same rows by ranges and by aggregates as in one task."""

import random

import pytest
from pyspark.sql import functions as F

from dupelens import joins
from dupelens.operators import dedup as D
from dupelens.operators import select
from dupelens.session import write_once


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def inv(files):
    r = random.Random(6)
    return files([(f"/d{r.randrange(5)}/{k}/{r.choice('abc')}.txt", r.choice([b"hot"] * 6 + [b"one", b"two", b"longer", b"own %d" % k]), r.randrange(40)) for k in range(300)])


@pytest.mark.parametrize("criteria", [D.Criteria(), D.Criteria(by_name=True, by_hash=False), D.Criteria(by_hash=False), D.Criteria(by_size=False, by_hash=False, by_byte=True), D.Criteria(by_name=True, by_size=False, by_hash=False, by_byte=True)], ids=range(5))
def test_members_of_large_groups(inv, monkeypatch, criteria):
    want = rows(D.find_duplicates(inv, criteria))
    monkeypatch.setattr(joins, "HOT_GROUP", 20)
    assert rows(D.find_duplicates(inv, criteria)) == want and len(want) > 100


def test_rules_bring_no_group_together(spark, inv, monkeypatch):
    members = write_once(D.find_duplicates(inv).withColumn("pixels", F.when(F.col("walk_ord") % 3 > 0, F.col("walk_ord") % 50)), "members")
    groups = {}
    for m in members.collect():
        groups.setdefault(m.group_key, []).append(m)
    keep = {
        "first": lambda g: min(g, key=lambda m: m.member_ord), "last": lambda g: max(g, key=lambda m: m.member_ord),
        "newest": lambda g: min(g, key=lambda m: (-m.modified, m.member_ord)), "oldest": lambda g: min(g, key=lambda m: (m.modified, m.member_ord)),
        "shortest": lambda g: min(g, key=lambda m: (len(m.path), m.member_ord)), "largest_res": lambda g: min(g, key=lambda m: (m.pixels is None, -(m.pixels or 0), m.member_ord)),
    }
    for rule, best in keep.items():
        got = select.select_members(members, rule)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert {p for (p,) in got.collect()} == {m.path for g in groups.values() for m in g} - {best(g).path for g in groups.values()}
    gone = select.select_members(members, "newest").filter(F.length("path") % 2 == 0)
    want = rows(select.remove_members(members, gone))
    monkeypatch.setattr(joins, "HOT_GROUP", 5)
    assert rows(select.remove_members(members, gone)) == want


def test_numbering_within_null_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_GROUP", 10)
    r = random.Random(3)
    data = [(r.choice([None, None, 1, 2, 3, 4]), r.choice("ab"), k) for k in range(100)]
    df = spark.createDataFrame(data, "a long, b string, o long")
    got = {x.o: x.n for x in joins.numbered_within(df, ["a", "b"], [F.col("o").desc()], "n").collect()}
    want, seen = {}, {}
    for a, b, o in sorted(data, key=lambda x: -x[2]):
        want[o] = seen[a, b] = seen.get((a, b), -1) + 1
    assert got == want
