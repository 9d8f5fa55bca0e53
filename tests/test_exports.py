"""Reports written by ranges against rows rendered one after another, and where written tables are."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from dupelens import session
from dupelens.operators import dedup as D
from dupelens.plans import report


@pytest.fixture(scope="module")
def members(files):
    r = random.Random(1)
    names = ["a.txt", 'q"u,o.txt', "line\nbreak", "c\rr", "<é>&'.png", " lead", "中.bin"]
    inv = files([(f"/d{k}/{r.choice(names)}", r.choice([b"x" * 9] * 5 + [b"y" * k, b"z", b"zz"]), k % 17) for k in range(1, 400)])
    return session.write_once(D.find_duplicates(inv).withColumn("group_key", F.concat("group_key", F.lit(' é"'))), "members")


def in_order(members):
    return members.orderBy("block_ord", "group_ord", "group_key", "member_ord")


def test_csv_is_what_a_writer_writes(members, tmp_path):
    want = io.StringIO()
    out = csv.writer(want)
    out.writerow(report.HEADER)
    out.writerows(report.export_rows(in_order(members)).collect())
    report.export(members, str(tmp_path / "r.csv"), "csv")
    assert (tmp_path / "r.csv").read_bytes() == want.getvalue().encode("utf-8-sig")


def test_json_and_text_of_all_groups_in_order(members, tmp_path):
    groups = {}
    for m in in_order(members).collect():
        groups.setdefault(m.group_key, []).append(m)
    for kind in ("json", "txt", "html"):
        report.export(members, str(tmp_path / f"r.{kind}"), kind)
    data = json.loads((tmp_path / "r.json").read_text(encoding="utf-8"))
    assert list(data["groups"]) == list(groups) and len(groups) > 2
    assert [[f["path"] for f in g] for g in data["groups"].values()] == [[m.path for m in g] for g in groups.values()]
    assert data["total_groups"] == len(groups) and data["wasted_space"] == sum(m.size for g in groups.values() for m in g if m.member_ord)
    text = (tmp_path / "r.txt").read_bytes().decode()
    sizes = {m.size: s for m, s in ((g[0], f"{g[0].size} B") for g in groups.values())}
    body = "".join(f"\n=== Group: {k} ({len(g)} files, {sizes[g[0].size]} each) ===\n" + "".join(f"  - {m.path} ({sizes[m.size]})\n" for m in g) for k, g in groups.items())
    assert text == f"Duplicate report\nGroups: {len(groups)}\nReclaimable bytes: {data['wasted_space']}\n" + body
    html = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert html.count("<tr><td>") == sum(map(len, groups.values())) and html.count('<tr class="group">') == len(groups) and html.endswith("</table></body></html>\n")


def test_reports_of_nothing(members, tmp_path):
    for kind in ("csv", "json", "txt", "html"):
        report.export(members.limit(0), str(tmp_path / kind), kind)
    assert json.loads((tmp_path / "json").read_text()) == {"total_groups": 0, "wasted_space": 0, "groups": {}}
    assert len((tmp_path / "csv").read_text(encoding="utf-8-sig").splitlines()) == 1
    assert sorted(os.listdir(tmp_path)) == ["csv", "html", "json", "txt"]


def test_the_shared_folder_keeps_its_file_system(spark, tmp_path):
    assert session.qualified(spark, "/some/where") == "file:///some/where"
    assert session.qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://own/")
    try:
        assert session.qualified(spark, "/in/x") == "viewfs://own/in/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_written_tables_go_at_exit(spark):
    df = session.write_once(spark.range(3), "three")
    folder = df.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    session._remove(spark, "file://" + folder)
    assert not os.path.exists(folder)
