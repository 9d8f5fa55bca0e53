"""Suffix order, longest previous factors and removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dupelens.llm import suffixdedup as sd


@given(st.binary(max_size=300).map(lambda b: bytes(x % 2 for x in b)), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_suffix_order_and_previous_factors(data, length):
    n = max(0, len(data) - length + 1)
    order, common = sd.suffix_order(np.frombuffer(data + bytes(length + 8), np.uint8), np.arange(n), length)
    factors = [data[p : p + length] for p in range(n)]
    assert [factors[p] for p in order] == sorted(factors)

    def alike(p, q):
        return next((k for k in range(length) if factors[p][k] != factors[q][k]), length)

    assert common.tolist() == [0] * (n > 0) + [alike(a, b) for a, b in zip(order, order[1:], strict=False)]
    found = np.zeros(n, np.int64)
    found[order] = sd.previous_factors(order, common)
    assert found.tolist() == [max((alike(p, q) for q in range(p)), default=0) for p in range(n)]


def test_leading_zero_bytes():
    x = np.array([1, 255, 256, 2**56 - 1, 2**56, 2**64 - 1], np.uint64)
    assert sd._leading(x).tolist() == [7, 7, 6, 1, 0, 0]


def test_equal_strings_have_the_same_anchor():
    r = np.random.default_rng(1)
    part = r.integers(0, 4, 150, dtype=np.uint8)
    a, b = (np.concatenate([r.integers(0, 4, k, dtype=np.uint8), part, r.integers(0, 4, 90, dtype=np.uint8)]) for k in (37, 280))
    anchors = []
    for text, at in ((a, 37), (b, 280)):
        row, place, n, h, d = sd.pieces(text, np.array([0, len(text)]), 100, 32)
        assert (place[1:] == place[:-1] + n[:-1]).all() and place[-1] + n[-1] == len(text) - 99
        anchors.append(np.repeat(h, n)[at : at + 51])
    assert (anchors[0] == anchors[1]).all()


def model(rows, length):
    """Rows equal in id and text are one document; those of one id are in the order that the operator chooses."""
    seen, out = {}, []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = {}
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen or w in own:
                gone[p : p + length] = b"\x01" * length
            own[w] = 1
        seen |= own
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [text(r.randrange(25))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            parts += [s[r.randrange(10) : len(s) - r.randrange(10)], text(r.randrange(10))]
        rows.append((k, " ".join(parts)))
    rows += [(k, shared[0]) for k in range(200, 230)] + [(k, text(3) + shared[1] + text(3)) for k in range(300, 340)]
    return [(None, shared[2]), (-4, shared[3]), *rows, (400, None), (401, ""), (402, "ab" * 3000), (403, "a" * 2500), (404, "é" * 200), (405, "b" * 99), (406, "b" * 100), (407, "b" * 101)]


@pytest.mark.parametrize("most", [2000, 3])
def test_passages_against_all_strings(spark, sorted_rows, passages, monkeypatch, most):
    monkeypatch.setattr(sd, "HELD", 50)
    monkeypatch.setattr(sd, "BATCH", 3000)
    monkeypatch.setattr(sd, "CHUNK", 1500)  # long texts in parts
    df = spark.createDataFrame(passages, "doc_id long, text string").withColumns({"place": F.lit(1), "doc": F.lit("x"), "gone": F.lit(2), "n_spans": F.lit(3)}).repartition(5)
    out = sd.dedup_passages(df, keep_text=False, digest=True, most=most)
    expected = model(passages, 100)
    assert sorted_rows(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected
    assert sum(x[2] for x in expected) > 20_000


def test_common_and_rare_anchors_share_a_fetch(spark, passages, monkeypatch):
    calls, fetch = [], sd._fetched
    monkeypatch.setattr(sd, "_fetched", lambda *a: (calls.append(a), fetch(*a))[1])
    df = spark.createDataFrame(passages, "doc_id long, text string")
    out = sd.dedup_passages(df, keep_text=False, most=3)
    assert len(calls) == 1  # else all texts are shuffled once more
    assert calls[0][1].select("common").distinct().count() == 2
    assert out.agg(F.sum("n_removed")).first() == sd.dedup_passages(df, keep_text=False).agg(F.sum("n_removed")).first()


def test_kept_texts_and_other_columns(spark, passages):
    df = spark.createDataFrame(passages, "doc_id long, text string").withColumn("doc", F.lit("x"))
    got = {r.doc_id: r for r in sd.dedup_passages(df, digest=True).collect()}
    assert got[400].text is None and got[401].text == "" and got[0].doc == "x"
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed for r in got.values() if r.text is not None)
    assert got[404].text == "é" and got[404].n_removed == 398  # the string two bytes on starts earlier, too


def test_rows_of_one_id(spark, sorted_rows):
    a, b = ("x" * 50 + "y" * 80), ("z" * 30 + "y" * 80 + "x" * 50)
    got = sorted_rows(sd.dedup_passages(spark.createDataFrame([(1, a), (1, a), (1, b), (2, a)], "doc_id long, text string"), digest=True, keep_text=False))
    assert len(got) == 4 and got[0] == got[1] if got[0][1] == got[1][1] else got[1] == got[2]  # equal rows have equal results
    assert [r for r in got if r[0] == 2][0][2] == 130  # all of it is earlier
    assert sum(r[2] for r in got if r[0] == 1) == 0  # nothing of 100 bytes is shared


def test_no_rows(spark):
    assert sd.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_of_several_megabytes(spark, sorted_rows):
    r = random.Random(11)
    text = "".join(r.choices("abcdefgh ", k=2_300_000))
    cut = sd.CHUNK
    text = text[: cut - 60] + text[100:400] + text[cut + 240 : 2 * cut - 250] + text[50:550] + text[2 * cut + 250 :]  # repeats over the ends of parts
    rows = [(1, text), (2, text[cut - 500 : cut + 500]), (3, "é" + text[: cut + 5]), (4, "z" * 1_200_000)]
    got = sorted_rows(sd.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False, digest=True))
    assert got == model(rows, 100)


def test_parts_and_tasks_of_any_size(monkeypatch, passages):
    """What tasks do, in small portions: parts cover each place once, and equal pieces keep one first in each portion."""
    import pyarrow as pa

    texts = [t for _, t in passages]
    batch = pa.record_batch({"text": texts})
    monkeypatch.setattr(sd, "CHUNK", 1500)
    monkeypatch.setattr(sd, "HELD", 40)
    places, found = [], []
    for buf, off, rows, begin in sd._chunks(batch, 100):
        row, place, n, h, d = sd.pieces(buf, off, 100, 32)
        doc = rows[row]
        found.append({"h": h.view(np.int64), "d": d.view(np.int64), "doc": doc, "alike": doc * 0, "place": place + begin[row], "n": n.astype(np.int32)})
        places += [(a, b + k) for a, b, m in zip(doc.tolist(), found[-1]["place"].tolist(), n.tolist(), strict=True) for k in range(m)]
    assert sorted(places) == [(k, p) for k, t in enumerate(texts) for p in range(len((t or "").encode()) - 99)]
    out = pa.Table.from_batches(list(sd._settled(iter(found)))).to_pylist()
    assert len(out) == sum(len(f["h"]) for f in found) and any(x["again"] for x in out)
    of = {(x, p): h for f in found for h, x, p in zip(f["h"].tolist(), f["doc"].tolist(), f["place"].tolist(), strict=True)}
    assert all(x["h"] == of[x["doc"], x["place"]] for x in out if not x["again"])
    kinds = lambda rows: {(of[x["doc"], x["place"]], x["d"]) for x in rows}
    assert kinds(out) == kinds([x for x in out if not x["again"]])
