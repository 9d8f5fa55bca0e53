"""The prefix trie and phrase collocations against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dupelens.llm import collocations, prefixtrie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"


# ---- prefix trie ----


def trie_model(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in by.items()}
    conv, members, kids = {}, defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        conv[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(conv[c]) + 1):
            members[tuple(conv[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, below = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in kids[k]) or 1
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(below[x][1] for x in kids[k])
        below[k] = leaves, saved
        ends = ",".join(str(c) for c in members[k] if len(conv[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df, sorted_rows):
    turns = prefixtrie.signed(df)
    convs = turns.select("conv_id").distinct()
    return sorted_rows(prefixtrie.prefix_trie(prefixtrie.rebuilt(turns, convs), convs))


def test_trie_of_shared_beginnings_and_odd_rows(spark, sorted_rows, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 4)
    monkeypatch.setattr(prefixtrie, "IDS", 3)
    monkeypatch.setattr(prefixtrie, "BROADCAST_CONVS", 3)
    r = random.Random(4)
    rows = []
    for c in [*range(60), 100, 101, 117, 205, 206, 299, 300]:  # 2xx without the conversation they begin with
        n = r.choice([1, 1, 2, 3, 5, 9, 14])
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(["a", "a", "bb", None, "é🙂", ""])) for t in range(n)]
    rows += [(7, 3, "user", "again")] * 3 + [(None, 1, "user", "nobody's"), (8, None, None, None), (-5, 1, "user", "a")]
    rows += [(c, t, "user", "same") for c in range(400, 420) for t in range(20)]  # one conversation, many times
    df = spark.createDataFrame(rows, TURNS)
    assert trie(df, sorted_rows) == trie_model(rows)


def test_trie_of_nothing_and_of_the_empty_conversation(spark, sorted_rows):
    assert trie(spark.createDataFrame([], TURNS), sorted_rows) == []
    one = [(1, 0, "user", "x")]  # all its turns would come from conversation 0
    extra = spark.createDataFrame(one, TURNS).withColumns({"i": F.lit("x"), "sig": F.lit(1), "depth": F.lit(2), "open": F.lit(3)})
    assert trie(extra, sorted_rows) == trie_model(one)


# ---- collocations ----


def phrase_model(rows, min_count, max_words=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inner = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * found[p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)] + ["über", "中文", "é"]
    rows = []
    for k in range(400):
        words = [r.choice(vocabulary[: r.choice([3, 10, 43])]) for _ in range(r.randrange(30))]
        if k % 3 == 0:
            words[2:2] = ["New", "York", "Stock", "Exchange", "of", "old"]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; "]) for w in words)
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), ("en", ""), ("en", " \t.,"), ("xx", "z" * 5000 + " y"), ("en", "aa " * 3000), ("en", rows[0][1])]


def phrases_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"k": F.lit(1), "bundle": F.lit(2), "phrase": F.lit("x"), "n": F.lit(0)})
    return sorted(map(tuple, collocations.collocations(df, **options).collect()))


def test_phrases_against_counting(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "BUNDLE_BYTES", 2000)  # many bundles a task
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", 5)
    monkeypatch.setattr(collocations, "FILTER", 1 << 9)  # full counters, and some that aren't
    monkeypatch.setattr(collocations, "SEGMENTS", 8)
    got = phrases_of(spark, texts, min_count=4)
    assert got == phrase_model(texts, 4) and any(len(x[2].split(" ")) == 5 for x in got)
    assert phrases_of(spark, texts, min_count=30, top=3) == phrase_model(texts, 30, top=3)


def test_lengths_are_added_up_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(collocations, "GROUPS_A_CORE", 1, raising=False)
    seen, frequent = [], collocations._frequent

    def counted(candidates, keys, *rest):
        seen.append((keys, candidates.count()))
        return frequent(candidates, keys, *rest)

    monkeypatch.setattr(collocations, "_frequent", counted)
    cores = spark.sparkContext.defaultParallelism
    rows = [("en", " ".join(f"w{k}" for k in range(50)))] * (40 * cores) + [("de", "a b c")] * (40 * cores)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4 * cores)  # a bundle of a language each
    got = sorted(map(tuple, collocations.collocations(df, min_count=10).collect()))
    assert got == phrase_model(rows, 10)
    levels = [n for keys, n in seen if keys == ["phrase", "word"]]
    groups = -(-4 * cores // 8)  # 8 bundles a core, of both languages, are put together
    assert levels == [groups * (49 + 2), groups * (48 + 1), groups * 47, groups * 46]


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_a_bundle_takes_a_few_times_its_bytes():
    import numpy as np

    r = np.random.default_rng(3)
    vocabulary = np.array([b"w%05d " % k for k in range(20_000)], "S7")
    line = vocabulary[np.minimum(r.geometric(0.001, 900_000), 19_999)]
    texts = [(np.frombuffer(part.tobytes(), np.uint8), np.array([0, 7 * len(part)])) for part in np.split(line, 9)]
    mb, made = peak_mb(lambda: collocations._bundle(texts))
    assert made["n"] == 900_000 and sum(made["counts"].tolist()) == 900_000
    number, at = collocations._unpacked(made["of"]), collocations._positions(made["at"])
    assert [made["names"][k] for k in number[:50]] == [w[:-1] for w in line[:50].tolist()] and (np.diff(at) >= 1).all()
    assert mb < 80  # 6.3 MB of text
    ids = np.arange(len(made["names"])).tobytes()
    row = {"at": made["at"], "of": made["of"], "ids": ids, "word_at": made["at"], "word_of": made["of"], "word_ids": ids}
    mb, found = peak_mb(lambda: collocations._extended(row, 1))
    pairs, counts = np.unique(np.stack([number[:-1], number[1:]], 1)[np.diff(at) == 1], axis=0, return_counts=True)
    assert (found[2] == pairs[:, 0]).all() and (found[3] == pairs[:, 1]).all() and (found[4] == counts).all()
    assert mb < 60


def test_candidates_beyond_what_a_task_holds(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "BUNDLE_BYTES", 2000)
    monkeypatch.setattr(collocations, "GROUPS_A_CORE", 1)
    monkeypatch.setattr(collocations, "HELD_ROWS", 40, raising=False)
    assert phrases_of(spark, texts, min_count=4) == phrase_model(texts, 4)


def test_phrases_of_nothing(spark):
    assert phrases_of(spark, []) == []
    assert phrases_of(spark, [("en", None), (None, "one two")]) == []


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    class Weak(collocations.SpanHash):
        def spans(self, buf, start, end):
            h = super().spans(buf, start, end)
            return h & np.uint64(3) if self.key == collocations.SpanHash(301).key else h

    monkeypatch.setattr(collocations, "SpanHash", Weak)
    data = b"a bb ccc dddd ee a ff bb"
    start = np.array([m.start() for m in re.finditer(rb"\w+", data)])
    end = np.array([m.end() for m in re.finditer(rb"\w+", data)])
    number, names = collocations._spelled(np.frombuffer(data, np.uint8), start, end)
    assert [names[k] for k in number] == data.split()
