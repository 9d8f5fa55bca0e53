"""Whole tables against plain models: scalar FTRL, a generator of personal values, the template tree, the exact search."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupelens.llm import ann, common, mixing, pii, toxicity, urlfilter

KEY = b"model"
M = 2**64 - 1


# ---- toxicity ----


def fmix(h):
    h ^= h >> 33
    h = h * int(common.MIX1) & M
    h ^= h >> 33
    h = h * int(common.MIX2) & M
    return h ^ h >> 33


def features(text):
    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())
    w = [int(common.WORDS.spans(np.frombuffer(x.lower(), np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in words]
    found = set(w)
    for gap, factor in ((1, toxicity.PAIR), (2, toxicity.SKIP)):
        found |= {fmix((w[i] * int(factor) + w[i + gap]) & M) for i in range(len(w) - gap)}
    return sorted({h % toxicity.DIMENSIONS for h in found})


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def ftrl(examples):
    """Weights by the published update, a coordinate at a time."""
    bias, z, n = toxicity.DIMENSIONS, {}, {}

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    rng = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for k in rng.permutation(len(examples)):
            found, label = examples[k]
            at = [*found, bias]
            w = {i: weight(i) for i in at}
            g = sigmoid(sum(w.values())) - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_and_scores_are_those_of_scalar_updates(docs, spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Vile", "nasty", *(f"w{k}" for k in range(40))]) for _ in range(r.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, "Größe, 中文! vile-nasty")]
    labels = [(i, 1, int("vile" in t.lower())) for i, t in rows[:90]]
    at, w = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = ftrl([(features(t), y) for (_, t), (_, _, y) in zip(rows, labels, strict=False)])
    assert dict(zip(at.tolist(), w.tolist(), strict=True)).keys() == want.keys()
    assert all(math.isclose(x, want[i], rel_tol=1e-9) for i, x in zip(at.tolist(), w.tolist(), strict=True))
    for x in toxicity.score(docs(rows), at, w).collect():
        p = sigmoid(sum(want.get(i, 0.0) for i in [*features(x.text), toxicity.DIMENSIONS]))
        assert math.isclose(x.score, p, rel_tol=1e-5) and x.predicted == int(x.score >= 0.3)


# ---- pseudonyms ----


def values(r):
    """(kind, text, whether it is valid) of one drawn value."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind, good = r.choice(["card", "iban", "ssn", "ipv4", "date", "email", "plain"]), r.random() < 0.6
    if kind == "card":
        body = "4" + digits(14)
        check = next(c for c in "0123456789" if sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body + c)))) % 10 == 0)
        return kind, body + (check if good else str((int(check) + 1) % 10)), good
    if kind == "iban":
        account = digits(18)
        check = 98 - int(account + "131400") % 97  # DE
        return kind, f"DE{check if good else (check + 5) % 97:02d}{account}", good
    if kind == "ssn":
        return kind, f"{r.randrange(1, 600):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999) if good else 0:04d}", good
    if kind == "ipv4":
        return kind, ".".join(str(r.randrange(1, 256) if good else r.randrange(256, 999)) for _ in range(4)), good
    if kind == "date":
        return kind, f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29) if good else r.randrange(32, 99):02d}", good
    if kind == "email":
        return kind, f"u{digits(3)}@{'x' if good else '_'}y.example.org" if good else f"u{digits(2)}@", good
    return kind, r.choice(["3.14", "v1.2", "12345", "word", "a-b", "100%"]), False


def test_tables_of_personal_values(docs):
    r = random.Random(11)
    there = pii.Pseudonyms(KEY)
    rows, want = [], {}
    for i in range(400):
        drawn = [values(r) for _ in range(r.randrange(0, 8))]
        rows.append((i, " . ".join(["Text", *(t for _, t, _ in drawn), "end"])))
        want[i] = (" . ".join(["Text", *(there(t)[0] if good else t for _, t, good in drawn), "end"]), sum(good for *_, good in drawn), {k: sum(good and k == kind for kind, _, good in drawn) for k in pii.KINDS})
    got = pii.pseudonymize(docs(rows), KEY).collect()
    assert len(got) == 400
    for x in got:
        text, n, kinds = want[x.doc_id]
        assert x.text == text and x.n_values == n and {k: x[f"n_{k}"] for k in pii.KINDS} == kinds
    back = pii.pseudonymize(pii.pseudonymize(docs(rows), KEY), KEY, back=True)
    assert {x.doc_id: x.text for x in back.collect()} == dict(rows)


# ---- URL templates ----


def tree(shapes):
    """{shape: (purity as a fraction, members of its template)} of {shape: (pages, labels, bad)}, by walking down."""
    done = []

    def walk(members, level):
        here = [s for s in members if len(s) > level]
        done_here = [s for s in members if len(s) <= level]
        many, pages, known = len(here) > 1, sum(shapes[s][0] for s in here), sum(shapes[s][1] for s in here)
        if done_here:
            done.append(done_here)
        if not (many and pages >= urlfilter.SUPPORT and known > 0):
            if here:
                by = {}
                for s in here:
                    by.setdefault(s[level:], []).append(s)
                done.extend(by.values())
            return
        seg = {}
        for s in here:
            seg.setdefault(s[level], []).append(s)
        total = {k: [sum(shapes[s][j] for s in v) for j in range(3)] for k, v in seg.items()}
        named = {}
        for k, (n, labels, _) in total.items():
            named.setdefault(k if n >= urlfilter.SUPPORT or labels else "*", []).append(k)
        stats = {a: (sum(total[k][1] for k in ks), sum(total[k][2] for k in ks)) for a, ks in named.items()}
        bins = {}
        for a, s in stats.items():
            bins.setdefault(s, []).append(a)
        order = sorted((b for b in bins if b[0]), key=lambda b: (b[1] / b[0], b[0])) + [b for b in bins if not b[0]]
        groups, n, bad = [], 0, 0
        for labels, b in order:
            m, k = labels * len(bins[labels, b]), b * len(bins[labels, b])
            if not groups:
                same = False
            elif n == 0 or m == 0:
                same = n == m
            else:
                p = (bad + k + 1) / (n + m + 2)
                same = abs(bad / n - k / m) <= urlfilter.ALIKE * math.sqrt(p * (1 - p) * (1 / n + 1 / m))
            if same:
                groups[-1] += bins[labels, b]
                n, bad = n + m, bad + k
            else:
                groups.append(list(bins[labels, b]))
                n, bad = m, k
        for g in groups:
            walk([s for a in g for k in named[a] for s in seg[k]], level + 1)

    walk(list(shapes), 0)
    out = {}
    for members in done:
        labels, bad = (sum(shapes[s][j] for s in members) for j in (1, 2))
        purity = Fraction(bad + int(urlfilter.BAD_PRIOR), labels + int(urlfilter.BAD_PRIOR + urlfilter.GOOD_PRIOR))
        for s in members:
            out[s] = (purity, frozenset(members))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_tree_is_that_of_a_walk(spark, seed):
    r = random.Random(seed)
    share = {}
    rows = []
    for _ in range(900):
        host, path = r.choice(["h", "h", "h", "i", "j"]), []
        for depth in range(r.randrange(1, 5)):
            path.append(r.choice("abcdefgh"[: 2 + 2 * depth]) if r.random() < 0.8 else str(r.randrange(50)))
        p = share.setdefault((host, *path[:2]), r.choice([0.0, 0.05, 0.5, 1.0]))
        rows.append((host, "/" + "/".join(path), None if r.random() < 0.4 else int(r.random() < p)))
    got = urlfilter.templates(spark.createDataFrame(rows, "host string, path string, label int")).collect()
    by = {}
    for host, path, label in rows:
        key = tuple("*" if re.search("[0-9]", s) else s for s in path.split("/") if s)
        n, labels, bad = by.setdefault(host, {}).get(key, (0, 0, 0))
        by[host][key] = (n + 1, labels + (label is not None), bad + (label or 0))
    members = {}
    for x in got:
        members.setdefault((x.host, x.template), set()).add(tuple(x.shape))
    assert len(got) == sum(map(len, by.values()))
    for x in got:
        purity, same = tree(by[x.host])[tuple(x.shape)]
        assert members[x.host, x.template] == same, (x.host, x.shape)
        assert math.isclose(x.purity, purity) and x.rejected == (purity >= Fraction(6, 10))


def test_html_labels(spark):
    words = " ".join(f"word{i}" for i in range(60))
    cases = [(f"<p>{words}</p>", 0), ("<p>" + "a | b !! c; " * 30 + "</p>", 1), ("<b>" + "spam " * 80 + "</b>", 1), ("<p>short page</p>", None), (None, None), ("", None), (f"<script>{'x;' * 500}</script><!-- {'!' * 500} --><p>{words}</p>", 0), ("<div " * 20000, None)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {x.i: x.l for x in df.select("i", urlfilter.html_label(F.col("html")).alias("l")).collect()}
    assert [got[i] for i in range(len(cases) - 1)] == [w for _, w in cases[:-1]]


def test_templates_within_one_host_differ_by_content(spark):
    good, bad = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>", "<p>" + "a | b !! c; " * 30 + "</p>"
    rows = [(f"http://x.org/{k}/{i}", h if i % 2 else "<p>thin</p>") for k, h in (("news", good), ("junk", bad)) for i in range(30)] + [("http://x.org/other/1", None), (None, bad), ("http://y.org/junk/1", good)]
    pages = spark.createDataFrame([(i, u, h, "s", True) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, shape string, rejected boolean")
    got = urlfilter.judge(pages, (), urlfilter.html_label(F.col("html")))
    assert got.columns == ["page_id", "url", "html", "shape", "rejected", "host", "path", "rule", "verdict", "template"]
    for x in got.collect():
        assert x.verdict == ("block" if (x.url or "").startswith("http://x.org/junk/") else "allow") and x.shape == "s" and x.rejected is True
    few = urlfilter.BROADCAST_TEMPLATES
    try:
        urlfilter.BROADCAST_TEMPLATES = 0  # salted joins
        again = urlfilter.judge(pages, (), urlfilter.html_label(F.col("html")))
        assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    finally:
        urlfilter.BROADCAST_TEMPLATES = few


# ---- neighbours and mixing ----


def test_vectors_of_any_size_and_ids_of_two_dimensions(spark):
    r = np.random.default_rng(5)
    big = [(i, (r.standard_normal(4) * 1e200).tolist()) for i in range(40)]
    small = [(100 + i, (r.standard_normal(3) * 1e-200).tolist()) for i in range(40)]
    twice = [(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, 1.0])]
    df = spark.createDataFrame([*big, *small, *twice], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, F.pmod("vec_id", F.lit(100)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    rows = dict(big) | dict(small)  # the shorter vector of an id counts
    rows |= {100: [1.0, 2.0], 1: [1.0, 2.0]}
    for q in (0, 100):
        near = sorted((math.dist(v, rows[q]), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:10]
        assert [i for i, _ in got[q]] == [i for _, i in near] and np.allclose([s for _, s in got[q]], [s for s, _ in near], rtol=1e-12, atol=0)
    assert len({i for i, _ in got[0]}) == 10 and got[100] == [(1, 0.0)]


def test_mixing_keeps_columns_of_any_name(odd):
    names = ["_source", "_bin", "_key", "_q", "_q_id", "_end", "_rest", "_passes", "_salt", "_more", "in0", "a.b", "words"]
    wide = odd.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for monkey in (mixing.BROADCAST_SOURCES, 0):
        old, mixing.BROADCAST_SOURCES = mixing.BROADCAST_SOURCES, monkey
        try:
            got = mixing.mix(wide, keep_text=True)
            assert got.columns == [*wide.columns, *mixing.RESULT]
            assert all(x[n] == (None if x.doc_id is None else f"{n}{x.doc_id}") for x in got.collect() for n in names)
        finally:
            mixing.BROADCAST_SOURCES = old
