"""Pseudonyms, media, neighbours, toxicity and URL rules: brute force, round trips, held-out accuracy."""

import datetime as dt
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupelens.llm import ann, media, pii, toxicity, urlfilter
from dupelens.llm.queries import URL_RULES, op8_url_rules

KEY = b"test"


# ---- pseudonyms ----


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(n):
    f = pii.Feistel(b"k" * 32)
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [f.permute(y, n, "t", back=True) for y in image] == list(range(n))
    odd = [f.permute(x, n, "t", ok=lambda x: x % 2 == 0) for x in range(0, n, 2)]
    assert sorted(odd) == list(range(0, n, 2))


FOUND = {
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "6011000990139424"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0100", "+49 30 1234567", "212-555-0100"],
    "ipv4": ["97.51.17.173", "8.8.8.8", "255.255.255.255"],
    "date": ["2024-02-29", "31.12.1999", "3.7.1999", "31/12/2001", "12/31/2001", "03/07/1999", "1900-01-01", "2099-12-31"],
    "email": ["und.34@mail7.example.com", "A.B+c@x-y.org"],
}
LEFT = ["4111111111111112", "a4111111111111111", "41111111111111111111111", "2023-02-29", "1899-12-31", "300.1.1.1", "1.2.3", "1.2.3.4.5", "000-12-3456", "GB82WEST12345698765431", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "12345678", "x@y", "1 2 3", "3.14159", "0000000000000000"]


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in FOUND.items() for v in vs])
def test_each_kind(kind, value):
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    text = f"Before {value}, after. ({value}) {value}!! end"
    new, count = there(text)
    assert count[kind] == 3 and sum(count.values()) == 3 and value not in new
    one = there(value)[0]
    assert new == text.replace(value, one)  # equal values stay equal
    assert back(new)[0] == text
    layout = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    if kind == "ipv4":
        assert re.fullmatch(r"\d+(\.\d+){3}", one)
    elif kind != "date" or len(value) == 10:
        assert layout(one) == layout(value)
    assert there(one)[1][kind] == 1  # valid again
    assert pii.Pseudonyms(b"other")(value)[0] != one


def test_same_value_in_two_layouts_stays_linked():
    f = pii.Pseudonyms(KEY)
    digits = [re.sub(r"\D", "", f(v)[0]) for v in FOUND["card"][:3]]
    assert len(set(digits)) == 1


def test_clean_text_stays():
    f = pii.Pseudonyms(KEY)
    for t in LEFT + ["", "No numbers here.", "In 2024 it was 100% of 3,000 or 1/2; version 10.2."]:
        assert f(t) == (t, dict.fromkeys(pii.KINDS, 0)), t


def test_dates_stay_dates():
    f = pii.Pseudonyms(KEY)
    days = [dt.date(1900, 1, 1) + dt.timedelta(k) for k in range(0, 73049, 997)]
    new = [f.date(d.isoformat()) for d in days]
    assert len(set(new)) == len(new) and all(1900 <= dt.date.fromisoformat(x).year <= 2099 for x in new)


def test_pseudonyms_over_rows(odd):
    rows = odd.withColumn("n_card", F.lit("clash")).withColumn("text", F.when(F.col("doc_id") == 7, "4111111111111111 x@y.org").otherwise(F.col("text")))
    out = pii.pseudonymize(rows, KEY)
    got = out.collect()
    assert len(got) == 12 and sum(r.n_values for r in got) == 2 and sum(r.n_card for r in got) == 1 and sum(r.text is None for r in got) == 2
    back = pii.pseudonymize(out, KEY, back=True).select("doc_id", "text")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.select("doc_id", "text").collect()))
    assert pii.pseudonymize(rows.limit(0), KEY).count() == 0


# ---- media ----


def payload(text):
    b = (text or "").encode()
    return b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))


def test_media_round_trip(odd, docs, spark, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE", 2000)
    monkeypatch.setattr(media, "STEP", 300)
    r = random.Random(1)
    more = docs([(100 + i, "".join(r.choice("abc é\n") for _ in range(r.randrange(400)))) for i in range(150)] + [(300, "x" * 64), (301, "x" * 63)])
    rows = odd.unionByName(more)
    stored = media.read_archives(spark, media.write_archives(rows), split=1000)
    assert stored.rdd.getNumPartitions() > 5
    got = media.measure(stored).collect()
    want = []
    for x in rows.collect():
        p, png = payload(x.text), media.to_png(payload(x.text))
        want.append((x.doc_id, len((x.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.features(np.frombuffer(p, np.uint8).reshape(-1, 64))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert media.measure(media.read_archives(spark, media.write_archives(odd.limit(0)))).count() == 0


def test_members_are_fetched_again_by_offset(tmp_path):
    w = media._Writer(f"file://{tmp_path}")
    pngs = [media.to_png(payload("t" * k)) for k in (1, 100, 1000)]
    for i, p in enumerate(pngs):
        w.add(i, 1, p)
    name = w.close()["file"][0]

    class Flaky:
        """Fails the first reads of the second member, and gives it damaged once."""

        def __init__(self, f, left):
            self.f, self.left = f, left

        def seek(self, at):
            self.at = at
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            if self.at and self.left:
                if self.left.pop() == "break":
                    raise OSError("gone")
                return bytes(len(data))
            return data

    left = ["damage", "break"]
    m = media.Members(lambda: Flaky(open(tmp_path / name, "rb"), left))
    at, got = 0, []
    for _ in pngs:
        _, _, png, at = m.member(at)
        got.append(png)
    assert got == pngs and m.retried == 2
    os.truncate(tmp_path / name, 200)
    with pytest.raises((OSError, struct.error)):
        media.Members(lambda: open(tmp_path / name, "rb")).member(media.MEMBER.size + len(pngs[0]))


def test_a_picture_is_what_other_readers_see():
    png = media.to_png(payload("hello"))
    assert struct.unpack(">II", png[16:24]) == (64, 1)
    assert media.from_png(png).tobytes() == payload("hello")
    with pytest.raises(ValueError):
        media.from_png(png[:40] + b"?" + png[41:])
    assert media.features(np.zeros((1, 64), np.uint8)).startswith("64x1;mean=0;var=0;cross=0;hist=64,")


# ---- neighbours ----


def exact(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for i, v in ok.items():
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in ok.items() if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.search(df, F.pmod("vec_id", F.lit(100)) == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_small_tables_are_searched_whole(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8)) for i in range(250)]
    rows += [(100, rows[100][1]), (7, rows[100][1]), (8, rows[100][1]), (300, rows[0][1]), (None, rows[0][1]), (500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (600, [float("nan")] + [1.0] * 7), (601, [float("inf")] * 8), (700, [1.0, 2.0]), (701, [1.0, 3.0]), (200, rows[3][1])]
    want, got = exact(rows), search(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=0, atol=1e-12)
    assert search(spark, [(0, [1.0])]) == {} and search(spark, []) == {}


def test_recall_on_scattered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 3000)
    monkeypatch.setattr(ann, "QUERIES", 40)
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x))
    got, want = search(spark, rows, least=100), exact(rows)
    recall = np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want])
    assert len(got) == 60 and all(len(v) == 10 for v in got.values()) and recall >= 0.9


def test_forest_goes_down_to_the_longest_match_and_up_together():
    r = np.random.default_rng(3)
    x = r.standard_normal((500, 16))
    f = ann.Forest(x, trees=10)
    few, all_ = f.candidates(x[:5], 1), f.candidates(x[:5], 500)
    assert all(few[i, i] for i in range(5)) and few.sum() < 200 and all_.all()
    codes = f.hash(x)
    assert all((codes[f.order[:, t], t] == f.codes[:, t]).all() and (np.diff(f.codes[:, t].astype(np.int64)) >= 0).all() for t in range(10))


# ---- toxicity ----


def corpus(n, seed):
    r = random.Random(seed)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        text = [r.choice(words) for _ in range(r.randrange(20, 120))]
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(docs, spark):
    rows, labels = corpus(900, 1)
    d, l = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.score(d, *toxicity.train(d, l.filter(~toxicity.held_out(F.col("doc_id"))))).select("doc_id", "score", "predicted", toxicity.held_out(F.col("doc_id")).alias("out"))
    truth = {i: t for i, _, t in labels}
    got = scored.collect()
    assert {r.doc_id for r in got if r.out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    test = [r for r in got if r.out]
    hits = sum(r.predicted for r in test if truth[r.doc_id])
    assert hits >= 0.9 * sum(truth[r.doc_id] for r in test) and sum(r.predicted for r in test if not truth[r.doc_id]) <= 0.02 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = toxicity.score(d, *toxicity.train(d, l.filter(~toxicity.held_out(F.col("doc_id"))))).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}


def test_scores_of_odd_rows(odd, docs, spark):
    rows, labels = corpus(200, 2)
    l = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    at, w = toxicity.train(docs(rows), l)
    assert len(at) == len(w) <= toxicity.DIMENSIONS + 1 and (w != 0).all()
    out = toxicity.score(odd.withColumn("score", F.lit("clash")), at, w)
    assert out.columns == [*odd.columns, "score", "predicted"] and out.filter("score IS NULL OR predicted = 1").count() == 0 and out.count() == 12
    none = toxicity.train(docs(rows), l.limit(0))
    assert toxicity.score(odd, *none).agg(F.sum("predicted")).first()[0] == 0
    assert toxicity.score(odd.limit(0), at, w).count() == 0


def test_the_sample_is_bounded(docs, spark):
    rows, labels = corpus(60, 3)
    a = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=10)
    b = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(a[0]) != len(b[0])


# ---- URL rules ----


def rule_model(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://a.com", "http://a.com/", "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "https://m.www.example.com/en/a#b", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://notnet/es/", "http://example.com/EN/", "http://É.Org/a", "http://a.com?q=/en/", "a://b://c/d", "http:///p", "http://x.net/es/\n/en", "HTTP://WWW.EXAMPLE.COM/en/z", "http://x.org/1#://y.com/", "://com/"]


def test_rules_against_a_loop(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(None, URLS[5], 1), (3, URLS[3], 1)], "page_id long, url string, verdict int")
    got = urlfilter.judge(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    verdicts = {rule: v for v, rule in URL_RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == rule_model(r.url), r.url
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0


def test_templates_of_bad_labels_are_rejected(spark):
    rows = [(f"/{kind}/{i}/view", bad if i % 2 else None) for kind, bad in (("good", 0), ("fine", 0), ("bad", 1), ("worse", 1), ("new", None)) for i in range(40)]
    rows += [(f"/user{chr(97 + i % 26)}{chr(97 + i // 26)}/x", 0) for i in range(100)] + [("/rare/1", 1)]
    pages = spark.createDataFrame([("h", p, b) for p, b in rows] + [("other", "/bad/1/view", None)], "host string, path string, label int")
    got = {(r.host, "/".join(r.shape)): (r.template, r.rejected) for r in urlfilter.templates(pages).collect()}
    assert got["h", "bad/*/view"][1] and got["h", "worse/*/view"] == got["h", "bad/*/view"]
    assert not any(v[1] for k, v in got.items() if k[1].split("/")[0] not in ("bad", "worse"))
    assert got["other", "bad/*/view"][1] is False and len({v for k, v in got.items() if "user" in k[1]}) == 1
    small = spark.createDataFrame([("h", f"/{k}/{i}", int(k == "bad")) for k in ("ok", "bad") for i in range(20)], "host string, path string, label int")
    model = {"ok": (0 + 1) / (20 + 4), "bad": (20 + 1) / (20 + 4)}
    assert {"/".join(r.shape).split("/")[0]: round(r.purity, 9) for r in urlfilter.templates(small).collect()} == {k: round(v, 9) for k, v in model.items()}


def test_labels_reach_unlabelled_urls_and_rules_come_first(spark):
    pages = spark.createDataFrame([(i, f"http://x.org/spam/{i}") for i in range(30)] + [(100 + i, f"http://x.org/ham/{i}") for i in range(30)] + [(200, "http://y.com/spam/1")], "page_id long, url string")
    label = F.when(F.col("path").startswith("/spam/") & (F.crc32(F.col("path").cast("binary")) % 2 == 0), 1)
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, URL_RULES, label).collect()}
    assert all(got[i] == "block" for i in range(30)) and all(got[100 + i] == "allow" for i in range(30)) and got[200] == "allow"


def test_wide_nodes_keep_unlike_sections_apart(spark):
    """40 even sections, two of them blocked by rules: the others have no labels and stay, whatever the width."""
    sections = ["es", "fr", *("s" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(38))]
    urls = [f"http://x.net/{s}/{i}" for s in sections for i in range(5)] + [f"http://x.net/{c}" for c in ("once", "twice|a")]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert all(r.verdict == ("block" if r.path.split("/")[1] in ("es", "fr") else "allow") for r in got) and len(got) == len(urls)
    assert len({r.template for r in got if r.path.startswith(("/es/", "/fr/"))}) == 1

    # 600 branches of equal support, of three shares of bad labels, and a few without labels
    rows = [(f"/{'abc'[k % 3]}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}/{i}", int(i < (0, 5, 10)[k % 3])) for k in range(600) for i in range(10)]
    rows += [(f"/d{chr(97 + k)}/{i}", None) for k in range(3) for i in range(10)]
    got = urlfilter.templates(spark.createDataFrame([("h", p, b) for p, b in rows], "host string, path string, label int")).collect()
    by = {k: {(r.template, r.rejected) for r in got if r.shape[0][0] == k} for k in "abcd"}
    assert [[rejected for _, rejected in by[k]] for k in "abcd"] == [[False], [False], [True], [False]] and len(set.union(*by.values())) == 4
    assert by["d"] == {("/da|db|dc/*", False)} and all(len(t) < 40 for t, _ in by["a"])


def test_the_url_query_has_no_list_of_hosts(spark, tmp_path):
    hosts = ["downloads-cdn.example.org", "alphabets.example.org", "antispam.example.net", "casino-win.example.org", "poker-online.example.org"]
    urls = [f"https://{h}/{s}/{i}" for h in hosts for s in ("en", "es") for i in range(6)]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op8_url_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(urls) and all(r.verdict == ("block" if r.rule == "net/es/" else "allow") for r in got)


@pytest.mark.parametrize("depth", [5, 7, 20])
def test_deep_sections_have_their_own_verdicts(spark, depth):
    top = "/".join("s" + chr(97 + i) for i in range(depth))
    pages = spark.createDataFrame([(f"/{top}/{kind}/{i}", bad) for kind, bad in (("good", 0), ("bad", 1), ("new", None)) for i in range(20)], "path string, label int")
    got = {r.shape[depth]: r.rejected for r in urlfilter.templates(pages.withColumn("host", F.lit("h"))).collect()}
    assert got == {"good": False, "bad": True, "new": False}


@pytest.mark.parametrize("kind,value,stays", [("date", "2024-05-17T12:00:00Z", r".{10}(T12:00:00Z)"), ("date", "2024-05-17T12:00:00.123+02:00", r".{10}(T12:00:00\.123\+02:00)"), ("phone", "555 123 4567", "()"), ("phone", "1-555-123-4567", "(1-).*"), ("phone", "1 555 123 4567", "(1 ).*"), ("phone", "1.555.123.4567", r"(1\.).*"), ("phone", "1(555) 123-4567", r"(1\().*")])
def test_timestamps_and_us_numbers(kind, value, stays):
    text = f"On {value}, or ({value})"
    new, count = pii.Pseudonyms(KEY)(text)
    one = pii.Pseudonyms(KEY)(value)[0]
    assert count[kind] == 2 == sum(count.values()) and value not in new and new == text.replace(value, one)
    assert stays == "()" or re.fullmatch(stays, one)[1] == re.fullmatch(stays, value)[1]
    assert re.sub(r"\d", "0", one) == re.sub(r"\d", "0", value) and pii.Pseudonyms(KEY, back=True)(new)[0] == text
