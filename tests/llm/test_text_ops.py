"""N-gram join, line dedup, mixing, token files and BPE against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dupelens.llm import bpe, common, linededup, mixing, ngramjoin, tokenfile
from dupelens.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- n-gram Jaccard join ----


def grams(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def join_model(rows):
    sets = [grams(t) for _, t in rows]
    near = lambda a, b: a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    n = len(rows)
    group = list(range(n))
    for _ in range(n):
        for i, j in itertools.combinations(range(n), 2):
            if near(sets[i], sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    out = []
    least = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    for i in range(n):
        links = [j for j in range(n) if j != i and near(sets[i], sets[j])]
        texts = {sets[j] for j in links if sets[j] != sets[i]}
        out.append((rows[i][0], least(k for k in range(n) if group[k] == group[i]), least(k for k in range(n) if sets[k] == sets[i]), len(links), len(texts)))
    return sorted(out, key=repr)


def edited(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_join_against_all_pairs(docs, sorted_rows):
    r = random.Random(1)
    rows = []
    for _ in range(12):
        base = [f"v{r.randrange(500)}" for _ in range(r.randrange(40, 200))]
        rows += [" ".join(base), " ".join(base).upper()] + [edited(r, base, k) for k in (1, 1, 2, 4, 9)]
    rows += ["same words here", "Same\tWORDS  here", "short", "", None, "a b c d e", "a b c d e"]
    rows = list(zip(r.sample(range(1000), len(rows)), rows, strict=True))
    assert sorted_rows(ngramjoin.jaccard_join(docs(rows))) == join_model(rows)


def test_large_group_is_whole_and_chained(docs, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)  # forces many blocks
    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(r, base, r.randrange(0, 4))) for i in range(60)] + [(1000 + i, " ".join(base)) for i in range(40)]
    assert sorted(map(tuple, ngramjoin.jaccard_join(docs(rows)).collect()), key=repr) == join_model(rows)
    monkeypatch.setattr(ngramjoin, "HOT", 3)
    monkeypatch.setattr(ngramjoin, "BROADCAST_NODES", 0)  # salted joins
    assert sorted(map(tuple, ngramjoin.jaccard_join(docs(rows)).collect()), key=repr) == join_model(rows)


def test_join_takes_odd_rows(odd, sorted_rows, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted_rows(ngramjoin.jaccard_join(odd)) == join_model(rows)
    assert ngramjoin.jaccard_join(odd.limit(0)).count() == 0
    clash = odd.withColumn("class_id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("node", F.lit(2))
    assert ngramjoin.jaccard_join(clash).columns == ["doc_id", "class_id", "copy_id", "n_links", "n_text_links"]


def test_one_of_each(docs):
    r = random.Random(3)
    base = [f"c{i}" for i in range(100)]
    d = docs([(5, " ".join(base)), (4, edited(r, base, 1)), (9, "other text of five words"), (9, "other text of five words"), (2, "alone in its own group here")])
    kept = ngramjoin.one_of_each(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 9]


def test_one_of_each_goes_by_rows(docs):
    """Repeated ids with different texts, and null ids near a row with an id."""
    r = random.Random(4)
    base, other = ([f"{c}{i}" for i in range(100)] for c in "xy")
    x, y, near_x, near_y = " ".join(base), " ".join(other), edited(r, base, 1), edited(r, other, 1)
    alone = ["alone in a group of its own", "another one far from all others", "and of no id but near none"]
    rows = [(1, x), (7, near_x), (7, alone[0]), (7, alone[0].upper()), (3, y), (3, alone[1]), (4, near_y), (None, near_x), (None, y), (None, alone[2]), (8, near_y), (8, near_x)]
    d = docs(rows)
    got = ngramjoin.one_of_each(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=repr) == sorted([(1, x), (7, alone[0]), (3, y), (3, alone[1]), (None, alone[2])], key=repr)
    two = [(r.doc_id, r.text) for r in ngramjoin.one_of_each(docs([(2, x), (2, near_x), (2, alone[0]), (5, near_x), (5, alone[0])])).collect()]
    assert len(two) == 2 and {i for i, _ in two} == {2} and (2, alone[0]) in two


def test_bands_reach_the_recall():
    for t, recall, rows in ((0.8, 0.999, 5), (0.5, 0.95, 3), (0.9, 0.99, 8)):
        b = ngramjoin.banding(t, recall, rows)
        assert 1 - (1 - t**rows) ** b >= recall > 1 - (1 - t**rows) ** (b - 1)


# ---- line dedup ----


def lines_model(rows, chars=20, docs=3):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: line.strip(strip).translate(LOW)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= chars and len(held[key(x)]) >= docs and max(held[key(x)]) != (-(2**63) if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = ["This line is in many documents", "  this LINE is in many documents\t", "Ünïcödé line of twenty", "short", "", "only here and there, a line", "x" * 19, "x" * 20, "y" * 5000]


def test_lines_against_counting(docs, sorted_rows):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(LINES) for _ in range(r.randrange(1, 9)))) for i in r.sample(range(500), 60)] + [(600, "\n\n"), (601, None), (601, None), (602, LINES[0] + "\n")]
    got = linededup.dedup_lines(docs(rows), keep_text=False, digest=True)
    assert sorted_rows(got) == lines_model(rows)


def test_lines_take_odd_rows(odd, sorted_rows):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted_rows(linededup.dedup_lines(odd, keep_text=False, digest=True)) == lines_model(rows)
    whole = linededup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")))
    assert whole.columns == [*odd.columns, "n_lines", "n_dropped"] and whole.filter("text IS NULL").count() == 2
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_many_shards_and_a_small_cache(docs, sorted_rows, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    rows = [(i, "\n".join(f"repeated line number {k:05d}" for k in range(i % 7, 60))) for i in range(30)]
    assert sorted_rows(linededup.dedup_lines(docs(rows), keep_text=False, digest=True)) == lines_model(rows)
    monkeypatch.setattr(linededup, "CACHE_BYTES", 1)
    monkeypatch.setattr(linededup, "WAIT_BYTES", 1)
    assert sorted_rows(linededup.dedup_lines(docs(rows), keep_text=False, digest=True)) == lines_model(rows)
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    shard = linededup.Shard(linededup._shard_file(keys, keys + np.uint64(1), np.full(3000, 3), np.arange(3000)))
    ok, keeper = shard.probe(keys, keys + np.uint64(1))
    assert ok.all() and (keeper == np.arange(3000)).all()
    assert not shard.probe(keys, keys)[0].any() and not shard.probe(keys + np.uint64(5), keys)[0].any()


def test_shards_are_read_once_for_a_split(tmp_path):
    rng, bits = np.random.default_rng(5), 6
    texts = ["\n".join(f"line {k:08d} that may be in the index" for k in rng.integers(0, 5000, 400)) for _ in range(40)]
    line = pa.array([f"line {k:08d} that may be in the index" for k in range(0, 5000, 2)])
    *_, h1, h2 = linededup.line_keys(*common.text_bytes(line), 20)
    for n in range(2**bits):
        mine = (h1 >> np.uint64(64 - bits)) == n
        (tmp_path / f"{n}.npz").write_bytes(linededup._shard_file(h1[mine], h2[mine], np.full(mine.sum(), 3), np.flatnonzero(mine)))
    reads = []

    class Counted(linededup.Shards):
        def get(self, number):
            reads.append(number)
            return super().get(number)

    parts = [pa.record_batch({"doc_id": [i, i + 1], "text": texts[i : i + 2], "extra": [None, "x"]}) for i in range(0, 40, 2)]
    for limit, most in ((1 << 30, 1), (1, len(parts))):
        reads.clear()
        got = list(linededup.probed_slices(iter(parts), Counted(f"file://{tmp_path}", 1), bits, 20, limit))
        assert len(reads) <= most * 2**bits and set(reads) == set(range(2**bits)) and (most > 1 or len(reads) == 2**bits)
        assert [p.to_pydict() for p, _, _ in got] == [p.to_pydict() for p in parts]
        for part, hit, keeper in got:
            ids = [int(x.split()[1]) for t in part["text"].to_pylist() for x in t.split("\n")]
            assert hit.tolist() == [i % 2 == 0 for i in ids] and (keeper[hit] == np.array(ids)[hit] // 2).all()
    assert not any(hit.any() for _, hit, _ in linededup.probed_slices(iter(parts), None, 0, 20, 1 << 30))
    assert list(linededup.probed_slices(iter([]), None, 0, 20, 1)) == []


def test_perfect_hash_is_minimal_and_equal_halves_stay_apart():
    keys = np.random.default_rng(2).integers(1, 2**63, 10_000, dtype=np.uint64)
    h = linededup.PerfectHash.build(keys)
    assert sorted(h.place(keys).tolist()) == list(range(10_000))
    same = linededup.Shard(linededup._shard_file(np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64), np.array([3, 3, 3]), np.array([10, 20, 30])))
    ok, keeper = same.probe(np.array([7, 7, 9, 7], np.uint64), np.array([2, 1, 3, 4], np.uint64))
    assert ok.tolist() == [True, True, True, False] and keeper[:3].tolist() == [20, 10, 30]


# ---- mixing ----


def mix_model(rows, quality, seed="mix-1"):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {n: sum(z for z, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(n for n in names if total[n]), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 2 * total[n]}
        if not full:
            target |= {n: weight[n] * level for n in open_}
            break
        target |= {n: 2.0 * total[n] for n in full}
        left -= sum(target[n] for n in full)
        open_ -= full
    target |= {n: 0.0 for n in names if not total[n]}
    taken = [0] * len(rows)
    for n in names:
        passes = int(target[n] // total[n]) if total[n] else 0
        rest, before = target[n] - passes * total[n], 0
        key = lambda i: (-math.log((int(hashlib.md5(((str(rows[i][0]) if rows[i][0] is not None else "") + seed).encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality.get(rows[i][0], 1.0), -math.inf if rows[i][0] is None else rows[i][0], size[i])
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == n), key=key):
            more = rest > 0 and rest - before > 0 and size[i] <= 2 * (rest - before)
            taken[i] = size[i] * (passes + more)
            before += size[i]
    return sorted(((r[0], z, total[r[2]], round(target[r[2]], 6), t) for r, z, t in zip(rows, size, taken, strict=True)), key=repr)


def mixed(df, labels):
    out = mixing.mix(df, quality=mixing.quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken")
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in out.collect()), key=repr)


def test_mixing_against_a_loop(docs, spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randrange(1, 200)), r.choice(["big"] * 12 + ["mid"] * 4 + ["x", "y", None])) for i in range(300)]
    labels = [(i, r.randrange(2), 0) for i in range(0, 300, 2)]
    quality = {i: 2.0 if q else 0.5 for i, q, _ in labels}
    got = mixed(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == mix_model(rows, quality)
    by = defaultdict(lambda: [0, 0.0])
    for (i, size, _, target, taken), source in ((g, dict((a, c) for a, _, c in rows)[g[0]]) for g in got):
        by[source][0] += taken
        by[source][1] = target
        assert taken <= 2 * size
    assert all(abs(a - t) <= 200 for a, t in by.values())


def test_mixing_takes_odd_rows(odd, spark, monkeypatch):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    want = mix_model(rows, {3: 2.0})
    assert mixed(odd, labels) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_QUALITY", 0)
    assert mixed(odd, labels) == want
    assert mixing.mix(odd.limit(0)).count() == 0
    clash = mixing.mix(odd.withColumn("size", F.lit("x")), keep_text=True)
    assert "text" in clash.columns and dict(clash.dtypes)["size"] == "bigint"
    assert mixing.mix(odd.filter("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_runs_no_python(docs):
    plan = mixing.mix(docs([(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_better_documents_are_likelier(docs, spark):
    d = docs([(i, "a b c d", "s") for i in range(2000)] + [(5000 + i, "a", "t") for i in range(1)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    out = mixing.mix(d, quality=mixing.quality_weights(labels), share=0.75).filter("taken > 0 AND source = 's'").groupBy((F.col("doc_id") % 2).alias("q")).count()
    n = {r.q: r["count"] for r in out.collect()}
    assert n[1] > n[0]


# ---- token files ----


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 1023, 1024, 1025, 5000, 300_000])
def test_simple8b_round_trip(n):
    r = np.random.default_rng(n)
    for v in (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) >> r.integers(0, 64, n).astype(np.uint64), np.zeros(n, np.uint64), r.integers(0, 2, n).astype(np.uint64), np.full(n, 2**64 - 1, np.uint64), r.integers(0, 50_000, n).astype(np.uint32)):
        parts = tokenfile.encode(v)
        assert (tokenfile.decode(*parts) == v).all() and len(tokenfile.decode(*parts)) == n
        ids, ends, back, read = tokenfile.unpack(tokenfile.pack(np.arange(3), np.array([0, n, n]), v))
        assert (back == v).all() and ends.tolist() == [0, n, n] and read == len(tokenfile.pack(np.arange(3), np.array([0, n, n]), v))


def test_words_hold_as_many_ids_as_fit():
    words, *_ = tokenfile.encode(np.full(1024, 2**20 - 1, np.uint64))
    assert len(words) == -(-1024 // 3) + (1024 % 3 > 1)
    assert len(tokenfile.encode(np.zeros(60, np.uint64))[0]) == 1


def token_model(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    t.encode_special_tokens = True
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(odd, docs, spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 500)
    monkeypatch.setattr(tokenfile, "READ_TASKS", 3)
    texts = ["don't I'LL he's", "é é ΑΣ ΣΑΣ", "a\x1cb \x85c\xa0d", "<|endoftext|> 12 3.5!!", "İx ǅ ª² ٣٤", "A\nB\tC  d", "word, word. 'word' (word)"] + ["mix %d of wörds and 7 numbers" % i for i in range(200)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = tokenfile.read_tokens(spark, *tokenfile.write_tokens(docs(rows), vocabulary(WORD_VOCABULARY), 1))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == token_model(rows)
    folder, manifest = tokenfile.write_tokens(odd, vocabulary(WORD_VOCABULARY), 1)
    got, want = [tuple(r) for r in tokenfile.read_tokens(spark, folder, manifest).collect()], token_model([(r.doc_id, r.text) for r in odd.collect()])
    strip = lambda rs: sorted(((a, c, d) for a, _, c, d in rs), key=repr)
    assert strip(got) == strip(want) and sorted(r[1] for r in got)[0] == 0
    assert tokenfile.read_tokens(spark, *tokenfile.write_tokens(odd.limit(0), vocabulary(WORD_VOCABULARY), 1)).count() == 0


def test_the_memo_may_start_anew(docs):
    texts = pa.array(["some words here", "other words there", None, "some words here"])
    e = tokenfile.WordEncoder(vocabulary(WORD_VOCABULARY))
    one = e(*common.text_bytes(texts))
    e.limit = 0
    two = e(*common.text_bytes(texts))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


# ---- BPE ----


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(vocabulary(BYTE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(df, **options):
    return bpe.encode(df, vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN, **options)


def test_bpe_is_the_librarys(docs, library):
    r = random.Random(1)
    texts = ["", None, "  a  b \n\n c\t\t d  ", " lead", "trail ", "\n\n x", "I'll  don't'S", "é\xa0 x  y \x1c\x1d z\x85w   q", "a" * 300, "ab" * 150 + "=-" * 99, " " * 200, "中文字符没有空格" * 20, "".join(r.choice("abcdefgh") for _ in range(400)), "٣٤²½ ⅷ x²", "🙂🙃"]
    texts += ["".join(r.choice(" \n\t aAé1!'s　") for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in encoded(docs(list(enumerate(texts))), digest=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_takes_odd_rows_and_decodes(odd, sorted_rows, library):
    out = encoded(odd.withColumn("ids", F.lit("clash")))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    back = bpe.decode(out, vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert encoded(odd.limit(0)).count() == 0


def test_long_words_by_windows(monkeypatch):
    b = bpe.worker(vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)
    r = random.Random(9)
    words = ["".join(r.choice(s) for _ in range(n)) for s in ("ab", "abcdefghij", "the ing", "=-_", "aaaaaab", "中文字符") for n in (65, 130, 400)] + ["a" * 999, "=" * 777, "Ã" * 300, "=" * 100 + "a" * 100 + "the" * 90, "abc" * 150]
    monkeypatch.setattr(bpe, "SECTION", 90)  # and by sections that don't meet
    ids, n = b.encode_words([w.encode() for w in words])
    cut = np.concatenate([[0], np.cumsum(n)])
    for i, w in enumerate(words):  # merges alone, as the words aren't cut
        assert ids[cut[i] : cut[i + 1]].tolist() == merged(w.encode(), b.ranks), w[:20]


def merged(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 10**9), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_texts_that_polynomial_hashes_confuse(docs, spark, library, sorted_rows):
    rows = []
    for k, n in enumerate((512, 1024, 4096)):
        one, other = thue_morse(n), thue_morse(n, "ba")
        rows += [(20 * k + j, t) for j, t in enumerate((one, one, other, f"{one} {other}", f"{other} {one}", f"x\n{one}\ny", f"{other} a b c d", f"{one} a b c d"))]
    assert sorted_rows(linededup.dedup_lines(docs(rows), keep_text=False, digest=True)) == lines_model(rows)
    assert sorted_rows(ngramjoin.jaccard_join(docs(rows))) == join_model(rows)
    got = tokenfile.read_tokens(spark, *tokenfile.write_tokens(docs(rows), vocabulary(WORD_VOCABULARY), 1))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == token_model(rows)
    got = {r.doc_id: r for r in encoded(docs(rows), digest=True).collect()}
    assert all(got[i].ids == library.encode_ordinary(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)


def test_pools_tell_pieces_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(common.SpanHash, "spans", lambda self, buf, start, end: np.full(len(start), 7, np.uint64))
    e = tokenfile.WordEncoder(vocabulary(WORD_VOCABULARY))
    texts = ["one two one three", "", "three two four", "x" * 600 + " " + "x" * 599 + "y"]
    ids, cut = e(*common.text_bytes(pa.array(texts)))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == want
    pool = common.Pool(("<i4",))
    buf = np.frombuffer(b"abcabdabc", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    rows, new = pool.rows(np.full(3, 7, np.uint64), buf, start, end)
    assert new.tolist() == [0]
    pool.add(np.array([7], np.uint64), (buf[:3], np.array([3])), (np.array([1]), np.array([1])))
    rows, new = pool.rows(np.full(3, 7, np.uint64), buf, start, end)
    assert rows.tolist() == [0, -1, 0] and new.tolist() == [1]


def test_spans_are_hashed_and_compared_alike():
    r = np.random.default_rng(3)
    buf = r.integers(97, 100, 5000).astype(np.uint8)
    start = r.integers(0, 4000, 3000)
    end = start + np.concatenate([r.integers(0, 12, 2500), r.integers(200, 900, 500)])
    h = common.SpanHash(1).spans(buf, start, end)
    seen = {}
    for x, a, b in zip(h.tolist(), start.tolist(), end.tolist(), strict=True):
        assert seen.setdefault(buf[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    store = np.concatenate([buf, np.zeros(8, np.uint8)])
    other = r.permutation(len(start))
    n = np.minimum(end - start, (end - start)[other])
    want = [buf[a : a + k].tobytes() == buf[b : b + k].tobytes() for a, b, k in zip(start, start[other], n, strict=True)]
    assert common.same_bytes(buf, start, store, start[other], n).tolist() == want


def test_another_splitter_goes_through_the_library(tmp_path):
    import json

    with open(vocabulary(WORD_VOCABULARY), encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^\\s]+|\\s+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    e = tokenfile.WordEncoder(str(path))
    texts = ["don't stop", "", "a b  c"]
    ids, cut = e(*common.text_bytes(pa.array(texts)))
    assert not e.by_pieces and [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
