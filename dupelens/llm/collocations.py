"""Phrase collocations from vertical positional inverted lists.

1. Documents of one language are put together into bundles of about a million words. A bundle's words have
   positions; a break between pieces or documents skips one, so words of a phrase have consecutive positions.
2. A bundle keeps, for each of its frequent phrases, the sorted list of positions where it begins: the lengths of these
   lists, added up over the bundles, are exact frequencies. Bundles of a language go together in groups, a task a group,
   which adds up their lengths first: only (group, phrase, length) rows are shuffled by phrase, a row a group at most
   (more where a group has very many candidates), and those of frequent phrases go back to their group.
   Candidates are first counted by hash in a fixed number of counters; only those whose counter reaches the minimum are
   counted by themselves.
3. Level by level, the lists of frequent phrases of k words are merged with the postings of the words k places on;
   a phrase is a candidate only where its last k words are frequent, too. Phrases are named by (phrase, word) pairs
   of exact numbers, so nothing rests on a hash.
4. Cuts are scored from the table of frequent phrases in decimals: no part of a frequent phrase is less frequent.

Defined results: a null text is empty, a null lang is ``und``; ids play no part, so repeated rows count each; an empty
table gives an empty result; other columns are ignored; of languages of fewer phrases all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..joins import numbered_within, shuffled, spread_join
from .common import FMIX_STEP, LOWER, ROW_GROUP, Held, SpanHash, fmix, materialize, release, roomy, same_bytes, slices, small_batches, text_bytes, words

#: Bytes of texts that a task gathers before it makes a bundle of a language; a longer document is one of its own.
BUNDLE_BYTES = 6 << 20
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A task makes fewer than 2^12 bundles, and a bundle has fewer than 2^31 phrases.
OF_TASK, OF_BUNDLE = 12, 31
#: Words and places that are worked on at a time.
BLOCK = 1 << 16
#: Bytes of a batch between Spark and its workers.
BATCH_BYTES = 4 << 20
#: Candidates of a group that a task holds; of more, it sends the sums of the bundles so far, and begins anew.
HELD_ROWS = 1 << 19
#: Bundles that go together at most; fewer where there wouldn't be this many groups for each core.
GROUP, GROUPS_A_CORE = 16, 4
#: Counters of candidates, by hash, and the rows in which a task sends them.
FILTER, SEGMENTS = 1 << 22, 64
#: Frequent phrases are broadcast up to this number, else salted.
BROADCAST_PHRASES = 20_000
#: Ends of pieces, and what is no part of a word.
_BREAK, _OUTSIDE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_OUTSIDE[[*b".,;:!? \t", 10, 11, 12, 13]] = True


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((i, min(i + BLOCK, n)) for i in range(0, n, BLOCK))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, a place of each of the distinct values), numbered in rising order."""
    order = np.argsort(values)
    new = np.ones(len(values), bool)
    for i, j in _blocks(len(values) - 1):
        part = values[order[i : j + 1]]
        new[i + 1 : j + 1] = part[1:] != part[:-1]
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return number, order[new]


def _spelled(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words); words, which rise, of one hash are told apart by their bytes."""
    room = roomy(buf)

    def parts() -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
        for i, j in _blocks(len(start)):
            low, high = int(start[i]), int(end[j - 1])
            yield i, j, low, high, start[i:j].astype(np.int64) - low, end[i:j].astype(np.int64) - low

    for seed in range(301, 400):
        h = np.empty(len(start), np.uint64)
        for i, j, low, high, own, stop in parts():
            h[i:j] = SpanHash(seed).spans(buf[low:high], own, stop)
        number, first = _numbered(h)
        del h
        begin, stop_ = start[first].astype(np.int64), end[first].astype(np.int64)
        same = True
        for i, j, low, high, own, stop in parts():
            n, whose = stop - own, number[i:j]
            same = same and (n == (stop_ - begin)[whose]).all() and same_bytes(buf[low:high], own, room, begin[whose], n).all()
        if same:
            return number, [buf[i:j].tobytes() for i, j in zip(begin.tolist(), stop_.tolist(), strict=True)]
    raise ValueError("words can't be told apart")


def _bundle(texts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Positions and numbers of the words of these (bytes, offsets), with the distinct words; takes the texts from the list."""
    at, bufs, starts, ends, base, skip = [], [], [], [], 0, 0
    texts.reverse()
    while texts:
        buf, off = texts.pop()
        start, end, rows = words(buf, off, _OUTSIDE)
        breaks = np.flatnonzero(_BREAK[buf])
        own = np.searchsorted(rows, np.arange(len(start)), side="right")
        new = np.zeros(len(start), np.int64)
        new[1:] = (np.searchsorted(breaks, start[1:]) != np.searchsorted(breaks, end[:-1])) | (own[1:] != own[:-1])
        at.append((np.arange(len(start)) + np.cumsum(new) + skip).astype(np.int32))
        skip = int(at[-1][-1]) + 2 if len(start) else skip
        bufs.append(LOWER[buf])
        starts.append((start + base).astype(np.uint32))
        ends.append((end + base).astype(np.uint32))
        base += len(buf)
    at = _packed(_steps(np.concatenate(at)))
    buf, start, end = np.concatenate(bufs), np.concatenate(starts), np.concatenate(ends)
    del bufs, starts, ends
    number, spelled = _spelled(buf, start, end)
    counts = np.bincount(number, minlength=len(spelled))
    order, rank = _ranked(counts)
    return {"n": len(start), "at": at, "of": _packed(rank[number]), "names": [spelled[k] for k in order.tolist()], "counts": counts[order]}


def _ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers by falling counts, place of each number among them): small places for frequent ones."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return order, rank


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.reshape(-1), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _steps(at: np.ndarray) -> np.ndarray:
    """Rising positions as their differences."""
    return np.diff(at, prepend=at.dtype.type(0))


def _positions(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.int32)


def bundles(docs: DataFrame) -> DataFrame:
    """bundle, lang, n (words), at, of (positions and numbers of words), names (utf-8) and counts of its words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("phrases")
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            b = _bundle(held.pop(lang))
            size.pop(lang)
            made += 1
            row = {"bundle": [task << OF_TASK | made], "lang": [lang], "n": [b["n"]], "at": pa.array([b["at"]], pa.binary()), "of": pa.array([b["of"]], pa.binary()), "names": pa.array([b["names"]], pa.list_(pa.binary())), "counts": [b["counts"].tolist()]}
            return pa.record_batch(row)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            number = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for part in slices(batch.take(pa.array(np.flatnonzero(number == k))), "text"):
                    held.setdefault(lang, []).append(tuple(np.array(x) for x in text_bytes(part.column(1))))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
                if size[lang] >= BUNDLE_BYTES:
                    yield out(lang)
                    release()
            while sum(size.values()) > 3 * BUNDLE_BYTES:  # many languages at once
                yield out(max(size, key=size.get))
                release()
        for lang in list(held):
            if size[lang]:
                yield out(lang)
        release()

    made = rows.mapInArrow(run, "bundle long, lang string, n long, at binary, of binary, names array<binary>, counts array<long>")
    return materialize(made, "bundles", ROW_GROUP)


def groups(made: DataFrame) -> DataFrame:
    """bundle and group: up to ``GROUP`` bundles of a language, named by the least of them."""
    slim = made.select("bundle", "lang")
    cores = max(1, made.sparkSession.sparkContext.defaultParallelism)
    size = min(GROUP, max(1, slim.count() // (GROUPS_A_CORE * cores)))
    together = Window.partitionBy("lang", F.expr(f"place div {size}"))
    return materialize(numbered_within(slim, ["lang"], ["bundle"], "place").select("bundle", F.min("bundle").over(together).alias("group")), "groups")


#: Lists of frequent phrases (positions, number of the phrase at each, ids of the numbers), and postings of words that may follow.
BLOBS = ("at", "of", "ids", "word_at", "word_of", "word_ids")
LISTS = "group long, bundle long, " + ", ".join(f"{c} binary" for c in BLOBS)


def _lists(group: int, bundle: int, *lists: np.ndarray) -> pa.RecordBatch:
    """A row of the lists of phrases and of words: positions, numbers and ids of the numbers of each."""
    row = {}
    for name, (at, number, ids) in (("", lists[:3]), ("word_", lists[3:])):
        n = np.bincount(number, minlength=len(ids))
        order, rank = _ranked(n)
        row |= {f"{name}at": _packed(_steps(at)), f"{name}of": _packed(rank[number]), f"{name}ids": ids[order[: np.count_nonzero(n)]].tobytes()}
    return pa.record_batch({"group": [group], "bundle": [bundle]} | {c: pa.array([row[c]], pa.binary()) for c in BLOBS})


def _extended(row: dict, k: int, each: bool = False):
    """Candidates of k + 1 words: (begin of each occurrence and its number, if ``each`` is wanted, phrase and word of each number, counts)."""
    at, word_at = _positions(row["at"]), _positions(row["word_at"])
    j, met = _merged(word_at, at + np.int32(k))
    met &= _merged(at, at + np.int32(1))[1]  # its last k words are frequent, too
    at, j, word_at = at[met] if each else None, j[met], None
    ids, word_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["word_ids"], np.int64)
    most = max(1, len(word_ids))
    pair = _unpacked(row["of"])[met].astype(np.int64)
    pair *= most
    pair += _unpacked(row["word_of"])[j]
    del j, met
    if each:
        number, first = _numbered(pair)
        pair, counts = pair[first], np.bincount(number, minlength=len(first))
    else:
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        number, counts, pair = None, np.diff(first, append=len(pair)), pair[first]
    return at, number, ids[pair // most], word_ids[pair % most], counts


def _merged(at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is among the rising numbers ``at``, and whether it is."""
    out, met = np.empty(len(wanted), np.int32), np.zeros(len(wanted), bool)
    for i, k in _blocks(len(wanted)):
        out[i:k] = j = np.searchsorted(at, wanted[i:k])
        if len(at):
            met[i:k] = at[np.minimum(j, len(at) - 1)] == wanted[i:k]
    return out, met


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows, which may be of some MB, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _place(phrase: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` counters a pair of ids belongs to."""
    return (fmix(phrase.view(np.uint64) * FMIX_STEP + word.view(np.uint64)) % np.uint64(size)).astype(np.int64)


def crowded(lists: DataFrame, k: int, min_count: int, size: int) -> np.ndarray:
    """Whether each of ``size`` counters, among which all candidates of k + 1 words are dealt by hash, has counted ``min_count``.

    A phrase in another can't be frequent. A task sends its counters once, cut to ``min_count``; what comes to the driver are
    ``size`` bits, whatever the input. Where phrases are so many that all counters are full, it holds back nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("phrases")
        total = np.zeros(size, np.int32)
        for row in _rows(batches):
            _, _, phrase, word, n = _extended(row, k)
            for i, j in _blocks(len(n)):
                place = _place(phrase[i:j], word[i:j], size)
                np.add.at(total, place, np.minimum(n[i:j], min_count).astype(np.int32))
                total[place] = np.minimum(total[place], min_count)
        if total.any():
            for s, cut in enumerate(total.reshape(SEGMENTS, -1)):
                yield pa.record_batch({"segment": [s], "counts": pa.array([_packed(cut)], pa.binary())})
        release()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // SEGMENTS, np.int64)
        for batch in batches:
            for counts in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total = np.minimum(total + _unpacked(counts), min_count)
        yield pa.record_batch({"segment": [key[0].as_py()], "full": pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())})

    sums = lists.mapInArrow(count, "segment long, counts binary").groupBy("segment").applyInArrow(add, "segment long, full binary")
    out = np.zeros((SEGMENTS, size // SEGMENTS), bool)
    for segment, full in sums.collect():
        out[segment] = np.unpackbits(np.frombuffer(full, np.uint8))
    return out.reshape(-1)


def _candidates(lists: DataFrame, k: int, among: np.ndarray) -> DataFrame:
    """group, own (a number of the row), phrase, word and n of the candidates of k + 1 words in each group that may be frequent: their counters are ``among`` them."""
    bits = np.packbits(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("phrases")
        held, group, first = [], None, None

        def out() -> Iterator[pa.RecordBatch]:
            phrase, word, n = _together(held)
            held.clear()
            for i in range(0, len(n), 20_000):
                m = n[i : i + 20_000]
                own = (first << OF_BUNDLE) + np.arange(i, i + len(m))
                yield pa.record_batch({"group": np.full(len(m), group), "own": own, "phrase": phrase[i : i + len(m)], "word": word[i : i + len(m)], "n": m})

        for row in _rows(batches):
            if held and row["group"] != group:
                yield from out()
            if not held:  # a group that is sent in two parts has two rows a phrase, numbered by different bundles
                group, first = row["group"], row["bundle"]
            _, _, phrase, word, n = _extended(row, k)
            place = _place(phrase, word, 8 * len(bits))
            may = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            held.append((phrase[may], word[may], n[may]))
            if sum(len(x[2]) for x in held) > HELD_ROWS:
                held[:] = [_together(held)]
                if len(held[0][2]) > HELD_ROWS // 2:
                    yield from out()
        if held:
            yield from out()
        release()

    return lists.mapInArrow(run, "group long, own long, phrase long, word long, n long")


def _together(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed(*map(np.concatenate, zip(*held, strict=True)))


def _summed(phrase: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (phrase, word), with their sums."""
    order = np.lexsort((word, phrase))
    phrase, word, n = phrase[order], word[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return phrase[first], word[first], np.add.reduceat(n, first) if len(first) else n


def _frequent(candidates: DataFrame, keys: list[str], min_count: int, back: list[str]) -> DataFrame:
    """Candidates of at least ``min_count`` in all rows together, with this ``total`` and an ``id`` of the phrase: the least of its rows' ``own`` numbers.

    All rows have what they go ``back`` by, and one of each phrase says what it is.
    """
    w = Window.partitionBy(*keys)
    found = candidates.withColumn("total", F.sum("n").over(w)).filter(F.col("total") >= min_count).withColumn("id", F.min("own").over(w))
    first = F.col("own") == F.col("id")
    said = [F.when(first, F.col(c)).alias(c) for c in [*keys, "total"] if c not in back]
    return materialize(found.select(*back, "id", first.alias("first"), *said), "frequent")


def _ids(phrase: np.ndarray, word: np.ndarray, ids: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives the id of each pair (phrase, word), -1 of those that aren't among these."""
    phrases_, p = np.unique(phrase, return_inverse=True)
    words_, w = np.unique(word, return_inverse=True)
    pairs, first = np.unique(p * len(words_) + w, return_index=True)
    ids = ids[first]

    def of(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        (p, known), (w, spelled) = _merged(phrases_, phrase), _merged(words_, word)
        j, met = _merged(pairs, p.astype(np.int64) * len(words_) + w)
        met &= known & spelled
        out = np.full(len(phrase), -1, np.int64)
        out[met] = ids[j[met]]
        return out

    return of


def _named(number: np.ndarray, _: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each number up to the last of these, -1 of others."""
    out = np.full(int(number.max()) + 1, -1, np.int64)
    out[number] = ids
    return out


def _kept(left: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """The lists of frequent phrases of k words: of the bundles' words for k = 1, else of what ``left`` lists extends to.

    Frequent phrases of a group (words of a bundle) are sorted before its lists, which pass a row at a time.
    """
    none = lambda kind, names: [F.lit(None).cast(kind).alias(c) for c in names]
    lists = left.select("group", "bundle", *none("long", ("phrase", "word", "id")), *[F.col(c) if c in left.columns else none("binary", [c])[0] for c in BLOBS])
    said = [F.col("bundle"), F.col("idx"), F.lit(0)] if k == 1 else [F.lit(-1), F.col("phrase"), F.col("word")]
    said = [c.cast("long").alias(name) for c, name in zip(said, ("bundle", "phrase", "word"), strict=True)]
    both = frequent.select("group", *said, "id", *none("binary", BLOBS)).union(lists)
    both = both.repartition("group").sortWithinPartitions("group", "bundle", F.col("at").isNotNull())

    def words_of(row: dict, named: np.ndarray) -> tuple[np.ndarray, ...]:
        at, number = _positions(row["at"]), _unpacked(row["of"])
        may = np.zeros(int(number.max(initial=0)) + 1, bool)
        may[np.flatnonzero(named >= 0)] = True
        met = may[number]
        at, number = at[met], number[met]
        return at, number, named, at, number, named

    def phrases_of(row: dict, ids: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        at, number, phrase, word, _ = _extended(row, k - 1, each=True)
        own = ids(phrase, word)
        met = (own >= 0)[number]
        at, number = at[met], number[met]
        word_at, word_of = _positions(row["word_at"]), _unpacked(row["word_of"])
        j, met = _merged(word_at, at + np.int32(k))
        j = j[met]
        return at, number, own, word_at[j], word_of[j], np.frombuffer(row["word_ids"], np.int64)

    of, known = (words_of, _named) if k == 1 else (phrases_of, _ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("phrases")
        key, held, by = None, [], None
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("at")).is_valid().to_numpy(zero_copy_only=False)
            whose = batch.column(1 if k == 1 else 0).to_numpy()
            cuts = np.flatnonzero((whose[1:] != whose[:-1]) | listed[1:] | listed[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(whose)], strict=True):
                if whose[i] != key:
                    key, held, by = whose[i], [], None
                if not listed[i]:
                    held.append([np.array(batch.column(c).slice(i, j - i)) for c in (2, 3, 4)])
                elif held or by is not None:
                    if held:
                        by, held = known(*map(np.concatenate, zip(*held, strict=True))), []
                    row = batch.slice(i, 1).to_pylist()[0]
                    made = of(row, by)
                    if len(made[0]):
                        yield _lists(row["group"], row["bundle"], *made)
        release()

    return both.mapInArrow(run, LISTS)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase and f of the phrases of k words that are frequent in their language; lang and n, its words)."""
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    made = bundles(docs)
    together = groups(made)
    words_ = spread_join(made.select("bundle", "lang", "names", "counts"), together, ["bundle"], BROADCAST_PHRASES, by="bundle")
    words_ = words_.select("group", "bundle", "lang", F.posexplode(F.arrays_zip("names", "counts")).alias("idx", "w"))
    words_ = words_.select("group", "bundle", "lang", F.col("idx").cast("long").alias("idx"), F.col("w.names").alias("name"), F.col("w.counts").alias("n"))
    words_ = words_.withColumn("own", F.shiftleft("bundle", OF_BUNDLE) + F.col("idx"))
    frequent = _frequent(words_, ["lang", "name"], min_count, ["group", "bundle", "idx"])
    known = materialize(frequent.filter("first").select("id", "lang", F.col("name").cast("string").alias("phrase"), F.col("total").alias("f")), "words")
    one, levels = known.select("id", F.col("phrase").alias("last")), [known.withColumn("k", F.lit(1))]
    lists = spread_join(made.select("bundle", "at", "of"), together, ["bundle"], BROADCAST_PHRASES, by="bundle")
    for k in range(1, max_words):
        lists = materialize(_kept(lists, frequent, k), "lists", 4 * ROW_GROUP)  # a group stays together
        frequent = _frequent(_candidates(lists, k, crowded(lists, k, min_count, FILTER)), ["phrase", "word"], min_count, ["group", "phrase", "word"])
        if frequent.isEmpty():
            break
        new = frequent.filter("first").select("id", F.col("phrase").alias("first"), "word", F.col("total").alias("f"))
        new = spread_join(new, known.select(F.col("id").alias("first"), "lang", "phrase"), ["first"], BROADCAST_PHRASES, by="id")
        new = spread_join(new, one.withColumnRenamed("id", "word"), ["word"], BROADCAST_PHRASES, by="id")
        known = materialize(new.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f"), "phrases")
        levels.append(known.withColumn("k", F.lit(k + 1)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "k", "phrase", "f"), made.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(first: str, length: str):
    return F.expr(f"array_join(slice(ws, {first}, {length}), ' ')")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a (its frequency), l and r (of the parts at its lowest-scoring cut), n (words of the language) and score."""
    known, sizes = phrases(docs, min_count, max_words)
    known = materialize(known, "known")
    found = known.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).join(sizes, "lang")
    cuts = cuts.withColumn("left", _part("1", "cut")).withColumn("right", _part("cut + 1", "k - cut")).drop("ws")
    for side, f in (("left", "l"), ("right", "r")):
        cuts = spread_join(cuts, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side], BROADCAST_PHRASES, by="phrase")
    score = F.expr("(cast(a as decimal(18, 0)) * cast(n as decimal(19, 0)) * 1000) div (cast(l as decimal(18, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    inner = found.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longest = inner.select("lang", _part("i", "m").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = shuffled(scored, longest, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a")
    w = Window.partitionBy("lang").orderBy(F.col("m.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
