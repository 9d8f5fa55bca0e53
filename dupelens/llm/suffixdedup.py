"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document. So it is to be known, for each place, whether its longest previous factor has that length.

1. Suffixes are put together by anchors. The anchor of a place is the least of the hashed runs of ``GRAM`` bytes within
   the next ``length`` bytes (the first of equal ones), so equal strings have the same anchor at the same offset.
   Neighbouring places share anchors: a piece is a run of them with the bytes their strings cover. A document is some
   two pieces per ``length`` bytes; only hashes and places of pieces are shuffled, not bytes.
2. Equal pieces (same anchor, same 64 bits of the piece) keep their first; tasks do this for what they have read before
   anything is shuffled. Pieces whose anchor occurs in no other piece repeat nothing.
3. For the others, bytes are fetched from their documents, and all of one anchor come together. Their places are
   sorted by suffix, 8 bytes a round, among those that are still equal; the lengths that neighbours have in common
   come out of it. The previous and the next smaller place in suffix order give each place its longest previous factor.
4. An anchor of more than ``MOST`` different pieces (a very common run with much around it) is split: each of its
   places becomes a piece of its own, so that step 2 settles it, wherever its copies are.
5. Each document gathers its removed runs and is cut.

Memory: a task holds ``CHUNK`` bytes of text, ``HELD`` pieces, or ``BATCH`` bytes of pieces and those of one anchor.

Defined results: null texts are empty; null ids come before all others; rows of one id are in order of a hash of their
text, and rows equal in both are one document, each with the same result; an empty table gives an empty result; other
columns pass through, but those named like a column of the result are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..joins import unused
from .common import Held, fmix, mapped, materialize, release, runs, slices, small_batches, spread, text_bytes

LENGTH = 100
GRAM = 32
#: Bytes of text that are cut into pieces at once.
CHUNK = 1 << 20
#: Pieces of which a task keeps the first of equal ones before it sends them.
HELD = 1_000_000
#: Different pieces of one anchor that are sorted by suffix together; more are split.
MOST = 2000
#: Bytes of pieces that are sorted by suffix at once, about.
BATCH = 2 << 20
_PLACE = 24
_rng = np.random.default_rng(77)
_bytes = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse
_power, _inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK + (1 << 12), b % 2**64, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64)))


class Rolling:
    """64-bit hashes of any span of a buffer of up to ``CHUNK`` bytes and a little more, from running totals."""

    def __init__(self, buf: np.ndarray, which: int = 0) -> None:
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_bytes[which][buf] * _power[: len(buf)], out=self.total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return fmix((self.total[end] - self.total[start]) * _inverse[start] + (end - start).astype(np.uint64))


def least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each element and the n - 1 after it, where there are as many."""
    size = -(-len(x) // n) * n
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = max(0, len(x) - n + 1)
    return np.minimum(right[:m], left[n - 1 : n - 1 + m])


def pieces(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first place, number of places, hash of the anchor, hash of the piece) of the pieces of texts of at most CHUNK bytes in all."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < length:
        return none
    rolling = Rolling(buf)
    at = np.arange(len(buf) - gram + 1)
    grams = rolling.spans(at, at + gram)
    low = np.uint64((1 << _PLACE) - 1)
    anchor = (least_ahead((grams & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    row = np.searchsorted(off, np.arange(len(anchor)), side="right") - 1
    whole = np.arange(len(anchor)) + length <= off[row + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    places = np.flatnonzero(whole)
    number = np.diff(np.append(np.searchsorted(places, start), len(places)))
    return row[start], start - off[row[start]], number, grams[anchor[start]], rolling.spans(start, start + number + length - 1)


def _chunks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, places in them where they begin) of texts cut to at most CHUNK bytes, with length - 1 bytes of overlap."""
    buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
        if off[j] - off[i] <= CHUNK:
            yield buf[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:  # one long text
            for a in range(int(off[i]), int(off[j]) - length + 1, CHUNK - length + 1):
                part = buf[a : min(a + CHUNK, int(off[j]))]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([a - off[i]])
        i = j


#: Pieces as rows: hashes of anchor and piece, document, first place and number of places, and whether an equal one is earlier.
PIECES = "h long, d long, doc long, alike long, place long, n int, again boolean"
_COLUMNS = ("h", "d", "doc", "alike", "place", "n")


def _settled(found: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pieces with ``again``; those that repeat another of the same task need no grouping, and are dealt by place."""
    held: list[dict[str, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        cols = {c: np.concatenate([x[c] for x in held]) for c in _COLUMNS}
        held.clear()
        order = np.lexsort([cols[c] for c in ("place", "alike", "doc", "d", "h")])
        cols = {c: v[order] for c, v in cols.items()}
        again = np.zeros(len(order), bool)
        again[1:] = (cols["h"][1:] == cols["h"][:-1]) & (cols["d"][1:] == cols["d"][:-1])
        cols["h"] = np.where(again, fmix((cols["doc"] ^ cols["place"] << 20).view(np.uint64)).view(np.int64), cols["h"])
        cols["again"] = again
        for i in range(0, len(again), 20_000):
            yield pa.record_batch({c: v[i : i + 20_000] for c, v in cols.items()})

    size = 0
    for cols in found:
        held.append(cols)
        size += len(cols["h"])
        if size >= HELD:
            yield from out()
            size = 0
    if size:
        yield from out()
    release()


def _pieces(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            doc, alike = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "alike"))
            for buf, off, rows, begin in _chunks(batch, length):
                row, place, n, h, d = pieces(buf, off, length, gram)
                yield {"h": h.view(np.int64), "d": d.view(np.int64), "doc": doc[rows[row]], "alike": alike[rows[row]], "place": place + begin[row], "n": n.astype(np.int32)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("suffixes")
        return _settled(found(batches))

    return keyed.select("doc", "alike", "text").mapInArrow(run, PIECES)


def _marked(rows: DataFrame, partitions: int) -> DataFrame:
    """Pieces that repeat an earlier one (``gone``), and those whose anchor has several different ones (``kinds``)."""
    own, every = Window.partitionBy("h").orderBy("d", "doc", "alike", "place"), Window.partitionBy("h")
    rows = rows.repartition(partitions, "h").withColumn("gone", F.coalesce(F.lag("d").over(own) == F.col("d"), F.lit(False)))
    rows = rows.withColumn("kinds", F.count_if(~F.col("gone")).over(every)).withColumn("gone", F.col("gone") | F.col("again"))
    return materialize(rows.filter("gone OR kinds > 1").select("h", "doc", "alike", "place", "n", "gone", "kinds"), "marked")


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes that begin ``at``, bytes each has in common with the one before it, up to ``length``)."""
    lanes = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    common = np.full(len(at), length, np.int64)
    common[0:1] = 0
    live = np.arange(len(at))  # slots of the order whose suffixes still equal a neighbour's
    for step in range(0, length, 8):
        if not len(live):
            break
        of = order[live]
        lane = lanes[at[of] + step].astype(np.uint64)
        if step + 8 > length:
            lane >>= np.uint64(8 * (step + 8 - length))
        by = np.lexsort((lane, group[live]))
        order[live], lane = of[by], lane[by]
        g = group[live]
        same = np.zeros(len(live), bool)  # as the one before, and in its group
        same[1:] = g[1:] == g[:-1]
        differ = np.flatnonzero(same & np.concatenate([[False], lane[1:] != lane[:-1]]))
        x = lane[differ] ^ lane[differ - 1]
        if step + 8 > length:
            x <<= np.uint64(8 * (step + 8 - length))
        common[live[differ]] = np.minimum(length, step + _leading(x))
        cut = ~same
        cut[differ] = True
        group[live] = live[np.maximum.accumulate(np.where(cut, np.arange(len(live)), 0))]
        alone = cut & np.concatenate([cut[1:], [True]])
        live = live[~alone]
    return order, common


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the head of 8."""
    return sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Lengths of the longest previous factors, in suffix order; ``place``: where each suffix stands, ``common``: with the one before."""

    def smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Bytes in common with the nearest suffix before in the order that stands at a smaller place."""
        to, low = np.arange(-1, len(place) - 1), common.copy()
        far = np.flatnonzero((to >= 0) & (place[to] >= place))
        while len(far):
            via = to[far]
            low[far], to[far] = np.minimum(low[far], low[via]), to[via]
            far = far[(to[far] >= 0) & (place[to[far]] >= place[far])]
        return np.where(to >= 0, low, 0)

    ahead = np.concatenate([[0], common[:0:-1]]).astype(np.int64)
    return np.maximum(smaller(place, common), smaller(place[::-1], ahead)[::-1])


def _factors(cols: dict, length: int) -> dict[str, np.ndarray]:
    """Places of these pieces (h, doc, alike, place, bytes) whose longest previous factor has ``length`` bytes, as pieces."""
    size = np.array([len(b) for b in cols["bytes"]], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(cols["bytes"]) + bytes(length + 8), np.uint8)
    number = size - length + 1
    at, own = runs(begin, number), np.repeat(np.arange(len(size)), number)
    doc, alike, place = (cols[c][own] for c in ("doc", "alike", "place"))
    place = place + (at - begin[own])
    ranked = np.empty(len(at), np.int64)
    ranked[np.lexsort((place, alike, doc))] = np.arange(len(at))
    order, common = suffix_order(data, at, length)
    gone = np.sort(ranked[order[previous_factors(ranked[order], common) >= length]])
    back = np.empty(len(at), np.int64)
    back[ranked] = np.arange(len(at))
    doc, alike, place = doc[back[gone]], alike[back[gone]], place[back[gone]]
    first = np.ones(len(gone), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (alike[1:] != alike[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(first)
    return {"doc": doc[start], "alike": alike[start], "place": place[start], "n": np.diff(np.append(start, len(gone))).astype(np.int32)}


#: Places that go.
RUNS = "doc long, alike long, place long, n int"


def _fetched(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` pieces (h, doc, alike, place, n, common) with their bytes."""
    by = wanted.groupBy("doc", "alike").agg(F.collect_list(F.struct("place", "n", "h", "common")).alias("wanted"))
    rows = keyed.select("doc", "alike", "text").join(by, ["doc", "alike"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
        lists = batch.column(batch.schema.get_field_index("wanted"))
        of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        place, n, h = (flat.field(c).to_numpy() for c in ("place", "n", "h"))
        start = off[of] + place
        data = buf.tobytes()
        cut = [data[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
        doc, alike = (batch.column(batch.schema.get_field_index(c)).to_numpy()[of] for c in ("doc", "alike"))
        return pa.record_batch({"h": h, "doc": doc, "alike": alike, "place": place, "common": flat.field("common"), "bytes": pa.array(cut, pa.binary())})

    return rows.mapInArrow(mapped(run, "suffixes"), "h long, doc long, alike long, place long, common boolean, bytes binary")


def _sorted_by_suffix(fetched: DataFrame, length: int) -> DataFrame:
    """Repeated places among pieces of the same anchor."""
    rows = fetched.repartition(spread(fetched), "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("suffixes")
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.nbytes for t in held) < BATCH:
                continue
            table = pa.concat_tables(held)
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if whole:
                yield from out(table.slice(0, whole))
            held = [table.slice(whole)]
        if held:
            yield from out(pa.concat_tables(held))
        release()

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).to_numpy() for c in ("doc", "alike", "place")} | {"bytes": table.column("bytes").to_pylist()}
        found = _factors(cols, length)
        if len(found["doc"]):
            yield pa.record_batch(found)

    return rows.mapInArrow(run, RUNS)


def _split(fetched: DataFrame, length: int, partitions: int) -> DataFrame:
    """Repeated places among pieces of very common anchors: each place is a piece of its own."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "bytes", CHUNK):
                buf, off = text_bytes(part.column(part.schema.get_field_index("bytes")))
                n = np.diff(off) - length + 1
                at, own = runs(off[:-1], n), np.repeat(np.arange(len(n)), n)
                doc, alike, place = (part.column(part.schema.get_field_index(c)).to_numpy()[own] for c in ("doc", "alike", "place"))
                h, d = (Rolling(buf, which).spans(at, at + length).view(np.int64) for which in range(2))
                yield {"h": h, "d": d, "doc": doc, "alike": alike, "place": place + at - off[own], "n": np.ones(len(at), np.int32)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("suffixes")
        return _settled(found(batches))

    return _marked(fetched.mapInArrow(run, PIECES), partitions).filter("gone").select("doc", "alike", "place", "n")


def repeated(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc, alike, place and n: runs of places whose longest previous factor has ``length`` bytes; ``keyed`` has doc, alike (together once) and text."""
    partitions = spread(keyed)
    marked = _marked(_pieces(keyed, length, gram), partitions)
    out = marked.filter("gone").select("doc", "alike", "place", "n")
    several = marked.filter("NOT gone").withColumn("common", F.col("kinds") > most)
    fetched = _fetched(keyed, several, length)
    if several.filter("common").isEmpty():
        return out.unionByName(_sorted_by_suffix(fetched, length))
    fetched = materialize(fetched, "fetched")  # else the texts would be shuffled once for each of the two
    return out.unionByName(_sorted_by_suffix(fetched.filter("NOT common"), length)).unionByName(_split(fetched.filter("common"), length, partitions))


def _identified(docs: DataFrame, doc: str, alike: str) -> tuple[DataFrame, bool]:
    """``docs`` with the id, null as the least number, and what tells rows of one id apart; whether any id occurs again."""
    again = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # the hash is needed only where an id occurs again; a constant takes no room in a shuffle
    same = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 1), 1) if again else F.lit(0).cast("long")
    null = F.col("doc_id").isNull()
    return docs.withColumns({doc: F.coalesce("doc_id", F.lit(-(2**63))).cast("long"), alike: F.when(null, same).otherwise(same + 1)}), again


def dedup_passages(docs: DataFrame, length: int = LENGTH, keep_text: bool = True, digest: bool = False, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``docs`` with n_bytes, n_removed and n_spans (runs of removed bytes); texts are cut (what is left of a character goes, too), ``digest`` adds kept_sha256 of the bytes that stay."""
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*own) if keep_text else docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    doc, alike, gone = (unused(c, docs.columns) for c in ("doc", "alike", "gone"))
    named, again = _identified(docs, doc, alike)
    keyed = named.select(F.col(doc).alias("doc"), F.col(alike).alias("alike"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated(keyed.dropDuplicates(["doc", "alike"]) if again else keyed, length, gram, most)
    by = found.groupBy(F.col("doc").alias(doc), F.col("alike").alias(alike)).agg(F.collect_list(F.struct("place", "n")).alias(gone))
    cols = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        buf, off = text_bytes(column("text"))
        size, lists = np.diff(off), column(gone)
        some = np.diff(lists.offsets.to_numpy())
        flat, of = lists.flatten(), np.repeat(np.arange(len(size)), some)
        start = off[of] + flat.field("place").to_numpy()
        depth = np.zeros(len(buf) + 1, np.int32)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + flat.field("n").to_numpy() + length - 1, -1)
        out = np.cumsum(depth[:-1]) > 0
        head = out.copy()
        head[1:] &= ~out[:-1]
        inner = off[1:-1][off[1:-1] < len(buf)]
        head[inner] = out[inner]  # a run doesn't go on from a row to the next
        total, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (out, head))
        stays = ~out
        kept = [buf[a:b][stays[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        cells = {f.name: column(f.name) for f in cols}
        if keep_text:
            null = column("text").is_null().to_pylist()
            cells["text"] = pa.array([None if x else k.decode("utf-8", "ignore") for k, x in zip(kept, null, strict=True)], pa.string())
        cells |= {"n_bytes": size, "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": heads[off[1:]] - heads[off[:-1]]}
        if digest:
            cells["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.record_batch(cells)

    fields = [*cols, *(T.StructField(c, T.LongType()) for c in own[:3]), *([T.StructField(own[3], T.StringType())] if digest else [])]
    met = named.join(by, [doc, alike], "left").withColumn(gone, F.coalesce(gone, F.array().cast("array<struct<place: bigint, n: int>>")))
    return met.mapInArrow(mapped(run, "suffixes"), T.StructType(fields))
