"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

1. Each text becomes the set of hashes of its runs of ``N`` words (A to Z as lower case; a text of fewer words
   is one run). Texts of equal sets are one class; a class takes part once, however many copies it has.
2. ``bands`` bands of ``rows`` MinHash values each are chosen so that a pair at the threshold shares a band
   with the target recall. Classes meet in the shuffle on (band, hash). Buckets with the same members as
   another are checked once.
3. Buckets are cut into blocks of about ``BLOCK`` classes; a task holds two blocks with their full sets and
   counts the common n-grams of all pairs between them by matrix products. So a bucket of any size is whole,
   no task holds more than two blocks, and pairs are never rows: a class comes out with its number of links
   and one edge of its block's spanning forest. A pair is counted in the first band that it shares only.
4. Connected components of these edges, by rounds of contraction to the least neighbour, give the groups.

Defined results: a null text is empty; texts without words are copies of each other and are near nothing else;
null ids are kept and take part, but never name a class (a class of null ids only has a null class_id);
repeated rows are copies. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..joins import spread_join, unused
from .common import fmix, mapped, materialize, release, small_batches, text_bytes, word_hashes

N = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 5
BLOCK = 256
#: Keys of the texts whose sets are needed: broadcast up to this number (8 bytes each), else a shuffle join.
BROADCAST_KEYS = 1_000_000
#: Sets of more copies than this are few; they go to the documents, whose rows are never brought together by them.
HOT = 500
#: Names of sets are broadcast up to this number (some 60 bytes each), else salted.
BROADCAST_NODES = 200_000
COLUMNS = 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(55)
_flip, _odd = (_rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (0, 1))


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` values at which a pair at the threshold meets with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def ngram_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text one after another, where each text's begin and the end)."""
    w, first = word_hashes(buf, off)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    head = np.flatnonzero(row[: max(0, len(w) - n + 1)] == row[n - 1 :]) if len(w) >= n else np.zeros(0, np.int64)
    h = w[head].copy()
    for k in range(1, n):
        h = h * FACTOR + w[head + k]
    rows, hashes = [row[head]], [fmix(h)]
    for size in range(1, n):  # texts of fewer words
        short = np.flatnonzero(counts == size)
        h = w[first[short]].copy()
        for k in range(1, size):
            h = h * FACTOR + w[first[short] + k]
        rows.append(short)
        hashes.append(fmix(h ^ np.uint64(size)))
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[new], h[new]
    return h, np.searchsorted(r, np.arange(len(off)))


def _set_names(sets: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    out = np.zeros((len(cut) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        for k in range(2):
            out[some, k] = np.add.reduceat(fmix(sets ^ _flip[4000 + k]), cut[some])
    return [x.tobytes() for x in out]


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, key (of the text's row), node (name of the set), size and a hash for each band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, cut = ngram_sets(*text_bytes(batch.column(1)), n)
        some = np.flatnonzero(np.diff(cut))
        found = np.zeros((bands, batch.num_rows), np.int64)
        for b in range(bands if len(some) else 0):
            h = np.full(len(some), b, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = h * FACTOR + np.minimum.reduceat((sets ^ _flip[k]) * _odd[k], cut[some])
            found[b, some] = fmix(h).view(np.int64)
        return pa.record_batch({"doc_id": batch.column(0), "key": batch.column(2), "node": pa.array(_set_names(sets, cut), pa.binary()), "size": np.diff(cut)} | {f"b{b}": found[b] for b in range(bands)})

    fields = "key long, node binary, size long, " + ", ".join(f"b{b} long" for b in range(bands))
    return docs.mapInArrow(mapped(run, "ngrams"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of all pairs."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # only n-grams of several sets count
    keep = times[col] > 1
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (start, start + COLUMNS))
        part = np.zeros((m, min(COLUMNS, int(col[b - 1]) - start + 1)), np.float32)
        part[row[a:b], col[a:b] - start] = 1
        out += part @ part.T
    return out


def _verify(threshold: float):
    def run(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        band, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        t = batches.select(["node", "set", "bands", "copies", "block"]).to_pydict()
        first = list({node: k for k, node in reversed(list(enumerate(t["node"])))}.values())
        nodes = [t["node"][k] for k in first]
        m = len(nodes)
        sets = [np.frombuffer(t["set"][k], np.uint64) for k in first]
        copies, block = (np.array([t[c][k] for k in first], np.int64) for c in ("copies", "block"))
        inter, size = _counts(sets), np.array([len(s) for s in sets], np.float32)
        near = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-3
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        bands = np.array([np.frombuffer(t["bands"][k], np.int64)[:band] for k in first]).reshape(m, band)
        for b in range(band if near.any() else 0):
            near &= bands[:, b][:, None] != bands[:, b][None, :]
        if m > BLOCK:
            release()
        some = np.flatnonzero(near.any(1))
        label = np.arange(m)
        while len(some):
            least = np.minimum(label, np.where(near, label[None, :], m).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        return pa.table({"node": pa.array([nodes[k] for k in some], pa.binary()), "texts": near[some].sum(1).astype(np.int64), "docs": (near[some] * copies[None, :]).sum(1).astype(np.int64), "root": pa.array([nodes[label[k]] for k in some], pa.binary())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b).

    Each round, every node moves to the least of itself and its neighbours (and on to where that one goes), and
    edges move along; a component shrinks by a factor each round, so rounds grow with the logarithm of its size.
    """
    edges = materialize(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        step = materialize(step, "step")
        on = step.select(F.col("a").alias("to"), F.col("to").alias("on"))
        # the middle of a large component is the key of many rows
        step = materialize(spread_join(step, on, ["to"], BROADCAST_NODES, by="a").select("a", F.col("on").alias("to")), "step")
        ends = [step.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"]
        edges = spread_join(edges, ends[0], ["a"], BROADCAST_NODES, by="b")
        edges = spread_join(edges, ends[1], ["b"], BROADCAST_NODES, by="a").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = materialize(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
        labels = materialize(spread_join(labels, step.withColumnRenamed("a", "root"), ["root"], BROADCAST_NODES, "left", "node").select("node", F.coalesce("to", "root").alias("root")), "labels")
    return labels


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text).

    class_id: least doc_id of all that a chain of links joins to it; copy_id: least doc_id of the same n-gram
    set; n_links: other documents at the threshold or above, copies included; n_text_links: linked classes.
    """
    return _joined(docs, threshold, n, recall, rows).drop("node", "root")


def _joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """``jaccard_join`` with node, the name of the row's n-gram set, and root, the least node of its group."""
    small_batches(docs.sparkSession)
    bands = banding(threshold, recall, rows)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # finds the row again whose set is needed; null ids are found by their text
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(1))).otherwise(F.xxhash64("text"))
    keyed = docs.withColumn("key", key)
    each = materialize(signatures(keyed, bands, rows, n), "signatures")
    own = F.when(F.col("rep").isNotNull(), F.xxhash64("rep", F.lit(1))).otherwise(F.col("key"))
    classes = each.groupBy("node", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.min("key").alias("key"), *[F.min(f"b{b}").alias(f"b{b}") for b in range(bands)])
    classes = materialize(classes.withColumn("key", own), "classes")
    # buckets of several classes; of buckets with equal members the one of the lowest band
    member = classes.filter("size > 0").select("node", F.posexplode(F.array(*[F.col(f"b{b}") for b in range(bands)])).alias("band", "hash"))
    found = member.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    alike = found.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.col("band").cast("long")).alias("band"))
    buckets = found.filter("n > 1").join(alike, ["n", "x", "y", "band"]).select("band", "hash", "n")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    at = member.join(buckets, ["band", "hash"]).withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = materialize(at.select("band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node"), "members")
    needed = materialize(classes.join(at.select("node").distinct(), "node", "left_semi"), "needed")
    keys = needed.select("key")
    keys = F.broadcast(keys) if needed.count() <= BROADCAST_KEYS else keys

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, cut = ngram_sets(*text_bytes(batch.column(0)), n)
        return pa.record_batch({"node": pa.array(_set_names(sets, cut), pa.binary()), "set": pa.array([sets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    sets = keyed.join(keys, "key", "left_semi").select("text").mapInArrow(mapped(full, "ngrams"), "node binary, set binary")
    packed = needed.select("node", "copies", F.array(*[F.col(f"b{b}") for b in range(bands)]).alias("bands"))
    packed = packed.mapInArrow(_pack, "node binary, copies long, bands binary")
    whole = at.join(sets.join(packed, "node"), "node")
    links = whole.groupBy("band", "hash", "i", "j").applyInArrow(_verify(threshold), "node binary, texts long, docs long, root binary")
    links = materialize(links, "links")
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    named = groups.join(classes.select("node", "rep"), "node")
    heads = named.groupBy("root").agg(F.min("rep").alias("head"))
    linked = groups.join(heads, "root").join(degree, "node").select("node", "root", "head", "texts", "docs")
    info = materialize(classes.select("node", "copies", "rep").join(linked, "node", "left"), "info")
    rows, hot = each.select("doc_id", "node"), info.filter(F.col("copies") > HOT)
    cold = spread_join(rows, hot.select("node"), ["node"], BROADCAST_NODES, "left_anti").join(info.filter(F.col("copies") <= HOT), "node")
    out = spread_join(rows, hot, ["node"], BROADCAST_NODES).unionByName(cold)
    return out.select(
        "doc_id", F.coalesce("head", "rep").alias("class_id"), F.col("rep").alias("copy_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        "node", F.coalesce("root", "node").alias("root"),
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(2)
        width = len(col[0]) if len(col) else 0
        flat = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)
        yield pa.record_batch({"node": batch.column(0), "copies": batch.column(1), "bands": pa.array([r.tobytes() for r in flat], pa.binary())})


def _named(docs: DataFrame, n: int, node: str) -> DataFrame:
    """``docs`` with the names of their n-gram sets as ``node``."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = _set_names(*ngram_sets(*text_bytes(batch.column(at)), n))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, node])

    return docs.mapInArrow(mapped(run, "ngrams"), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document of least doc_id stays, once.

    Rows with a null id stay unless they are near one with an id. An id may name rows of different texts: each
    row goes or stays by its own group.
    """
    groups = materialize(_joined(docs, **options).select("doc_id", "class_id", "node", "root"), "groups")
    some = F.col("doc_id").isNotNull()
    drop = materialize(groups.filter((F.col("doc_id") != F.col("class_id")) & some).select("doc_id").distinct(), "drop")
    # up to the bound, ids go to the documents; beyond, whole texts are shuffled to meet them
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    kept = docs.join(few(drop), "doc_id", "left_anti")
    again = materialize(groups.filter(some).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    node = unused("_node", docs.columns)
    near = materialize(groups.filter(~some & F.col("class_id").isNotNull()).select(F.col("node").alias(node)).distinct(), "near")
    if not again.isEmpty():  # such an id doesn't tell which row is meant; its n-gram set does
        first = groups.join(few(again), "doc_id", "left_semi").filter(F.col("doc_id") == F.col("class_id"))
        first = materialize(first.groupBy("root", "doc_id").agg(F.min("node").alias(node)).drop("root"), "first")
        twice = _named(docs.join(few(again), "doc_id", "left_semi"), options.get("n", N), node).join(few(first), ["doc_id", node], "left_semi")
        kept = kept.join(few(again), "doc_id", "left_anti").unionByName(twice.dropDuplicates(["doc_id", node]).select(docs.columns))
    if not near.isEmpty():
        alone = _named(docs.filter(~some), options.get("n", N), node).join(few(near), node, "left_anti")
        kept = kept.filter(some).unionByName(alone.select(docs.columns))
    return kept
