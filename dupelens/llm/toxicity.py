"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, pairs of neighbours and pairs with one word left
out; words are runs of letters and digits, A to Z lower-cased. The model (McMahan et al., 2013) keeps a rate
for each coordinate, and its L1 term leaves few weights that aren't 0: these alone are sent to the executors,
at most ``DIMENSIONS`` of them (4 million; some thousands in practice).

Training runs in one task over at most ``SAMPLE`` labelled documents, those of least hashed id; this bound is
the operator's documented parameter. Scoring reads every whole text.

Defined results: a null or empty text has no features and gets the base rate; labels with a null id, a null
value or no document don't count; of several labels of a document the largest counts; with no labels at all
every score is 0.5 times ``PRIOR`` (that is, below the threshold). Rows keep null and repeated ids. Further
columns pass through, save those named score or predicted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, fmix, mapped, release, small_batches, text_bytes, word_hashes

DIMENSIONS = 1 << 22
SAMPLE = 24_000
THRESHOLD = 0.3
PRIOR = 0.2
PASSES = 6
#: FTRL-proximal parameters, chosen on a split of the rows that may be learnt from (a third of them held back).
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
#: Every byte that isn't a letter, a digit or part of a longer character.
OUTSIDE = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every occurrence."""
    w, first = word_hashes(buf, off, OUTSIDE)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, found = [row], [w]
    for gap, factor in ((1, PAIR), (2, SKIP)):
        near = row[:-gap] == row[gap:]
        rows.append(row[:-gap][near])
        found.append(fmix(w[:-gap][near] * factor + w[gap:][near]))
    return np.concatenate(rows), (np.concatenate(found) % np.uint64(DIMENSIONS)).astype(np.int64)


class FTRL:
    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)  # the last is the bias, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == DIMENSIONS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, DIMENSIONS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) other than 0; ``labels``: (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = text_bytes(batch.column(1))
        row, found = features(buf, off)
        cut = np.searchsorted(np.sort(row, kind="stable"), np.arange(len(off)))
        found = found[np.argsort(row, kind="stable")]
        return pa.record_batch({"doc_id": batch.column(0), "toxic": batch.column(2), "features": pa.array([np.unique(found[a:b]).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = {}
        for batch in batches:
            for i, label, f in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                examples[(i, f)] = label  # repeated rows count once
        model, order = FTRL(), [(np.frombuffer(f, "<i4"), label) for (_, f), label in sorted(examples.items())]
        rng = np.random.default_rng(7)
        for _ in range(PASSES):
            for k in rng.permutation(len(order)):
                model.learn(*order[k])
        if order:
            at = np.append(np.flatnonzero(model.z[:-1]), DIMENSIONS)
            w = model.weights(at)
            keep = w != 0
            yield pa.record_batch({"at": at[keep], "w": w[keep]})
        del examples, model, order
        release()

    fields = T.StructType([docs.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("features", T.BinaryType())])
    # features of at most `sample` documents cross to the one task that learns; scan, join and hashing stay spread
    found = rows.mapInArrow(mapped(featured, "toxicity"), fields).repartition(1).mapInArrow(fit, "at long, w double")
    got = found.toArrow()
    return got["at"].to_numpy(), got["w"].to_numpy()


def score(docs: DataFrame, at: np.ndarray, w: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop("score", "predicted")
    bias = float(w[at == DIMENSIONS].sum()) if len(at) else float(np.log(0.5 * PRIOR / (1 - 0.5 * PRIOR)))
    sent = docs.sparkSession.sparkContext.broadcast((at[at < DIMENSIONS], w[at < DIMENSIONS]))
    name = uuid.uuid4().hex

    def table() -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        out[sent.value[0]] = sent.value[1]
        return out

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight = Held.get("toxicity", name, table, only=True)
        buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
        row, found = features(buf, off)
        some = np.flatnonzero(weight[found])
        pairs = np.unique(row[some] * DIMENSIONS + found[some])
        total = np.bincount(pairs // DIMENSIONS, weight[pairs % DIMENSIONS], minlength=len(off) - 1) + bias
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n in keep}
        return pa.record_batch(out | {"score": p, "predicted": (p >= threshold).astype(np.int32)})

    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(mapped(run, "toxicity"), schema)


def held_out(doc_id: Column) -> Column:
    """Rows no label of which may be learnt: crc32 of the id as text, modulo 4, is 2; null ids are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
