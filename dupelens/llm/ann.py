"""Nearest neighbours by a hash-prefix forest.

Vectors are dealt to shards of about ``SHARD_ROWS`` by their id, once. In a shard, each of ``TREES`` trees gives
every vector a string of ``LENGTH`` random-hyperplane bits and keeps the strings sorted. The queries are written
once, and each shard's task streams all of them past its forest: a query goes down each tree to its longest
matching prefix by binary search, then all trees go up together, a bit at a time, until the rows under the matched
prefixes are a certain share of the shard. These candidates are measured exactly, in double precision.

The share is found in each shard: the least of ``SHARES`` at which ``PROBES`` of its own rows, spread over it,
find ``RECALL`` of their exact neighbours in it. On directions that are all far apart, as random ones in 64
dimensions, prefixes say little, and a third of the rows must be measured; clustered data does with far less.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without id,
take no part; of rows of one id the shortest and then least vector counts; a query meets only vectors of its own
dimension; finite vectors of any length are measured (they are scaled by a power of two where squares would
overflow or vanish); ties go to the smaller id; a query with fewer candidates gets them all; no rows give no rows.
Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joins import spread_join
from .common import Held, filesystem, materialize, release, shared_dir

TREES, LENGTH = 128, 32
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)
RECALL, PROBES = 0.96, 48
LEAST = 1000
SHARD_ROWS = 8192
#: Queries that a task holds at once.
QUERIES = 512
K = 10
#: Ids are broadcast up to this number.
BROADCAST_IDS = 100_000
#: Squares of components within these sizes neither overflow nor vanish.
SMALL, LARGE = 1e-140, 1e140


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, a row an id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(F.col("v"), lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)
    repeated = materialize(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    some = spread_join(rows, repeated, ["vec_id"], BROADCAST_IDS, "left_semi")
    one = some.groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("n"), "v")).alias("least")).select("vec_id", F.col("least.v").alias("v"))
    return spread_join(rows, repeated, ["vec_id"], BROADCAST_IDS, "left_anti").unionByName(one)


class Forest:
    """Sorted hash strings of each tree over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 17) -> None:
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * LENGTH)).astype(np.float32)
        self.trees, self.n = trees, len(x)
        codes = self.hash(x)
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, 0)

    def hash(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.trees), np.uint64)
        for start in range(0, len(x), 2048):
            part = x[start : start + 2048]
            part = (part / np.abs(part).max(1, keepdims=True)).astype(np.float32)  # only the direction counts
            bits = (part @ self.planes > 0).reshape(-1, self.trees, LENGTH)
            for b in range(LENGTH):
                out[start : start + 2048] = (out[start : start + 2048] << np.uint64(1)) | bits[:, :, b]
        return out

    def candidates(self, queries: np.ndarray, least: int) -> np.ndarray:
        """Whether each row (second axis) is a candidate of each query."""
        code = self.hash(queries)
        found = np.zeros((len(queries), self.n), bool)
        open_ = np.arange(len(queries))
        level = self._deepest(code)
        depth = int(level.max(initial=0))
        while len(open_) and depth >= 0:
            shift = np.uint64(LENGTH - depth)
            live = open_[level[open_] >= depth]
            for t in range(self.trees if len(live) else 0):
                prefix = code[live, t] >> shift
                lo = np.searchsorted(self.codes[:, t], prefix << shift)
                hi = np.searchsorted(self.codes[:, t], (prefix + np.uint64(1)) << shift)
                order = self.order[:, t]
                for q, a, b in zip(live[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    found[q, order[a:b]] = True
            open_ = open_[found[open_].sum(1) < least]
            depth -= 1
        return found

    def _deepest(self, code: np.ndarray) -> np.ndarray:
        """The longest prefix that any tree matches, for each query: next to where it would stand."""
        best = np.zeros(len(code), np.int64)
        for t in range(self.trees if self.n else 0):
            at = np.searchsorted(self.codes[:, t], code[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
                differ = (self.codes[near, t] ^ code[:, t]).astype(np.float64)
                best = np.maximum(best, LENGTH - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0).astype(np.int64))
        return best


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, row id, distance) of the k nearest candidates of each query."""
    out = []
    top = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    low = min((np.abs(v).max(1).min(initial=np.inf) for v in (x, q)), default=1.0)
    scale = 2.0 ** -np.frexp(top)[1] if top > LARGE or low < SMALL else 1.0  # a power of two: exact
    x, q = (x, q) if scale == 1.0 else (x * scale, q * scale)
    xx = (x * x).sum(1)
    for i in range(len(q)):
        near = np.flatnonzero(found[i] & (ids != q_ids[i]))
        if not len(near):
            continue
        rough = xx[near] - 2 * (x[near] @ q[i])
        if len(near) > k:  # all that might be among the first k
            edge = np.partition(rough, k - 1)[k - 1]
            near = near[rough <= edge + 1e-9 * (1 + abs(edge) + float(q[i] @ q[i]))]
        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1)) / scale
        for j in np.lexsort((ids[near], exact))[:k]:
            out.append((int(q_ids[i]), int(ids[near[j]]), float(exact[j])))
    return out


class Shard:
    """Rows of one dimension, their forest, and how many of them a query has to meet."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, recall: float, least: int) -> None:
        self.ids, self.x, self.forest = ids, x, Forest(x)
        self.enough = self._enough(k, recall, min(len(ids), max(least, k)))

    def _enough(self, k: int, recall: float, least: int) -> int:
        n = len(self.ids)
        if least >= n:
            return n
        at = np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64)
        row = {i: j for j, i in enumerate(self.ids.tolist())}
        want = [(row[i], row[j]) for i, j, _ in nearest(self.x, self.ids, self.x[at], self.ids[at], np.ones((len(at), n), bool), k)]
        probe = {p: i for i, p in enumerate(at.tolist())}
        i, j = np.array([probe[a] for a, _ in want]), np.array([b for _, b in want])
        low, high = 0, len(SHARES)  # a neighbour among the candidates is found: halve the shares that might do
        while low < high:
            middle = (low + high) // 2
            found = self.forest.candidates(self.x[at], max(least, int(SHARES[middle] * n)))[i, j].mean()
            low, high = (low, middle) if found >= recall else (middle + 1, high)
        return max(least, int(SHARES[low] * n)) if low < len(SHARES) else n

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        return nearest(self.x, self.ids, q, q_ids, self.forest.candidates(q, self.enough), k)


def _by_dimension(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of rows (vec_id, v)."""
    size = np.asarray(pa.compute.list_value_length(batch["v"]))
    for d in np.unique(size):
        some = batch.take(pa.array(np.flatnonzero(size == d)))
        v = some["v"].combine_chunks() if isinstance(some["v"], pa.ChunkedArray) else some["v"]
        yield int(d), some["vec_id"].cast(pa.int64()).to_numpy(), v.flatten().to_numpy().reshape(len(some), int(d))


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found to each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    queries = f"{shared_dir(spark)}/queries"
    rows.filter(is_query).write.parquet(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        Held.begin("vectors")
        have = list(batches)
        if not have:
            return
        shard = {d: Shard(ids, x, k, recall, least) for d, ids, x in _by_dimension(pa.Table.from_batches(have))}
        del have
        fs, path = filesystem(queries)
        for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=QUERIES):
            for d, ids, q in _by_dimension(batch) if batch.num_rows else ():
                got = shard[d].search(q, ids, k) if d in shard else []
                if got:
                    a, b, c = zip(*got, strict=True)
                    yield pa.record_batch({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})
        del shard
        release()

    of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    found = rows.repartitionById(shards, of).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
