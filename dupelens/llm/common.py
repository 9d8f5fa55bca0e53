"""Shared pieces: the folder that all executors see, cut lineage, and hashing of words and lines in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
FMIX_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of a row group of tables between stages.
ROW_GROUP = 32 << 20
def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, with its scheme; see ``session.shared_folder``."""
    return shared_folder(spark)


def materialize(df: DataFrame, name: str = "table", large: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``large``: rows are of some MB, and row groups of so many bytes; the writer measures each row then, not each hundredth.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.option("parquet.block.size", large or ROW_GROUP)  # a task holds one row group
    if large:
        writer = writer.option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: one for each split of what ``df`` reads, at least those the session asks for."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows made by the driver have no size
    splits = -(-known // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(1, splits, int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works for every store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes a slice (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    off = _offsets(col)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string column; a null is empty."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    off = _offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mapped(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], owner: str, column: str = "text", limit: int = 1 << 20):
    """A function for mapInArrow that calls ``fn`` on slices of bounded text size; ``owner`` names the operator (see ``Held``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin(owner)
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        release()

    return run


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Let batches of texts hold few rows and bytes: one read and one sent lie whole in the JVM, and one in the worker."""
    conf = spark._jsparkSession.sessionState().conf()
    for name, now, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", conf.arrowMaxRecordsPerBatch(), rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", conf.arrowMaxBytesPerBatch(), size),
        ("spark.sql.parquet.columnarReaderBatchSize", conf.parquetVectorizedReaderBatchSize(), rows // 2),
    ):
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3: a bijection that spreads every bit."""
    h = h ^ (h >> S33)
    h = h * MIX1
    h = h ^ (h >> S33)
    h = h * MIX2
    return h ^ (h >> S33)


#: White space of the contracts: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Spans over this many bytes are hashed by BLAKE2b, one at a time.
LANE_BYTES = 256
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=object).astype(np.uint64)


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``buf`` on as a number; the last 8 bytes are no more than room."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def roomy(buf: np.ndarray) -> np.ndarray:
    """``buf`` and 8 zeros."""
    out = np.zeros(len(buf) + 8, np.uint8)
    out[: len(buf)] = buf
    return out


class SpanHash:
    """64-bit hashes of many byte spans of one buffer at once; ``seed`` picks independent functions.

    The hash starts from the span's length and takes in 8 bytes a step by exclusive or and ``fmix``, a bijection:
    spans of one length that differ within one step never meet, others do by chance, about once in 2^64. Long
    spans are hashed by keyed BLAKE2b. Where a meeting would matter, bytes are compared (``Pool``) or longer
    digests are used.
    """

    def __init__(self, seed: int) -> None:
        self.seed = np.uint64(int(np.random.default_rng(seed).integers(1, 2**63)))
        self.key = int(self.seed).to_bytes(8, "little")

    def spans(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = (end - start).astype(np.int64)
        h = fmix(n.astype(np.uint64) * FMIX_STEP + self.seed)
        lanes = _lanes(roomy(buf))
        live = np.flatnonzero((n > 0) & (n <= LANE_BYTES))
        at, left = start[live], n[live]
        while len(live):
            h[live] = fmix(h[live] ^ (lanes[at] & _LANE[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(n > LANE_BYTES):
            h[i] = int.from_bytes(hashlib.blake2b(memoryview(buf)[start[i] : end[i]], digest_size=8, key=self.key).digest(), "little")
        return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether ``n`` bytes of ``a`` from each of ``a_start`` are those of ``b``, 8 bytes longer than its last span, from ``b_start``."""
    out = np.ones(len(n), bool)
    x, y = _lanes(roomy(a)), _lanes(b)
    live = np.flatnonzero((n > 0) & (n <= LANE_BYTES))
    done = 0
    while len(live):
        out[live] = (x[a_start[live] + done] ^ y[b_start[live] + done]) & _LANE[np.minimum(n[live] - done, 8)] == 0
        done += 8
        live = live[out[live] & (n[live] > done)]
    for i in np.flatnonzero(n > LANE_BYTES):
        out[i] = np.array_equal(a[a_start[i] : a_start[i] + n[i]], b[b_start[i] : b_start[i] + n[i]])
    return out


WORDS = SpanHash(101)


def words(buf: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the end) of the words of each row: runs of bytes not in ``outside``."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~outside[buf]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]]  # a word may not run on from a row to the next
    first[cut] = True
    last[cut] = True
    start, end = np.flatnonzero(first[:n]), np.flatnonzero(last[: n + 1])
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end); A to Z count as lower case."""
    start, end, rows = words(buf, off, outside)
    return WORDS.spans(LOWER[buf], start, end), rows


class Pool:
    """Values of pieces of text, remembered by the piece: variable-length rows in flat arrays.

    The index is an open-addressing table of hashes in numpy, probed for all pieces of a batch at once. A row
    counts only if its piece has the same bytes; pieces of equal hash beside the first are kept in ``odd``.
    """

    def __init__(self, kinds: tuple[str, ...]) -> None:
        self.kinds, self.n = ("u1", *kinds), 0  # the first kind is the piece itself
        self.keys, self.at = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)
        self.flat = [np.zeros(1 << 12, k) for k in self.kinds]
        self.end = [np.zeros(1 << 10, np.int64) for _ in self.kinds]  # end[k][i + 1]: where row i ends
        self.used = np.zeros(1 << 10, bool)  # rows asked for again
        self.odd: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.n

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.at, self.used, *self.flat, *self.end))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        place, open_, h = (hashes & mask).astype(np.int64), np.arange(len(hashes)), hashes
        while len(open_):
            k = self.keys[place]
            hit = k == h
            out[open_[hit]] = self.at[place[hit]]
            go = ~hit & (k != 0)
            open_, h, place = open_[go], h[go], (place[go] + 1) & int(mask)
        return out

    def _insert(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[free]  # of those that want one place, one wins
            won = self.keys[place] == hashes
            self.at[place[won]] = rows[won]
            hashes, rows, place = hashes[~won], rows[~won], (place[~won] + 1) & mask

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, len(a) + len(a) // 2) - len(a), a.dtype)])

    def add(self, hashes: np.ndarray, pieces: tuple[np.ndarray, np.ndarray], *values: tuple[np.ndarray, np.ndarray]) -> None:
        """Rows of new pieces of distinct ``hashes``: flat bytes and lengths of the pieces and, for each kind, of the values."""
        n, m = self.n, len(hashes)
        hashes = np.maximum(hashes, np.uint64(1))
        for k, (flat, lengths) in enumerate((pieces, *values)):
            self.end[k] = self._room(self.end[k], n + m + 1)
            used = int(self.end[k][n])
            self.end[k][n + 1 : n + m + 1] = used + np.cumsum(lengths)
            self.flat[k] = self._room(self.flat[k], used + len(flat) + 8)
            self.flat[k][used : used + len(flat)] = flat
        self.used = self._room(self.used, n + m)
        self.n += m
        rows = np.arange(n, n + m, dtype=np.int32)
        odd = self._find(hashes) >= 0
        for i in rows[odd].tolist():
            self.odd[self.piece(i)] = i
        if 2 * self.n > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, at = self.keys[old], self.at[old]
            size = 1 << int(3 * self.n).bit_length()
            self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(keys, at)
        self._insert(hashes[~odd], rows[~odd])

    def piece(self, row: int) -> bytes:
        return self.flat[0][self.end[0][row] : self.end[0][row + 1]].tobytes()

    def rows(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, again: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(row of each span of ``buf`` or -1, places of the first of each missing hash).

        After adding what was missing, ask once more (not ``again``) until nothing is: two new pieces may share a hash.
        """
        found = self._find(np.maximum(hashes, np.uint64(1)))
        some = np.flatnonzero(found >= 0)
        row, n = found[some], (end - start)[some]
        own = self.end[0][row]
        fits = self.end[0][row + 1] - own == n
        fits[fits] = same_bytes(buf, start[some[fits]], self.flat[0], own[fits], n[fits])
        for i in some[~fits].tolist():
            found[i] = self.odd.get(buf[start[i] : end[i]].tobytes(), -1)
        if again:
            self.used[found[found >= 0]] = True
        lost = np.flatnonzero(found < 0)
        return found, lost[np.unique(hashes[lost], return_index=True)[1]] if len(lost) else lost

    def gather(self, kind: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows one after another, where each row's values begin and the end); kind 0 is the piece."""
        start, stop = self.end[kind][rows], self.end[kind][rows + 1]
        return self.flat[kind][runs(start, stop - start)], np.concatenate([[0], np.cumsum(stop - start)])

    def only(self, rows: np.ndarray, hash_: SpanHash) -> Pool:
        """A pool of these rows."""
        out = Pool(self.kinds[1:])
        flat, off = self.gather(0, rows)
        hashes = hash_.spans(flat, off[:-1], off[1:])
        first = np.unique(hashes, return_index=True)[1]  # of pieces of equal hash, one
        kept = [self.gather(k, rows[first]) for k in range(len(self.kinds))]
        out.add(hashes[first], *[(values, np.diff(cut)) for values, cut in kept])
        return out


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from each of ``start`` on, ``n`` of each, one run after another."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - n), n)


class Held:
    """What a worker keeps between tasks for one operator: made when first asked for, given up when another operator's task begins."""

    owner: str = ""
    kept: dict[tuple, object] = {}

    @classmethod
    def get(cls, owner: str, key: object, make: Callable[[], object], only: bool = False) -> object:
        """``only``: other things of this owner are given up."""
        cls.begin(owner)
        if (owner, key) not in cls.kept:
            if only:
                cls.kept = {}
            cls.kept[owner, key] = make()
        return cls.kept[owner, key]

    @classmethod
    def begin(cls, owner: str) -> None:
        if cls.owner != owner:
            dropped, cls.kept, cls.owner = cls.kept, {}, owner
            for x in dropped.values():
                if close := getattr(x, "close", None):
                    close()
            if dropped:
                del dropped
                gc.collect()
                release()
