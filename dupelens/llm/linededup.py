"""Line dedup over a sharded minimal perfect hash of frequent lines.

A line's key is the line without white space at its ends, A to Z lower-cased. Keys of at least ``min_chars``
code points in at least ``min_docs`` documents lose all their lines but those in the largest doc_id.

1. Tasks digest each document's distinct keys to 128 bits of BLAKE2b (no strings leave the task); Spark counts
   documents and keeps the largest id by key, with map-side sums, so that a line in a third of all documents
   is a few rows for the one who adds them up. No two lines are known to share such a digest.
2. The keys that repeat go into shards by their leading bits. Each shard is a file in the shared folder: a
   layered bit-array minimal perfect hash, and at its ranks arrays of fingerprints (the other 64 bits), counts
   and keepers. A key that is not in the index hits a foreign fingerprint once in 2^64, as digests are as good as random.
3. Documents probe the arrays; nothing is joined by line. The texts of a split wait, compressed, with the digests of
   their long lines, up to ``WAIT_BYTES`` (some 100 MB of text); the digests are then sorted by shard, so that each
   shard is read at most once for so much text. A worker holds shards up to ``CACHE_BYTES`` between tasks, so memory
   stays bounded however many lines repeat.

Defined results: a null or empty text is one empty line; a document whose lines all go keeps an empty text;
a null doc_id counts as one document, smaller than all; repeated rows of one doc_id count as one document and
each of them keeps its lines if that id is the largest; an empty table gives an empty result; further columns
pass through, but those named like a column of the result are dropped.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from itertools import starmap

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, Held, filesystem, fmix, mapped, materialize, release, shared_dir, slices, small_batches, text_bytes

#: Keys a shard, about; 20 MB of arrays.
SHARD_KEYS = 1_000_000
CACHE_BYTES = 128 << 20
#: Compressed texts and digests that wait to be probed.
WAIT_BYTES = 64 << 20
LAYERS, GAMMA = 24, 2.0


def line_bounds(buf: np.ndarray, off: np.ndarray):
    """(start, end of each line, first line of each row and the end)."""
    ends = np.concatenate([np.flatnonzero(buf == 10), off[1:]])
    ends.sort(kind="stable")
    ends_at = _row_ends(buf, off, ends)
    start = np.empty(len(ends), np.int64)
    start[0:1] = 0
    start[1:] = np.where(ends_at[:-1], ends[:-1], ends[:-1] + 1)
    rows = np.concatenate([[0], np.flatnonzero(ends_at) + 1])
    return start, ends, rows


def long_keys(buf: np.ndarray, start: np.ndarray, ends: np.ndarray, min_chars: int):
    """(the lines whose key is long enough, start, end of their keys)."""
    solid = np.concatenate([[0], np.cumsum(~SPACE[buf])]).astype(np.int64)
    where = np.flatnonzero(~SPACE[buf])
    some = solid[ends] > solid[start]
    a, b = start.copy(), start.copy()
    a[some] = where[solid[start[some]]]
    b[some] = where[solid[ends[some]] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)]).astype(np.int64)
    long = np.flatnonzero(chars[b] - chars[a] >= min_chars)
    return long, a[long], b[long]


def line_keys(buf: np.ndarray, off: np.ndarray, min_chars: int):
    """(start, end, first line of each row and the end, the lines whose key is long enough, halves of their keys' digests)."""
    start, ends, rows = line_bounds(buf, off)
    long, a, b = long_keys(buf, start, ends, min_chars)
    low = LOWER[buf].tobytes()
    digests = b"".join(starmap(lambda i, j: hashlib.blake2b(low[i:j], digest_size=16).digest(), zip(a.tolist(), b.tolist(), strict=True)))
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return start, ends, rows, long, halves[:, 0].copy(), halves[:, 1].copy()


def _row_ends(buf: np.ndarray, off: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the sorted line ends are ends of rows: of equal positions, all, as a newline's position lies inside its row."""
    mark = np.zeros(len(ends), bool)
    # each row's end, the k-th in order, stands after all newlines before it and the k rows before it
    newlines = np.concatenate([[0], np.cumsum(buf == 10)]).astype(np.int64)
    mark[newlines[off[1:]] + np.arange(len(off) - 1)] = True
    return mark


class PerfectHash:
    """Layers of bit arrays: a key's place is the rank of the first layer's bit that it alone set."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest  # bits: a byte each 8 slots, all layers in a row
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        count = np.unpackbits(bits, bitorder="little")[: int(self.base[-1])]
        self.set = count.astype(bool)
        self.rank = np.concatenate([[0], np.cumsum(count, dtype=np.int64)]).astype(np.int32)

    @staticmethod
    def slot(keys: np.ndarray, layer: int, size: int) -> np.ndarray:
        h = fmix(keys + np.uint64((layer * 0x9E3779B97F4A7C15 + 1) % 2**64))
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, layers, left = [], [], np.unique(keys)
        for layer in range(LAYERS):
            if not len(left):
                break
            size = max(8, int(GAMMA * len(left)))
            at = cls.slot(left, layer, size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            layers.append(once)
            left = left[~once[at]]
        bits = np.packbits(np.concatenate(layers) if layers else np.zeros(0, bool), bitorder="little")
        return cls(np.array(sizes, np.int64), bits, left)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Ranks from 0; of a key that wasn't built in, any rank or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for layer, size in enumerate(self.sizes):
            at = self.base[layer] + self.slot(keys[open_], layer, int(size))
            hit = self.set[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = self.rank[-1] + i[hit]
        return out


def _shard_file(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    order = np.lexsort((prints, keys))
    keys, prints, counts, keepers = keys[order], prints[order], counts[order], keepers[order]
    odd = np.concatenate([[False], keys[1:] == keys[:-1]])  # equal first halves: kept aside, exact
    h = PerfectHash.build(keys)
    place = h.place(keys[~odd])
    arrays = {"sizes": h.sizes, "bits": h.bits, "rest": h.rest}
    for name, a in (("prints", prints), ("counts", counts), ("keepers", keepers)):
        arrays[name] = np.zeros(int(len(place)), a.dtype)
        arrays[name][place] = a[~odd]
        arrays[f"odd_{name}"] = a[odd]
    arrays["odd_keys"] = keys[odd]
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class Shard:
    def __init__(self, data: bytes) -> None:
        z = np.load(io.BytesIO(data))
        self.hash = PerfectHash(z["sizes"], z["bits"], z["rest"])
        self.prints, self.counts, self.keepers = z["prints"], z["counts"], z["keepers"]
        self.odd = {(int(k), int(p)): i for i, (k, p) in enumerate(zip(z["odd_keys"], z["odd_prints"], strict=True))}
        self.odd_keepers = z["odd_keepers"]
        self.bytes = len(data) + len(self.hash.set) * 5

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is in the index, its keeper)."""
        at = self.hash.place(keys)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == prints[ok]
        keeper = np.where(ok, self.keepers[np.where(ok, at, 0)] if len(self.keepers) else 0, 0)
        if self.odd:
            for i in np.flatnonzero(~ok):
                j = self.odd.get((int(keys[i]), int(prints[i])))
                if j is not None:
                    ok[i], keeper[i] = True, self.odd_keepers[j]
        return ok, keeper


class Shards:
    """A folder's shards, held while all held ones stay below ``limit``; those without frequent keys have no file."""

    def __init__(self, folder: str, limit: int) -> None:
        self.fs, self.path = filesystem(folder)
        self.limit, self.held, self.absent = limit, OrderedDict(), set()

    def get(self, number: int) -> Shard | None:
        if number in self.absent:
            return None
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        path = f"{self.path}/{number}.npz"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            self.absent.add(number)
            return None
        with self.fs.open_input_file(path) as f:
            found = self.held[number] = Shard(f.read())
        while len(self.held) > 1 and sum(s.bytes for s in self.held.values()) > self.limit:
            self.held.popitem(last=False)
        return found


def build_index(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[str, int]:
    """Write the shards; (folder, bits of the shard number)."""
    spark = docs.sparkSession

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
        _, _, rows, long, h1, h2 = line_keys(buf, off, min_chars)
        row = np.searchsorted(rows, long, side="right") - 1
        order = np.lexsort((h2, h1, row))
        h1, h2, row = h1[order], h2[order], row[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        return pa.record_batch({"h1": h1[new].view(np.int64), "h2": h2[new].view(np.int64), "doc_id": ids.take(pa.array(row[new]))})

    lines = docs.select("doc_id", "text").mapInArrow(mapped(keys, "lines"), "h1 long, h2 long, doc_id long")
    lines = lines.distinct()  # repeated rows of one id
    frequent = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull())  # a null id alone keeps its lines
    frequent = materialize(frequent, "frequent")
    n = frequent.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / SHARD_KEYS)))))
    folder = shared_dir(spark) + "/lines"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        data = _shard_file(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["n"].to_numpy(), pdf["keeper"].to_numpy())
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        # a task that runs again writes the same bytes; the rename makes each copy whole
        tmp = f"{path}/.{shard}-{hashlib.md5(data).hexdigest()}-{np.random.default_rng().integers(2**62)}"
        with fs.open_output_stream(tmp) as f:
            f.write(data)
        fs.move(tmp, f"{path}/{shard}.npz")
        return pd.DataFrame({"shard": [shard], "keys": [len(pdf)]})

    by = frequent.withColumn("shard", F.shiftrightunsigned("h1", 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    by.groupBy("shard").applyInPandas(write, "shard long, keys long").agg(F.sum("keys")).first()
    return (folder, bits) if n else ("", bits)


class Waiting:
    """Slices of a split, compressed, with the digests of their long lines, that are to be probed together."""

    def __init__(self) -> None:
        self.slices: list[pa.Buffer] = []
        self.h1: list[np.ndarray] = []
        self.h2: list[np.ndarray] = []
        self.bytes = 0

    def add(self, part: pa.RecordBatch, min_chars: int) -> None:
        *_, h1, h2 = line_keys(*text_bytes(part.column(part.schema.get_field_index("text"))), min_chars)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
            out.write_batch(part)
        self.slices.append(sink.getvalue())
        self.h1.append(h1)
        self.h2.append(h2)
        self.bytes += self.slices[-1].size + h1.nbytes + h2.nbytes

    def probed(self, shards: Shards | None, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Each slice with (whether its long lines are in the index, their keepers); a shard is asked for once."""
        cuts = np.cumsum([len(h) for h in self.h1])[:-1]
        h1, h2 = np.concatenate(self.h1), np.concatenate(self.h2)
        self.h1, self.h2 = [], []
        hit, keeper = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        if shards is not None and len(h1):
            shard = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
            order = np.argsort(shard, kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                found = shards.get(int(shard[piece[0]]))
                if found is not None:
                    hit[piece], keeper[piece] = found.probe(h1[piece], h2[piece])
        for k, (h, kept) in enumerate(zip(np.split(hit, cuts), np.split(keeper, cuts), strict=True)):
            with pa.ipc.open_stream(self.slices[k]) as source:
                yield source.read_next_batch(), h, kept
            self.slices[k] = None


def probed_slices(parts: Iterable[pa.RecordBatch], shards: Shards | None, bits: int, min_chars: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``parts`` with what ``Waiting.probed`` says of them; as many wait together as ``limit`` bytes hold."""
    waiting = Waiting()
    for part in parts:
        waiting.add(part, min_chars)
        if waiting.bytes >= limit or shards is None:
            yield from waiting.probed(shards, bits)
            waiting = Waiting()
    if waiting.slices:
        yield from waiting.probed(shards, bits)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep_text: bool = True, digest: bool = False) -> DataFrame:
    """``docs`` with texts without repeated lines, n_lines and n_dropped; ``digest`` adds kept_sha256."""
    own = ["n_lines", "n_dropped", "kept_sha256"]
    docs = docs.drop(*own)
    cols = [f for f in docs.schema.fields if keep_text or f.name == "doc_id"]
    small_batches(docs.sparkSession)
    folder, bits = build_index(docs, min_chars, min_docs)
    limit, wait = CACHE_BYTES, WAIT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.begin("lines")
        shards = Held.get("lines", folder, lambda: Shards(folder, limit), only=True) if folder else None
        for part, hit, keeper in probed_slices((s for b in batches for s in slices(b, "text")), shards, bits, min_chars, wait):
            yield rebuilt(part, hit, keeper)
        release()

    def rebuilt(batch: pa.RecordBatch, hit: np.ndarray, keeper: np.ndarray) -> pa.RecordBatch:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
        start, end, rows = line_bounds(buf, off)
        at, _, _ = long_keys(buf, start, end, min_chars)
        row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        drop = np.zeros(len(start), bool)
        drop[at] = hit & (null[row[at]] | (keeper != ids[row[at]]))
        texts, data = [], buf.tobytes()
        lost = np.add.reduceat(drop, rows[:-1]) if len(row) else np.zeros(0, np.int64)
        for r in range(len(off) - 1):
            if not lost[r]:
                texts.append(data[off[r] : off[r + 1]])
            else:
                a, b = rows[r], rows[r + 1]
                texts.append(b"\n".join([data[s:e] for s, e, d in zip(start[a:b].tolist(), end[a:b].tolist(), drop[a:b].tolist(), strict=True) if not d]))
        out = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in cols}
        if keep_text:
            null = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
            out["text"] = pa.array([None if x and not t else t for x, t in zip(null, texts, strict=True)], pa.binary()).cast(pa.string())
        out["n_lines"] = np.diff(rows).astype(np.int64)
        out["n_dropped"] = lost.astype(np.int64)
        if digest:
            out["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts]
        return pa.record_batch(out)

    schema = T.StructType([*cols, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *([T.StructField("kept_sha256", T.StringType())] if digest else [])])
    need = docs if keep_text else docs.select("doc_id", "text")
    return need.mapInArrow(run, schema)

