"""Token files: ids in Simple-8b words, by blocks with offsets, decoded without a loop over ids.

A 64-bit word holds a selector in its top 4 bits and, below, ``COUNT[s]`` values of ``BITS[s]`` bits, first value
lowest. Selector 0 is the escape: the low 60 bits are an index into the block's table of plain 64-bit values,
for values of 2^60 and above. Blocks hold ``BLOCK`` values (the last fewer).

File, little-endian: the magic, counts of documents, ids, blocks; per document its id (int64) and end (uint64,
in ids); per document whether it has an id (a byte each, filled up to 8); per block the ends (uint64) of its words
and of its escapes; all words; all escapes.

Defined results: a null text is as an empty one, of the end id alone; a null id comes first; rows of equal ids
stay apart, next to each other, in no stated order; texts of any length are encoded whole; an empty table gives no
files and no rows; columns other than doc_id and text are dropped, whatever their names.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Held, Pool, SpanHash, filesystem, materialize, release, runs, shared_dir, slices, small_batches, spread, text_bytes, words

MAGIC = b"DLTOK8B2"
BLOCK = 1024
#: Values a word and bits a value, by selector; 0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
#: Ids a file, about.
FILE_IDS = 8_000_000
#: Bytes of pieces and parts that a worker remembers; beyond, it starts anew.
REMEMBER = 160 << 20
#: The normaliser and splitter for which pieces without white space may be encoded one by one.
BY_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Tasks that read files, at most.
READ_TASKS = 20_000
#: Selectors in use, from the most values a word to the fewest.
USED = range(1, 15)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, ends of words by block, escapes, ends of escapes by block) of unsigned integers."""
    v = np.asarray(values)
    step = 256 * BLOCK
    parts = [_encode_blocks(v[i : i + step]) for i in range(0, len(v), step)]
    if not parts:
        e = np.zeros(0, np.uint64)
        return e, e, e, e
    shift = [np.cumsum([0, *(len(p[k]) for p in parts[:-1])]).astype(np.uint64) for k in (0, 2)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, shift[0], strict=True)]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] + s for p, s in zip(parts, shift[1], strict=True)])


def _encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    v = np.ascontiguousarray(values, dtype=np.uint64)
    blocks = -(-n // BLOCK)
    place = np.arange(n)
    left = np.minimum((place // BLOCK + 1) * BLOCK, n).astype(np.int32) - place.astype(np.int32)  # values to the block's end
    # the greediest selector at each place: the most values in a row that all fit, within the block
    best, top, span = np.zeros(n, np.int8), _bit_length(v), 1
    for s in sorted(USED, key=lambda s: COUNT[s]):
        while span < COUNT[s]:  # the widest of `span` values from each place
            step = min(span, int(COUNT[s]) - span)
            wider = np.full(n, 65, np.int8)
            np.maximum(top[: max(0, n - step)], top[min(step, n) :], out=wider[: max(0, n - step)])
            top, span = wider, span + step
        best[(top <= BITS[s]) & (left >= COUNT[s])] = s
    # best is now 0 only for escapes: one value of up to 60 bits always fits selector 14
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    starts, count = [], COUNT[best].astype(np.int64)
    while len(at):  # all blocks step from word to word together
        starts.append(at)
        at = at + count[at]
        live = at < np.minimum((starts[-1] // BLOCK + 1) * BLOCK, n)
        at = at[live]
    start = np.sort(np.concatenate(starts))
    sel = best[start].astype(np.int64)
    out = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if s == 0:
            continue
        w = np.flatnonzero(sel == s)
        first, word = start[w], out[w]
        for j in range(COUNT[s]):
            word |= v[first + j] << np.uint64(j * BITS[s])
        out[w] = word
    esc = np.flatnonzero(sel == 0)
    escapes = v[start[esc]]
    esc_end = np.searchsorted(start[esc], stop)
    out[esc] = (np.arange(len(esc)) - np.concatenate([[0], esc_end])[start[esc] // BLOCK]).astype(np.uint64)
    return out, np.searchsorted(start, stop).astype(np.uint64), escapes, esc_end.astype(np.uint64)


_SHORT = np.array([int(i).bit_length() for i in range(1 << 16)], np.int8)


def _bit_length(v: np.ndarray) -> np.ndarray:
    if v.max() < 1 << 16:
        return _SHORT[v.astype(np.uint16)]
    out = np.zeros(len(v), np.int8)
    x = v.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = x >= (np.uint64(1) << np.uint64(k))
        out[big] += k
        x[big] >>= np.uint64(k)
    return out + (x > 0)


def decode(words: np.ndarray, word_end: np.ndarray, escapes: np.ndarray, esc_end: np.ndarray) -> np.ndarray:
    """The values; every selector's words are unpacked at once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    place = np.cumsum(COUNT[sel])
    out = np.empty(int(place[-1]), np.uint64)
    place = place - COUNT[sel]
    for s in np.unique(sel):
        w = np.flatnonzero(sel == s)
        if s == 0:
            block = np.searchsorted(word_end, w, side="right")
            first = np.concatenate([[0], esc_end]).astype(np.int64)[block]
            out[place[w]] = escapes[first + (words[w] & np.uint64(2**60 - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s]):
            out[place[w] + j] = (words[w] >> np.uint64(j * BITS[s])) & mask
    return out


def pack(doc_ids: np.ndarray, doc_ends: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """A file; ``null``: which documents have no id."""
    known = np.zeros(-(-len(doc_ids) // 8) * 8, np.uint8)
    known[: len(doc_ids)] = 1 if null is None else ~null
    words, word_end, escapes, esc_end = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(word_end)], np.uint64)
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), doc_ends.astype("<u8").tobytes(), known.tobytes(), word_end.astype("<u8").tobytes(), esc_end.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack(data: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray, int]:
    """(doc_ids, those that are null masked; doc_ends, ids, bytes read) of the file section at the start of ``data``."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks = np.frombuffer(data, "<u8", 3, 8).astype(int)
    at = 32
    parts = []
    for kind, count in (("<i8", docs), ("<u8", docs), ("u1", -(-docs // 8) * 8), ("<u8", blocks), ("<u8", blocks)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, doc_ends, known, word_end, esc_end = parts
    words = np.frombuffer(data, "<u8", int(word_end[-1]) if blocks else 0, at)
    at += 8 * len(words)
    escapes = np.frombuffer(data, "<u8", int(esc_end[-1]) if blocks else 0, at)
    at += 8 * len(escapes)
    ids = decode(words, word_end, escapes, esc_end)
    if len(ids) != n:
        raise ValueError("a token file of wrong length")
    return np.ma.masked_array(doc_ids, known[:docs] == 0), doc_ends, ids, at


class WordEncoder:
    """Ids of the tokenizers library for a vocabulary with word ends, remembered by white-space-free pieces.

    Where the file's normaliser and splitter are ``BY_PIECES``, they act within such pieces alone (no merge
    crosses white space), so a text's ids are those of its pieces one after another, each encoded once; with any
    other the library encodes whole texts. ``limit`` bounds a worker's memory: the memo starts anew beyond it.
    """

    def __init__(self, path: str, limit: int = REMEMBER) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_pieces = all(said.get(k) == v for k, v in BY_PIECES.items()) and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.pool, self.parts, self.parts_bytes = limit, Pool(("<u4",)), {}, 0
        self.split = regex.compile(r"\p{L}+|\P{L}+")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else chr(next(other)) for b in range(256)]

    def encode_pieces(self, pieces: list[str]) -> list[array]:
        """Words of letters go to the model as the splitter would hand them to it; all else through the whole library."""
        parts, model, letters = self.parts, self.tokenizer.model, self.letters
        before = len(parts)
        out: list[array] = []
        for piece in pieces:
            plain = piece.isascii()
            if plain and piece.isalpha():
                low = piece.lower()
                found = parts.get(low)
                if found is None:
                    found = parts[low] = array("I", [t.id for t in model.tokenize(low)])
                out.append(found)
                continue
            if "'" in piece or not plain and ("\u03a3" in piece or not unicodedata.is_normalized("NFC", piece)):
                out.append(array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids))
                continue
            ids = array("I")
            for part in self.split.findall(piece.lower()):
                found = parts.get(part)
                if found is None:
                    if part.isalpha():
                        word = part if plain else "".join([letters[b] for b in part.encode()])
                        found = [t.id for t in model.tokenize(word)]
                    else:  # digits and punctuation
                        found = self.tokenizer.encode(part, add_special_tokens=False).ids
                    found = parts[part] = array("I", found)
                ids += found
            out.append(ids)
        self.parts_bytes += 250 * (len(parts) - before)  # a short text, an array and their places, about
        return out

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end)."""
        data = buf.tobytes()
        if not self.by_pieces:
            found = [self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False).ids for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.array([i for f in found for i in f], np.uint32), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        if self.pool.nbytes + self.parts_bytes > self.limit:
            self.pool, self.parts, self.parts_bytes = Pool(("<u4",)), {}, 0
            release()
        start, end, rows = words(buf, off)
        hashes = PIECES.spans(buf, start, end)
        at, new = self.pool.rows(hashes, buf, start, end)
        while len(new):
            a, b = start[new], end[new]
            found = self.encode_pieces([data[i:j].decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            self.pool.add(hashes[new], (buf[runs(a, b - a)], b - a), (np.frombuffer(b"".join(found), "<u4"), np.array([len(f) for f in found])))
            at, new = self.pool.rows(hashes, buf, start, end, again=False)
        ids, begin = self.pool.gather(1, at)
        return ids, begin[rows]


PIECES = SpanHash(202)


def word_encoder(path: str) -> WordEncoder:
    return Held.get("tokens", path, lambda: WordEncoder(path))


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int) -> tuple[str, DataFrame]:
    """Encode and write ``docs`` (doc_id, text) in ascending doc_id order; (folder, manifest).

    The manifest has a row for each file: part (range of ids), number (in it), file, n_docs, n_tokens. Texts are
    dealt by range of doc_id, sorted within a task and encoded as they stream by; a task writes a new file each
    FILE_IDS ids, so its memory is bounded. There are as many ranges as the input has splits, at least as many as
    the session asks for; an id of very many rows (null, say) is spread over several by row. A lost task
    writes its files anew under other names; only files of the manifest count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark) + "/tokens"
    docs = docs.select("doc_id", "text")
    parts = spread(docs)
    first = F.col("doc_id").asc_nulls_first()
    ordered = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, first, F.col("row")).sortWithinPartitions(first).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        docs, ids, size, k = [], [], 0, 0

        def flush():
            nonlocal docs, ids, size, k
            name = f"{task}-{k:05d}.tok"
            ends = np.cumsum(np.concatenate([n for _, n in docs])).astype(np.uint64)
            names, values = pa.chunked_array([i for i, _ in docs]), np.concatenate(ids)
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(pack(names.fill_null(0).to_numpy(), ends, values, names.is_null().to_numpy()))
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "number": pa.array([k], pa.int32()), "file": [name], "n_docs": [len(names)], "n_tokens": [len(values)]})
            docs, ids, size, k = [], [], 0, k + 1
            return row

        for batch in batches:
            for piece in slices(batch, "text"):
                buf, off = text_bytes(piece.column(1))
                found, begin = encoder(buf, off)
                ids.append(np.insert(found, begin[1:], end_id))
                docs.append((piece.column(0).cast(pa.int64()), np.diff(begin) + 1))
                size += len(ids[-1])
                if size >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()
        release()

    manifest = ordered.mapInArrow(run, "part int, number int, file string, n_docs long, n_tokens long")
    return folder, materialize(manifest, "manifest")


def read_tokens(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of token files, from the files: doc_id, start, n_tokens, ids_crc32."""
    # ids before a file: those of the ranges before (a row each), and of the files before it in its own range
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    ranges = ranges.select("part", before(Window.partitionBy(F.lit(1)).orderBy("part")).alias("upto"))
    files = manifest.select("part", "file", before(Window.partitionBy("part").orderBy("number")).alias("within"))
    n_files = manifest.count()
    plan = files.join(ranges, "part").select("file", (F.col("upto") + F.col("within")).alias("offset")).repartition(max(1, min(n_files, READ_TASKS)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    doc_ids, ends, ids, _ = unpack(f.read())
                start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(doc_ids.data, mask=np.ma.getmaskarray(doc_ids)), "start": start + offset, "n_tokens": ends.astype(np.int64) - start, "ids_crc32": pa.array(crc, pa.int64())})

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
