"""Byte-level BPE by DuckDB recursive queries inside each partition.

Encoding: a text is cut by the vocabulary's pattern into words; a word starts as a row for each byte's token
(word, position, token). A step joins neighbouring rows with the merge table, takes each word's pair of least
rank (leftmost of equals) and contracts it; words without a pair are done. The recursion ends at the fixpoint.
The merge table has, for each token, every split into two tokens, with the token's rank as result.

Words over ``LONG`` bytes go through the same recursion in overlapping windows. A row of tokens is the encoding
of its bytes exactly if every two neighbours are the encoding of theirs: the first merge across a boundary, if
there were one, would happen among the two neighbours alone as well, as merges go by rank and place. So all
neighbours of a window's encoding are proven, and two windows that share a token (the same bytes of the word)
are joined at it. Windows that share none get another one between them that begins where a token of the left
one does; it grows until they meet.

Decoding: token rows join the vocabulary and an ordered aggregation puts their bytes together.

A worker remembers words and stretches of text with their bytes (``Pool``), up to ``REMEMBER`` bytes; a text's
ids and bytes are those of its words in order.

Defined results: a null text is as an empty one and has no ids; the result has a row for each input row, null
and repeated ids included. Any white space of Unicode in a text is cut as the pattern says. Very long texts, and
texts without white space, are encoded whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE, Held, Pool, SpanHash, filesystem, mapped, release, runs, small_batches, text_bytes

#: Words above this many bytes are encoded in windows.
LONG = 64
#: Windows of long words: bytes of one, and from one to the next.
WINDOW, STRIDE = 32, 20
#: A long word's windows are made and joined so many bytes at a time.
SECTION = 1 << 18
#: Bytes of words and stretches that a worker remembers; beyond, it keeps what was asked for again, up to half of it.
REMEMBER = 72 << 20
#: Bytes of words a recursive query.
QUERY_BYTES = 200_000
PIECES, WORD = SpanHash(303), SpanHash(304)
#: Fixed value: the pattern whose words are a run of white space, at most, and then none; texts of others aren't cut before words are looked for.
CUT_AT_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond the six ASCII ones, as UTF-8; texts with any of it are cut as a whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: Rows carry the next token, its position, and k = rank * 2^32 + position of the pair they begin (null: none).
#: A row that was eaten has no token. Words without a pair join nothing, and their rows stay as they are.
LEFTMOST = """
WITH RECURSIVE t(w, pos, tok, nxt, nxt_pos, k) USING KEY (w, pos) AS (
  SELECT s.w, s.pos, s.tok, s.nxt, s.nxt_pos, m.k + s.pos FROM (
    SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS nxt_pos FROM seed
  ) s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * {size} + s.nxt
  UNION ALL
  (WITH least AS (
     SELECT w, min(k) AS k, arg_min(nxt_pos, k) AS eaten FROM t WHERE tok IS NOT NULL GROUP BY w HAVING min(k) IS NOT NULL
   ), move AS (
     SELECT l.w, l.k % 4294967296 AS at, (l.k // 4294967296)::INT AS r, l.eaten, t.nxt, t.nxt_pos FROM least l JOIN t ON t.w = l.w AND t.pos = l.eaten
   ), moved AS (
     SELECT t.w, t.pos, t.k AS was, t.pos = v.at OR t.nxt_pos = v.at AS fresh,
       CASE WHEN t.pos = v.eaten THEN NULL WHEN t.pos = v.at THEN v.r ELSE t.tok END AS tok,
       CASE WHEN t.pos = v.at THEN v.nxt WHEN t.nxt_pos = v.at THEN v.r ELSE t.nxt END AS nxt,
       CASE WHEN t.pos = v.at THEN v.nxt_pos ELSE t.nxt_pos END AS nxt_pos
     FROM t JOIN move v ON v.w = t.w WHERE t.tok IS NOT NULL
   )
   SELECT d.w, d.pos, d.tok, d.nxt, d.nxt_pos, CASE WHEN d.fresh THEN m.k + d.pos WHEN d.tok IS NOT NULL THEN d.was END
   FROM moved d LEFT JOIN merges m ON m.pair = CASE WHEN d.fresh THEN d.tok::BIGINT * {size} + d.nxt END)
)
SELECT w, pos, tok FROM t WHERE tok IS NOT NULL ORDER BY w, pos
"""

DECODE = "SELECT s.w, string_agg(v.hex, '' ORDER BY s.pos) AS hex FROM decoded s JOIN vocabulary v ON v.tok = s.tok GROUP BY s.w ORDER BY s.w"

_NIBBLE = np.zeros(256, np.uint8)
_NIBBLE[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)


class ByteBPE:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # the library's \s is the White_Space property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut_at_space = pattern == CUT_AT_SPACE
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get = self.ranks.get
        merges = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        a, b, r = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = tokens[-1][1] + 1
        if self.size >= 1 << 31:
            raise ValueError("ranks from 2^31 on don't fit the merge table")
        self.leftmost = LEFTMOST.format(size=self.size)
        self.db = duckdb.connect()
        for setting in ("threads=1", "memory_limit='256MB'", "temp_directory='duckdb-spill'"):  # below the task's own folder, only for the largest words
            self.db.execute(f"SET {setting}")
        self._table("merges", pair=a * self.size + b, k=r << 32)
        self._table("vocabulary", tok=np.array([k for _, k in tokens], np.int32), hex=[t.hex() for t, _ in tokens])
        self.token_bytes = np.zeros(self.size, np.int64)
        text = [b""] * self.size
        for spelling, t in tokens:
            self.token_bytes[t], text[t] = len(spelling), b" %d" % t
        self.decimals, self.decimal_end = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
        self.word = Pool(("<i4", "u1"))  # ids and decoded bytes of words
        self.piece = Pool(("<i4",))  # words of pieces

    def close(self) -> None:
        self.db.close()

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each), by the recursion; a query takes ``QUERY_BYTES``."""
        out, n = [], np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // QUERY_BYTES)) + 1 if len(n) else []
        for some in np.split(np.arange(len(words)), cuts):
            m = n[some]
            if not m.sum():
                continue
            self._table("seed", w=np.repeat(some, m).astype(np.int32), pos=runs(np.zeros(len(m), np.int64), m), tok=self.byte[np.frombuffer(b"".join(words[some[0] : some[-1] + 1]), np.uint8)])
            got = self.db.execute(self.leftmost).fetchnumpy()
            out.append(np.asarray(got["tok"]))
            counts += np.bincount(np.asarray(got["w"]), minlength=len(words))
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        ids, n = self._contract([w if len(w) <= LONG else b"" for w in words])
        if long:
            windows = LongWords(self)
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in long:
                parts[i] = windows.encode(words[i])
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, n

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows of ids, number of bytes of each)."""
        n = len(lengths)
        self._table("decoded", w=np.repeat(np.arange(n), lengths), pos=runs(np.zeros(n, np.int64), np.asarray(lengths)), tok=np.asarray(ids, np.int32))
        got = self.db.sql(DECODE).to_arrow_table()
        sizes = np.zeros(n, np.int64)
        text = []
        for chunk in got["hex"].cast(pa.large_string()).chunks:
            buf, _ = text_bytes(chunk)
            text.append(buf)
        hexed = _NIBBLE[np.concatenate(text)] if text else np.zeros(0, np.uint8)
        sizes[got["w"].to_numpy()] = np.asarray(pa.compute.binary_length(got["hex"])) // 2
        return hexed[0::2] << 4 | hexed[1::2], sizes

    def _learn(self, pieces: list[str], hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        cut = [self.pattern.findall(p) for p in pieces]
        flat = [w.encode() for ws in cut for w in ws]
        data = np.frombuffer(b"".join(flat), np.uint8)
        stop = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        begin = np.concatenate([[0], stop[:-1]])[: len(flat)]
        names = WORD.spans(data, begin, stop)
        rows, new = self.word.rows(names, data, begin, stop)
        while len(new):
            words = [flat[i] for i in new.tolist()]
            ids, n = self.encode_words(words)
            self.word.add(names[new], (np.frombuffer(b"".join(words), np.uint8), stop[new] - begin[new]), (ids, n), self.decode(ids, n))
            rows, new = self.word.rows(names, data, begin, stop, again=False)
        counts = np.array([len(ws) for ws in cut], np.int64)
        self.piece.add(hashes, (buf[runs(start, end - start)], end - start), (rows, counts))

    def _forget(self) -> None:
        """Keep the words asked for again, if they are few enough; stretches are soon put together anew."""
        word, piece = self.word, self.piece
        word.used[piece.gather(1, np.flatnonzero(piece.used[: len(piece)]))[0]] = True
        rows = np.flatnonzero(word.used[: len(word)])
        self.word, self.piece = word.only(rows, WORD) if len(rows) else Pool(word.kinds[1:]), Pool(piece.kinds[1:])
        if self.word.nbytes > REMEMBER // 2:
            self.word = Pool(word.kinds[1:])
        del word, piece
        release()

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of each place in the texts, first word of each text and the end)."""
        if self.word.nbytes + self.piece.nbytes > REMEMBER:
            self._forget()
        n = len(buf)
        data = buf.tobytes()
        start = np.zeros(n + 1, bool)
        if self.cut_at_space:
            space = SPACE[buf]
            start[:n] = space
            start[1:n] &= ~space[:-1]
            for m in WIDE_SPACE.finditer(data):  # rare
                row = np.searchsorted(off, m.start(), side="right") - 1
                start[off[row] : off[row + 1]] = False
        start[off[:-1][off[:-1] < n]] = True
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n) if n else begin
        hashes = PIECES.spans(buf, begin, end)
        at, new = self.piece.rows(hashes, buf, begin, end)
        while len(new):
            self._learn([data[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)], hashes[new], buf, begin[new], end[new])
            at, new = self.piece.rows(hashes, buf, begin, end, again=False)
        rows, cut = self.piece.gather(1, at)
        return rows, cut[np.searchsorted(begin, off)]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids as decimals, a space before each; where each begins and the end)."""
        start = self.decimal_end[ids]
        n = self.decimal_end[ids + 1] - start
        return self.decimals[runs(start, n)], np.concatenate([[0], np.cumsum(n)])


class Window:
    """Bytes ``start`` to ``end`` of a long word and their tokens; ``cuts`` are where these begin, and the end."""

    __slots__ = ("start", "end", "ids", "cuts", "prev", "next", "enter", "leave", "made_for", "tries", "gone")

    def __init__(self, start: int, end: int, made_for: Window | None = None) -> None:
        self.start, self.end, self.made_for = start, end, made_for
        self.prev = self.next = None
        self.enter = self.leave = self.tries = 0
        self.gone = False

    def meets(self, right: Window) -> bool:
        """Whether both have a token in common: this one is left at it, the other entered."""
        place = {c: j for j, c in enumerate(right.cuts[:-1])}
        for i in range(max(self.enter, bisect.bisect_left(self.cuts, right.start)), len(self.ids)):
            j = place.get(self.cuts[i])
            if j is not None and right.cuts[j + 1] == self.cuts[i + 1]:
                self.leave, right.enter = i, j
                return True
        return False


class LongWords:
    """Encodings of words too long for one recursion, from windows that meet in a token."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe
        self.known: dict[bytes, tuple[list[int], list[int]]] = {}

    def encode(self, word: bytes) -> np.ndarray:
        """Section by section; the next one begins where a token of the last begins, and has to begin with it."""
        out, start, size = [], 0, SECTION
        ids, cuts = self._section(word[:size])
        back = SECTION // 8
        while start + size < len(word):
            k = bisect.bisect_left(cuts, size - back) - 1
            if k > 0:
                far, far_cuts = self._section(word[start + cuts[k] : start + cuts[k] + SECTION])
                if far[0] == ids[k]:
                    out += ids[:k]
                    start, size, back = start + cuts[k], SECTION, SECTION // 8
                    ids, cuts = far, far_cuts
                else:
                    back *= 2
            else:  # the section ends too soon for its first tokens
                size *= 2
                ids, cuts = self._section(word[start : start + size])
        return np.array(out + ids, np.int32)

    def _fill(self, data: bytes, windows: list[Window]) -> None:
        """Tokens of the windows; equal ones are contracted once."""
        if len(self.known) > 50_000:
            self.known.clear()
        keys = [data[w.start : w.end] for w in windows]
        fresh = [k for k in dict.fromkeys(keys) if k not in self.known]
        if fresh:
            ids, n = self.bpe._contract(fresh)
            end = np.cumsum(n)
            for k, a, b in zip(fresh, (end - n).tolist(), end.tolist(), strict=True):
                self.known[k] = (ids[a:b].tolist(), [0, *np.cumsum(self.bpe.token_bytes[ids[a:b]]).tolist()])
        for w, k in zip(windows, keys, strict=True):
            w.ids, cuts = self.known[k]
            w.cuts = [w.start + c for c in cuts]

    def _section(self, data: bytes) -> tuple[list[int], list[int]]:
        """(ids, where the tokens begin and the end)."""
        n = len(data)
        row = [Window(s, min(n, s + WINDOW)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]
        self._fill(data, row)
        for a, b in zip(row[:-1], row[1:], strict=True):
            a.next, b.prev = b, a
        head, order = row[0], itertools.count()
        open_ = [(w.start, next(order), w) for w in row[:-1]]
        before = 2 * len(open_)
        while open_:
            # side by side while that closes gaps; else from left to right, as gaps of a repeating stretch can't be closed otherwise
            active = [open_.pop(k)[2] for k in range(len(open_) - 1, -1, -1)][::-1] if 10 * len(open_) < 7 * before else [heapq.heappop(open_)[2]]
            before = len(active) if len(active) > 1 else 0
            asked = []
            for a in active:
                b = a.next
                if a.gone or b is None or a.meets(b):
                    continue
                if b.made_for is a:
                    if b.start == a.cuts[a.enter]:  # this window's first token doesn't stand before what follows
                        b.made_for, b.prev, a.gone = None, a.prev, True
                        if a.prev is None:
                            head = b
                        else:
                            a.prev.next = b
                        heapq.heappush(open_, ((a.prev or b).start, next(order), a.prev or b))
                        continue
                    a.tries, a.next, b.gone = a.tries + 1, b.next, True
                start = a.cuts[max(a.enter, len(a.ids) - (3 << a.tries))]
                asked.append((a, Window(start, min(n, a.end + (WINDOW << a.tries)), a)))
            self._fill(data, [w for _, w in asked])
            for a, w in asked:
                if a.gone:
                    continue
                b = a.next
                while b is not None and b.end <= w.end:
                    b.gone, b = True, b.next
                a.next, w.prev, w.next = w, a, b
                if b is not None:
                    b.prev = w
                for x in (a, w):
                    heapq.heappush(open_, (x.start, next(order), x))
            if not open_:  # a window left before it is entered isn't needed
                w = head.next
                while w is not None and w.next is not None:
                    if w.leave < w.enter:
                        w.gone, w.prev.next, w.next.prev = True, w.next, w.prev
                        heapq.heappush(open_, (w.prev.start, next(order), w.prev))
                    w = w.next
        ids, cuts, w = [], [], head
        while w is not None:
            a, b = w.enter if w is not head else 0, w.leave if w.next is not None else len(w.ids)
            ids += w.ids[a:b]
            cuts += w.cuts[a:b]
            w = w.next
        return ids, [*cuts, n]


def worker(path: str, pattern: str) -> ByteBPE:
    def make() -> ByteBPE:
        fs, p = filesystem(path if "://" in path else f"file://{path}")
        with fs.open_input_stream(p) as f:
            return ByteBPE(f.read(), pattern)

    return Held.get("bpe", (path, pattern), make)


def encode(docs: DataFrame, ranks: str, pattern: str, ids: bool = True, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of each text; ``digest`` adds SHA-256 of the ids as decimals and of the decoded bytes.

    ``ranks``: a file of base64 tokens and ranks, at the same path on every executor. Columns other than
    doc_id and text are dropped.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = worker(ranks, pattern)
        buf, off = text_bytes(batch.column(1))
        words, first = bpe(buf, off)
        values, id_off = bpe.word.gather(1, words)
        out = {"doc_id": batch.column(0), "n_tokens": np.diff(id_off[first])}
        if ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(id_off[first], pa.int32()), pa.array(values, pa.int32()))
        if digest:
            text, text_off = bpe.word.gather(2, words)
            out["ids_sha256"], out["decoded_sha256"] = [], []
            for a, b, c, d in zip(*(x.tolist() for x in (id_off[first[:-1]], id_off[first[1:]], text_off[first[:-1]], text_off[first[1:]])), strict=True):
                spelled = hashlib.sha256()
                for at in range(a, b, 1 << 16):  # a stretch of a long text at a time
                    spelled.update(memoryview(bpe.spelled(values[at : min(b, at + (1 << 16))])[0])[at == a :])
                out["ids_sha256"].append(spelled.hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(memoryview(text)[c:d]).hexdigest())
        return pa.record_batch(out)

    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())])
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    if digest:
        schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    return docs.select("doc_id", "text").mapInArrow(mapped(run, "bpe"), schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the text bytes of rows with ``ids``; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            lengths = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
            flat = col.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
            data, sizes = worker(ranks, pattern).decode(flat, lengths)
            off = np.concatenate([[0], np.cumsum(sizes)])
            out = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "bytes": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("bytes", T.BinaryType())]))
