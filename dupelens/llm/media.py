"""Media columns: payloads in archives that a Spark data source reads by byte ranges.

A text's bytes, padded with zeros to a multiple of 64, become a grey PNG of 64 samples a row. Tasks append the
images to archives in the shared folder. An archive is a row of members (header, image) and ends with a sparse
directory: where a member begins, about every ``STEP`` bytes. The directories are also one table beside the
archives, a row an archive; the data source reads this table alone to plan partitions, byte ranges that begin at a
member, so that the driver opens no archive. Readers stream members through Arrow in batches; a member
that can't be read or whose checksum is wrong is fetched again by its offset, without its neighbours.

Defined results: a null text is empty; an empty payload is 64 zeros; equal texts give equal images; rows keep
null and repeated ids; no rows give no rows; columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, mapped, release, shared_dir, slices, small_batches, text_bytes

WIDTH = 64
STEP = 1 << 20
ARCHIVE = 64 << 20
SPLIT = 16 << 20
BATCH = 8 << 20
TRIES = 4
MEMBER = struct.Struct("<4sqQQI")  # mark, doc_id, payload's bytes, image's bytes, image's crc32
FOOTER = struct.Struct("<QQ8s")  # directory entries, end of the members, mark
MARK, NO_ID, END = b"MEMB", b"MEM0", b"DLARCH01"
#: Partitions that the driver plans, at most; beyond, each gets more bytes.
PARTITIONS = 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, 64 a row; the payload's length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """The samples, a row a line; checks every chunk."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[0] != WIDTH or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this format")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean and variance in thousandths, crossings of the mean, and a histogram of 8 bins."""
    x = samples.ravel().astype(np.int64)
    n, total = len(x), int(x.sum())
    variance = (n * int((x * x).sum()) - total * total) * 1000 // (n * n)
    above = x * n >= total
    bins = np.bincount(x >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={total * 1000 // n};var={variance};cross={int((above[1:] != above[:-1]).sum())};hist={','.join(map(str, bins.tolist()))}"


class _Writer:
    def __init__(self, folder: str, archive: int = ARCHIVE, step: int = STEP) -> None:
        self.fs, self.path = filesystem(folder)
        self.archive, self.step = archive, step
        self.fs.create_dir(self.path, recursive=True)
        self.out = None

    def add(self, doc_id: int | None, n_bytes: int, png: bytes) -> dict | None:
        """A full archive's row, once it is closed."""
        if self.out is None:
            self.name, self.at, self.members, self.directory = f"{uuid.uuid4().hex}.arc", 0, 0, []
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        if not self.directory or self.at - self.directory[-1] >= self.step:
            self.directory.append(self.at)
        self.out.write(MEMBER.pack(NO_ID if doc_id is None else MARK, doc_id or 0, n_bytes, len(png), zlib.crc32(png)))
        self.out.write(png)
        self.at, self.members = self.at + MEMBER.size + len(png), self.members + 1
        return self.close() if self.at >= self.archive else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.write(np.array(self.directory, "<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.directory), self.at, END))
        self.out.close()
        self.out = None
        return {"file": [self.name], "members": [self.members], "bytes": [self.at], "directory": [self.directory]}


def write_archives(docs: DataFrame) -> str:
    """The folder of the archives and their table, ``directories``: file, members, bytes, directory. Files of lost tasks aren't in it."""
    small_batches(docs.sparkSession)
    folder, archive, step = shared_dir(docs.sparkSession) + "/media", ARCHIVE, STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Writer(folder, archive, step)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_bytes(part.column(1))
                data, cut = buf.tobytes(), off.tolist()
                for i, a, b in zip(part.column(0).cast(pa.int64()).to_pylist(), cut[:-1], cut[1:], strict=True):
                    n = b - a
                    row = w.add(i, n, to_png(data[a:b] + bytes(max(WIDTH, -(-n // WIDTH) * WIDTH) - n)))
                    if row:
                        yield pa.record_batch(row)
        if row := w.close():
            yield pa.record_batch(row)
        release()

    docs.select("doc_id", "text").mapInArrow(run, "file string, members long, bytes long, directory array<long>").write.parquet(f"{folder}/directories")
    return folder


class Range(InputPartition):
    """Byte ranges (file, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["folder"]
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        """Ranges of about ``split`` bytes, from the table of directories."""
        import pyarrow.dataset as ds

        fs, path = filesystem(self.folder)
        archives = ds.dataset(f"{path}/directories", filesystem=fs, format="parquet").to_table(columns=["file", "bytes", "directory"])
        split = max(self.split, pa.compute.sum(archives["bytes"]).as_py() // PARTITIONS if archives.num_rows else 0)
        out, held, size = [], [], 0
        for batch in archives.to_batches(max_chunksize=1000):
            for name, end, directory in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                start = 0
                for at in [*directory[1:], end]:
                    if size + at - start >= split or at == end:
                        held, size, start = [*held, (name, start, at)], size + at - start, at
                        if size >= split:
                            out.append(Range(held))
                            held, size = [], 0
        return [*out, Range(held)] if held else out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        fs, folder = filesystem(self.folder)
        rows, held = [], 0
        for name, at, end in partition.ranges:
            source = Members(lambda path=f"{folder}/{name}": fs.open_input_file(path))
            while at < end:
                doc_id, n_bytes, png, at = source.member(at)
                rows.append((doc_id, n_bytes, png))
                held += len(png)
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


class Members:
    """Reads members by offset; one that fails is opened and read anew, up to ``TRIES`` times."""

    def __init__(self, open_) -> None:
        self.open, self.file, self.retried = open_, None, 0

    def member(self, at: int) -> tuple[int | None, int, bytes, int]:
        """(doc_id, payload's bytes, image, where the next one begins)."""
        for attempt in range(TRIES):
            try:
                if self.file is None:
                    self.file = self.open()
                self.file.seek(at)
                mark, doc_id, n_bytes, size, crc = MEMBER.unpack(self.file.read(MEMBER.size))
                png = self.file.read(size)
                if mark not in (MARK, NO_ID) or len(png) != size or zlib.crc32(png) != crc:
                    raise OSError(f"a damaged member at {at}")
                return None if mark == NO_ID else doc_id, n_bytes, png, at + MEMBER.size + size
            except (OSError, struct.error):
                self.file, self.retried = None, self.retried + 1
                if attempt == TRIES - 1:
                    raise
        raise AssertionError


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, pngs = zip(*rows, strict=True)
    return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(pngs, pa.binary())})


class MediaArchives(DataSource):
    """``format("media_archives")``: options folder and split."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes and media of all members."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("folder", folder).option("split", split).load()


def measure(media: DataFrame) -> DataFrame:
    """From the stored bytes: payload and media sizes and digests, and the features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for png in batch.column(2).to_pylist():
            samples = from_png(png)
            payload = samples.tobytes()
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), features(samples)), strict=True):
                out[k].append(v)
        return pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out)

    return media.mapInArrow(mapped(run, "media", "media"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
