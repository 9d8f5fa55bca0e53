"""Functions that no built-in expresses: line similarity, binary layouts of links and bin records, pictures.

All take Arrow batches. Picture decoding needs Pillow, an optional import.
"""

from __future__ import annotations

import contextlib
import difflib
import io
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT = 2 * 1024 * 1024


def line_ratio(a: bytes | None, b: bytes | None) -> float:
    """Similarity of two contents, 0 to 1.

    Both empty: 1. Either above 2 MiB, or with a zero in its first 1024 bytes: 1 if equal, else 0. Otherwise
    the matching-blocks ratio of their lines, invalid UTF-8 left out, all line ends alike. Null: 0.
    """
    if a is None or b is None:
        return 0.0
    if not a and not b:
        return 1.0
    if max(len(a), len(b)) > MAX_TEXT or b"\0" in a[:1024] or b"\0" in b[:1024]:
        return float(a == b)
    lines = [io.TextIOWrapper(io.BytesIO(x), encoding="utf-8", errors="ignore").readlines() for x in (a, b)]
    return difflib.SequenceMatcher(None, *lines).ratio()


@F.pandas_udf(T.DoubleType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([line_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: The code page of shortcut files and old bin records that say nothing else.
ANSI = "cp1252"


def link_may_mean(data: bytes | None) -> list[str]:
    """What the local target of a shortcut file may be, as ANSI and as UTF-8: none without a valid link-info block.

    The target ends with a zero byte; one without isn't valid.
    """
    try:
        if data is None or data[:4] != b"\x4c\0\0\0":
            return []
        (flags,) = struct.unpack_from("<I", data, 0x14)
        at = 0x4C
        if flags & 1:  # an id list comes first
            at += 2 + struct.unpack_from("<H", data, at)[0]
        if not flags & 2 or len(data) < at + 0x1C:
            return []
        size, _, info, _, path_at = struct.unpack_from("<5I", data, at)
        end = data.find(b"\0", at + path_at)
        if not info & 1 or not 0 < path_at < size or end < 0:
            return []
        raw, out = data[at + path_at : end], []
        for code in (ANSI, "utf-8"):
            with contextlib.suppress(UnicodeDecodeError):
                out.append(raw.decode(code))
        return list(dict.fromkeys(out))
    except struct.error:
        return []


def parse_link(data: bytes | None) -> str | None:
    """The likeliest target; ``sweep.link_targets`` looks which of those that may be meant exists."""
    return next(iter(link_may_mean(data)), None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def link_candidates(content: pd.Series) -> pd.Series:
    return content.map(link_may_mean)


@F.pandas_udf(T.StringType())
def link_target(content: pd.Series) -> pd.Series:
    return content.map(parse_link)


BIN_RECORD = T.StructType([T.StructField("original_path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("deleted_ts", T.DoubleType())])


def parse_bin_record(data: bytes | None) -> tuple[str, int, float] | None:
    """(original path, size, time of deletion) of a recycle-bin index; null if it has no path or isn't one.

    Version 2: count of characters and UTF-16LE, as much of it as there is; version 1: a field of single-byte
    characters up to a zero. What can't be decoded is replaced; white space around the path goes.
    """
    try:
        if data is None:
            return None
        version, size, ticks = struct.unpack_from("<qqq", data)
        if version == 2:
            (n,) = struct.unpack_from("<i", data, 24)
            path = data[28 : 28 + 2 * n].decode("utf-16-le", "replace").rstrip("\0") if n > 0 else ""
        elif version == 1:
            path = data[24:280].split(b"\0", 1)[0].decode(ANSI, "replace")
        else:
            return None
        path = path.strip()
        return (path, size, (ticks - 116444736000000000) / 1e7) if path else None
    except struct.error:
        return None


@F.pandas_udf(BIN_RECORD)
def bin_record(content: pd.Series) -> pd.DataFrame:
    rows = [parse_bin_record(x) or (None, None, None) for x in content]
    out = pd.DataFrame(rows, columns=["original_path", "size", "deleted_ts"])
    return out.astype({"size": "Int64", "deleted_ts": "Float64"})


def _picture(data: bytes | None):
    from PIL import Image

    return Image.open(io.BytesIO(data))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def grey_grid(content: pd.Series) -> pd.Series:
    """9 x 8 grey values of a picture, turned upright; null if it can't be decoded or Pillow is missing."""

    def one(data):
        try:
            from PIL import Image, ImageOps

            return list(ImageOps.exif_transpose(_picture(data)).convert("L").resize((9, 8), Image.Resampling.BILINEAR).getdata())
        except Exception:  # any unreadable picture
            return None

    return content.map(one)


@F.pandas_udf(T.LongType())
def pixels(content: pd.Series) -> pd.Series:
    """Width times height from a picture's header; null if unknown. PNG, GIF and BMP need no library."""

    def one(data):
        try:
            if data[:8] == b"\x89PNG\r\n\x1a\n":
                w, h = struct.unpack_from(">II", data, 16)
            elif data[:6] in (b"GIF87a", b"GIF89a"):
                w, h = struct.unpack_from("<HH", data, 6)
            elif data[:2] == b"BM":
                w, h = struct.unpack_from("<ii", data, 18)
            else:
                w, h = _picture(data).size
            return abs(w * h)
        except Exception:  # any unreadable picture
            return None

    return content.map(one).astype("Int64")
