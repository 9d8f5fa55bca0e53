"""Scalar functions as Column expressions; all run inside the JVM, none is a Python UDF."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension; the first set that has an extension names it ("ts" is a video).
CATEGORIES = {
    "images": "jpg jpeg png gif webp bmp svg ico tiff heic raw",
    "videos": "mp4 mkv avi mov wmv flv webm m4v 3gp ts",
    "audio": "mp3 wav flac aac ogg m4a wma opus alac",
    "documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt csv epub",
    "archives": "zip rar 7z tar gz bz2 xz iso dmg cab",
    "code": "py js ts jsx tsx html css json xml yaml yml cpp c h hpp cs java go rs php rb sql sh bat ps1",
}


def ext(name: Column) -> Column:
    """Lower-cased last suffix with its dot; leading dots are no suffix (``.tmp`` has none, ``a.`` has ``.``)."""
    return F.regexp_extract(F.lower(name), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def category(name: Column) -> Column:
    """images, videos, audio, documents, archives, code or other, by extension."""
    e = F.substring(ext(name), 2, 64)
    return reduce(lambda rest, kind: F.when(e.isin(CATEGORIES[kind].split()), F.lit(kind)).otherwise(rest), reversed(CATEGORIES), F.lit("other"))


def human_size(size: Column) -> Column:
    """``512 B``, ``1.50 KB``, ``1.00 MB``, ``1.00 GB``: steps of 1024, two decimals, ties to even."""

    def two(power: int) -> Column:
        # exact: a decimal with all binary fractions of a KB; larger units divide twice without losing a tie
        scaled = size.cast("decimal(20,0)") / F.lit(1024**power).cast("decimal(10,0)")
        return F.format_string("%s", F.bround(scaled, 2).cast("decimal(20,2)").cast("string"))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(two(1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(two(2), F.lit(" MB")))
        .otherwise(F.concat(two(3), F.lit(" GB")))
    )


def short_path(path: Column, limit: int = 55, sep: str = "/") -> Column:
    """A path over ``limit`` characters as first part, dots and last part."""
    drive = F.regexp_extract(path, r"^([A-Za-z]:)", 1)
    rest = F.substr(path, F.length(drive) + 1)
    p = F.split(F.regexp_replace(rest, r"^[\\/]+|[\\/]+$", ""), r"[\\/]")
    half = limit // 2
    few = F.concat(F.substring(path, 1, half), F.lit("..."), F.right(path, F.lit(half)))
    many = F.concat(drive, F.lit(sep), F.element_at(p, 1), F.lit(f"{sep}...{sep}"), F.element_at(p, -1))
    return F.when(F.length(path) <= limit, path).when(F.size(p) <= 2, few).otherwise(many)


def full_hash(content: Column) -> Column:
    """SHA-256 in hex; null for null content."""
    return F.sha2(content, 256)


def turbo_hash(content: Column, size: Column, partial: int = 65536) -> Column:
    """MD5 over the first ``partial`` bytes, the last ``partial`` if the size is over twice that, and the size.

    Between one and two times ``partial`` only the head counts, so equal hashes need a full check.
    """
    tail = F.when(size > 2 * partial, F.substr(content, (size - (partial - 1)).cast("int"), F.lit(partial))).otherwise(F.lit(b""))
    return F.md5(F.concat(F.substring(content, 1, partial), tail, F.encode(size.cast("string"), "UTF-8")))


def parse_code(code: Column) -> Column:
    """A hexadecimal code of up to 16 digits as a signed 64-bit number; null if it isn't one."""
    return F.when(code.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(code, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers; 64 if either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64)).cast("long")


def hamming_hex(a: Column, b: Column) -> Column:
    return hamming(parse_code(a), parse_code(b))


def similarity_pct(distance: Column) -> Column:
    """100 for equal 64-bit codes, 0 at 64 bits."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(64.0)) * F.lit(100.0)


def max_distance(threshold: float) -> int:
    """Bits that codes may differ in; a plain float product, cut, as the thresholds are stated."""
    return int(64 * (1.0 - threshold))


def dhash_bits(grid: Column, hash_size: int = 8) -> Column:
    """Difference hash of ``hash_size`` rows of ``hash_size + 1`` grey values: a bit where a value exceeds the next."""
    w = hash_size + 1
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(hash_size * hash_size - 1)),
        lambda i: F.when(
            F.get(grid, (F.floor(i / hash_size) * w + i % hash_size).cast("int")) > F.get(grid, (F.floor(i / hash_size) * w + i % hash_size + 1).cast("int")), F.lit(1)
        ).otherwise(F.lit(0)).cast("long"),
    )
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return F.when(F.size(grid) == hash_size * w, code)


def code_hex(code: Column) -> Column:
    """16 hexadecimal digits of a 64-bit code."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def same_volume(a: Column, b: Column) -> Column:
    """Whether both paths begin with the same drive letter; false without one."""
    d = lambda p: F.regexp_extract(F.lower(p), r"^([a-z]:)", 1)
    return (d(a) == d(b)) & (d(a) != "")


def filetime_epoch(ticks: Column) -> Column:
    """Seconds since 1970 of ticks of 100 ns since 1601."""
    return (ticks - F.lit(116444736000000000)) / F.lit(10_000_000.0)


def _climbed(path: Column) -> Column:
    """A path with ``..`` parts taken out together with the part before them; none goes above a root or a drive."""
    root = F.regexp_extract(path, r"^([A-Za-z]:/|[A-Za-z]:|/|)", 1)
    parts = F.filter(F.split(F.substr(path, F.length(root) + 1), "/"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        stuck = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1)) == "..")
        up = F.when(~stuck, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(root == "", F.concat(done, F.array(x))).otherwise(done)
        return F.when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    return F.concat(root, F.array_join(F.aggregate(parts, none, step), "/"))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with ``value`` once in the expression, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def path_key(path: Column) -> Column:
    """A path for comparison: one kind of separator, none doubled or last, no ``.`` and ``..`` parts, lower case."""
    p = F.regexp_replace(path, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(?<=/)(?:\./)+|^(?:\./)+|/\.$", "")
    p = once(p, lambda x: F.when(x.rlike(r"(^|/)\.\.(/|$)"), _climbed(x)).otherwise(x))
    return F.lower(once(p, lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, r"/$", "")).otherwise(x)))


def parent(path: Column) -> Column:
    """All before the last separator."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def components(path: Column) -> Column:
    """The parts of a path, lower-cased."""
    return F.filter(F.split(F.lower(path), r"[\\/]"), lambda x: x != "")


def time_text(epoch: Column, seconds: bool = True) -> Column:
    """``2024-01-31 12:34:56`` in the session's time zone."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss" if seconds else "yyyy-MM-dd HH:mm")


def is_binary(content: Column) -> Column:
    """A zero in the first 1024 bytes; what can't be read counts as binary."""
    return F.coalesce(F.contains(F.substring(content, 1, 1024), F.lit(b"\x00")), F.lit(True))


def which(a: Column, b: Column) -> Column:
    """``a``, ``b`` or ``same``: the greater of two values."""
    return F.when(a > b, F.lit("a")).when(b > a, F.lit("b")).otherwise(F.lit("same"))


def ancestors(path: Column) -> Column:
    """The path itself and all folders above it as ``path_key`` gives them, the root first; null for a null path."""
    upto = once(F.split(path_key(path), "/"), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.transform(upto, lambda a: F.when(a == "", F.lit("/")).otherwise(a))


def one_of(value: Column, texts: Iterable[str]) -> Column:
    """Whether ``value`` is one of ``texts``: one expression, however many they are, which looks them up by hash."""
    return value.isin(sorted(set(texts)))


def under(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path is one of the prefixes or lies below one, by whole parts; both as ``path_key`` gives them.

    The path's own ancestors are looked up among the prefixes, so the plan is one expression for any number of
    them; ``operators.filters.longest_prefix`` takes prefixes from a table. Blank prefixes are ignored.
    """
    keys = {folder_key(p) for p in prefixes} - {""}
    return F.exists(ancestors(path), lambda a: one_of(a, keys)) if keys else F.lit(False)


def folder_key(path: str) -> str:
    """``path_key`` of one path of the driver's; empty for a blank one."""
    p = re.sub(r"[\\/]+", "/", path.strip()).lower()
    return posixpath.normpath(p) if p else ""


def thumbnail_key(path: Column, modified: Column) -> Column:
    """The name of a picture's preview: 24 digits of an MD5 of path and time."""
    return F.left(F.md5(F.concat_ws("|", path, modified.cast("string"))), F.lit(24))
