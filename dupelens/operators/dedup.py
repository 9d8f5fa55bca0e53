"""Exact duplicates: block by size, fingerprint, group, verify.

The result, ``members``, is flat: group_key (for display), block_ord and group_ord (walk positions that order the
groups), member_ord (0 is the original), the inventory's columns and the hash. Groups are formed on columns,
never on the joined key. Contents are hashed where they are read and no body crosses a shuffle: the shuffles
carry paths, sizes, times and digests.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import full_hash, turbo_hash
from ..joins import few, numbered, numbered_within
from ..session import write_once
from .filters import dedup_physical, exclude, prune, size_range

INVENTORY = ("path", "name", "size", "created", "modified", "ext", "category", "dev", "ino", "walk_ord")
MEMBERS = ("group_key", "block_ord", "group_ord", "member_ord", "path", "name", "size", "created", "modified", "ext", "category", "hash", "walk_ord")


@dataclass(frozen=True)
class Criteria:
    """What makes two files equal, and which files are looked at."""

    by_name: bool = False
    by_size: bool = True
    by_hash: bool = True
    by_byte: bool = False
    turbo: bool = True
    partial: int = 65536
    exclude: Sequence[str] = field(default=())
    min_size: int = 0
    max_size: int | None = None
    ignore_empty: bool = True

    def __post_init__(self) -> None:
        if not (self.by_name or self.by_size or self.by_hash or self.by_byte):
            raise ValueError("choose at least one of name, size, hash and bytes")


#: Named criteria.
PRESETS = {
    "turbo": Criteria(),
    "standard": Criteria(turbo=False),
    "paranoid": Criteria(turbo=False, by_byte=True),
}


#: Repeating sizes are broadcast up to this number (16 bytes each) to skip the contents of unique sizes.
BROADCAST_SIZES = 500_000


def looked_at(inv: DataFrame, c: Criteria, roots: Sequence[str] = ()) -> DataFrame:
    """Rows left by the tests that need no other row."""
    return size_range(exclude(prune(inv, roots), c.exclude), c.min_size, c.max_size, c.ignore_empty)


def scanned(inv: DataFrame, c: Criteria, roots: Sequence[str] = ()) -> DataFrame:
    """Rows that a scan looks at, without content.

    Exclusion comes before physical identity: an excluded alias doesn't hide a file.
    """
    return dedup_physical(looked_at(inv, c, roots).drop("content"))


def size_candidates(inv: DataFrame) -> DataFrame:
    """Rows whose size occurs more than once, with block_ord: the first walk position of the size.

    Sizes are counted map-side first, over their column alone; adaptive execution broadcasts them or splits a
    hot size in the join back.
    """
    often = inv.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min("walk_ord").alias("block_ord")).filter("n > 1").drop("n")
    return inv.join(often, "size")


def candidate_stats(inv: DataFrame, by_size: bool = True) -> DataFrame:
    """One row: groups and files that would be fingerprinted; without blocking one group of all, if several."""
    n = F.count(F.lit(1))
    if by_size:
        return inv.groupBy("size").agg(n.alias("n")).filter("n > 1").agg(n.alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
    one = inv.agg(n.alias("n"))
    return one.select(F.when(F.col("n") > 1, 1).otherwise(0).cast("long").alias("groups"), F.when(F.col("n") > 1, F.col("n")).otherwise(0).cast("long").alias("files"))


def _grouped(rows: DataFrame, keys: list[str], by_walk: bool = False) -> DataFrame:
    """Rows whose keys occur more than once, with group_ord and member_ord.

    Groups are counted map-side, and a group of very many rows is split where it is joined and where it is ordered.
    """
    keys = keys or ["_all"]
    rows = rows.withColumn("_all", F.lit(0))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("walk_ord").alias("group_ord")).filter("_n > 1").drop("_n")
    order = ["walk_ord"] if by_walk else ["modified", "walk_ord"]
    return numbered_within(rows.join(groups, keys), keys, order, "member_ord").drop("_all")


def find_duplicates(inv: DataFrame, criteria: Criteria = Criteria(), roots: Sequence[str] = (), hashes: DataFrame | None = None) -> DataFrame:
    """Groups of equal files; ``inv`` has ``content`` if hashes or bytes are compared, or ``full``, the known fingerprints.

    Contents are read once: the slim rows with their fingerprints are written to the shared folder.
    ``hashes`` (path, full_hash): known fingerprints of some paths; only rows without one are hashed, and
    ``cache.incremental`` does so in one scan. Rows that can't be hashed belong to no group. Members are ordered oldest first, ties by walk; where
    sizes alone are compared, by walk.

    Partial hashes are a way to read less, not another result: groups of equal partial hashes are split by the
    whole content, which equal contents never are. So turbo mode is planned as one grouping by whole content,
    whose key leaves no choice of size, as verification does.
    """
    c = criteria
    rows = looked_at(inv, c, roots)
    if (c.by_hash or c.by_byte) and "full" not in inv.columns:
        if c.by_size:
            often = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
            if few(often, BROADCAST_SIZES):
                rows = rows.join(F.broadcast(often.withColumn("_often", F.lit(True))), "size", "left")
        # unique sizes are not hashed; their rows go on, as they may be the first of an inode
        digest = F.when(F.col("_often"), full_hash(F.col("content"))) if "_often" in rows.columns else full_hash(F.col("content"))
        if hashes is not None:
            known = hashes.filter(F.col("full_hash").isNotNull()).select("path", F.col("full_hash").alias("full"))
            slim = rows.drop("content", "_often").join(known, "path")
            rows = slim.unionByName(rows.withColumn("full", digest).drop("content", "_often").join(known.select("path"), "path", "left_anti"))
        else:
            rows = rows.withColumn("full", digest).drop("content")  # bodies go before any shuffle
        rows = write_once(rows.drop("content", "_often"), "hashed")
    rows = dedup_physical(rows.drop("content", "_often")).withColumn("low_name", F.lower("name"))
    first = rows.groupBy("size").agg(F.min("walk_ord").alias("block_ord")) if c.by_size else None
    keys = ["size"] * c.by_size + ["low_name"] * c.by_name
    shown = keys
    if c.by_hash:
        rows = rows.filter(F.col("full").isNotNull())
        shown = ["low_name"] * c.by_name + ["size", "full"] if c.turbo else [*keys, "full"]
        out = _grouped(rows, shown).withColumn("hash", F.col("full"))
    elif c.by_byte:  # files of one group are split by content; the parts are numbered by their first members
        split = _grouped(rows.filter(F.col("full").isNotNull()), [*dict.fromkeys([*keys, "size", "full"])])
        heads = split.filter("member_ord = 0").select(*keys, "group_ord")  # a row a group
        heads = numbered_within(heads, keys, ["group_ord"], "sub") if keys else numbered(heads, ["group_ord"], "sub")
        out = split.join(heads.select("group_ord", "sub"), "group_ord").withColumn("hash", F.lit(None).cast("string"))
    else:
        out = _grouped(rows, keys, by_walk=not c.by_name).withColumn("hash", F.lit(None).cast("string"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in shown])
    if c.by_byte and not c.by_hash:
        name = F.concat(name, F.lit("_b"), F.col("sub").cast("string"))
    out = out.join(first, "size") if first is not None else out.withColumn("block_ord", F.lit(0).cast("long"))
    return out.withColumn("group_key", name).select(*[F.col(m) for m in MEMBERS])


def turbo_candidates(inv: DataFrame, criteria: Criteria) -> DataFrame:
    """Groups of equal partial hashes, before verification: size, hash and number of files."""
    hashed = looked_at(inv, criteria).withColumn("hash", turbo_hash(F.col("content"), F.col("size"), criteria.partial)).drop("content")
    rows = dedup_physical(hashed)
    return rows.filter(F.col("hash").isNotNull()).groupBy("size", "hash").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def nested(members: DataFrame) -> DataFrame:
    """A row a group: group_key, block_ord, group_ord and ``files``, structs in member order."""
    fields = [c for c in MEMBERS if c not in ("group_key", "block_ord", "group_ord")]
    files = F.array_sort(F.collect_list(F.struct("member_ord", *[f for f in fields if f != "member_ord"])))
    return members.groupBy("group_key", "block_ord", "group_ord").agg(files.alias("files"))


def find_copies(inv: DataFrame, sample: DataFrame, criteria: Criteria = Criteria(turbo=False)) -> DataFrame:
    """Rows of ``inv`` equal to the one row of ``sample`` by the criteria, in walk order, without the sample.

    The sample's own path and inode are left out; patterns, empty files and aliases among the others are not.
    Comparing sizes, hashes or bytes implies equal sizes, which are tested before any content is read.
    """
    c = criteria
    s = sample.limit(1).select(
        F.lower("path").alias("s_path"), F.lower("name").alias("s_name"), F.col("size").alias("s_size"), F.col("dev").alias("s_dev"), F.col("ino").alias("s_ino"),
        (full_hash(F.col("content")) if c.by_hash or c.by_byte else F.lit(None).cast("string")).alias("s_hash"),
    )
    on = (F.lower("path") != F.col("s_path")) & ~((F.coalesce("ino", F.lit(0)) != 0) & F.col("ino").eqNullSafe(F.col("s_ino")) & F.col("dev").eqNullSafe(F.col("s_dev")))
    if c.by_size or c.by_hash or c.by_byte:
        on &= F.col("size") == F.col("s_size")
    if c.by_name:
        on &= F.lower("name") == F.col("s_name")
    rows = inv.join(F.broadcast(s), on)  # one row
    if c.by_hash or c.by_byte:
        rows = rows.withColumn("hash", full_hash(F.col("content"))).filter(F.col("hash") == F.col("s_hash"))
    else:
        rows = rows.withColumn("hash", F.lit(None).cast("string"))
    return rows.drop("content", "s_path", "s_name", "s_size", "s_dev", "s_ino", "s_hash")


def with_sample_first(found: DataFrame, sample: DataFrame, key: str = "sample") -> DataFrame:
    """Found copies as one group with the sample as member 0."""
    cols = [c for c in found.columns if c in sample.columns]
    both = sample.limit(1).select(*cols, F.lit(-1).cast("long").alias("_o")).unionByName(found.select(*cols, F.col("walk_ord").alias("_o")))
    w = Window.partitionBy("group_key").orderBy("_o")
    return both.withColumn("group_key", F.lit(key)).withColumn("member_ord", (F.row_number().over(w) - 1).cast("long")).drop("_o")
