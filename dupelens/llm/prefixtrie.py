"""Conversation prefix trie: which conversations share how much of their beginnings.

1. A turn becomes the SHA-256 of its role and text. A prefix of d turns is named by d and 128 bits: exclusive ors,
   over its turns, of two 64-bit hashes of (place, digest). Such names are running totals, so a conversation of any
   length spans as many tasks as it needs (``joins.running``).
2. Prefixes that several conversations share are counted, with the least conversation of each, its owner. If a
   conversation owns a prefix, it owns all its longer ones.
3. Each conversation's first owned depth is found by binary search: conversations are cut into pieces of up to
   ``PIECE`` turns, each of which searches its own; in a round, the middle prefixes of all open pieces are joined with
   the shared prefixes, and each piece keeps the half that is still open. So a round sends half of what the one
   before sent.
4. The prefixes that a conversation owns are its chain. A chain hangs below the node that owns the prefix
   before its first. Values of chains are added up bottom-up, over twice the distance each round, and values of nodes
   are running totals along their chain from its end.

Defined results: null roles and texts are empty; turns are in order of turn (nulls first), role and digest, so ties and
repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table has no nodes, not
even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import running, shuffled, spread_join
from .common import materialize

#: Prefixes of a piece: 24 bytes each while they are open.
PIECE = 256
#: Rows of a conversation each are broadcast up to this number, else salted.
BROADCAST_CONVS = 20_000
#: Ids whose decimals are put together before they are hashed in order, about 1 MB.
IDS = 100_000
#: A conversation begins with this many turns of another at most.
HEADS = 5


def signed(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place of the turn, from 1), sig (digest of role and text) and chars (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sig = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), sig.alias("sig"), F.length(text).cast("long").alias("chars"))
    return running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "sig"], {"i": F.lit(1)}).select("conv_id", "i", "sig", "chars")


def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv.cast("string")) % (HEADS + 1)


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the one whose id is theirs without the last two digits."""
    base = lambda c: c - c % 100
    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("i") <= HEADS)).withColumnRenamed("conv_id", "base")
    taken = shuffled(convs.withColumn("base", base(F.col("conv_id"))), heads, ["base"]).filter(F.col("i") <= heads_of(F.col("conv_id")))
    sizes = heads.groupBy("base").agg(F.max("i").alias("n"))
    own = turns.withColumn("base", base(F.col("conv_id"))).withColumn("h", heads_of(F.col("conv_id"))).filter(F.col("i") > F.col("h"))
    own = spread_join(own, sizes, ["base"], BROADCAST_CONVS, "left", "i")
    own = own.withColumn("i", F.col("i") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0))))
    return taken.select("conv_id", "i", "sig", "chars").unionByName(own.select("conv_id", "i", "sig", "chars"))


def _first_owned(prefixes: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id and f, the first depth of an owned prefix, of conversations that own any."""
    cut = F.floor((F.col("depth") - 1) / PIECE)
    pieces = prefixes.groupBy("conv_id", cut.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("open"))
    # all before `first` are owned by others, `first` and all behind `open` by the conversation
    state = pieces.select("conv_id", F.col("open")[0]["depth"].alias("first"), F.element_at("open", -1)["depth"].alias("last"), "open")
    state, found = materialize(state, "pieces"), None
    while not state.isEmpty():
        middle = state.withColumn("mid", F.floor(F.size("open") / 2).cast("int")).withColumn("at", F.col("open")[F.col("mid")])
        middle = middle.withColumns({"depth": F.col("at")["depth"], "a": F.col("at")["a"], "b": F.col("at")["b"]})
        met = shuffled(middle, shared.select("depth", "a", "b", "owner"), ["depth", "a", "b"], "left")
        owns = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        half = F.when(owns, F.slice("open", F.lit(1), F.col("mid"))).otherwise(F.slice("open", F.col("mid") + 2, F.size("open")))
        met = met.select("conv_id", F.when(owns, F.col("first")).otherwise(F.col("depth") + 1).alias("first"), "last", half.alias("open"))
        met = materialize(met, "halves")
        done = met.filter((F.size("open") == 0) & (F.col("first") <= F.col("last"))).select("conv_id", "first")
        found = done if found is None else found.unionByName(done)
        state = met.filter(F.size("open") > 0)
    return found.groupBy("conv_id").agg(F.min("first").alias("f")) if found is not None else prefixes.select("conv_id", F.col("depth").alias("f")).limit(0)


def _totals(chains: DataFrame) -> DataFrame:
    """conv_id with leaves and saved of the chain and all that hang below it; ``up`` is the chain it hangs on.

    Each round, a chain takes the totals of those 2^k above which it stands, so rounds grow with the logarithm of the depth.
    """
    state = materialize(chains.select("conv_id", "up", "leaves", "saved"), "totals")
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        below = state.filter(F.col("up").isNotNull()).groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "conv_id")
        more = shuffled(state, below, ["conv_id"], "left").select("conv_id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = materialize(spread_join(more, above, ["up"], BROADCAST_CONVS, "left", "conv_id").select("conv_id", F.col("next").alias("up"), "leaves", "saved"), "totals")
    return state.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the ascending decimal ids of ``member`` of each node."""
    numbered = running(ends, ["conv_id", "depth"], ["member"], {"k": F.lit(1)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",")
    parts = numbered.groupBy("conv_id", "depth", F.floor((F.col("k") - 1) / IDS).alias("part")).agg(text.alias("ids"))
    ordered = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    schema = "conv_id long, depth long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.record_batch(dict(zip(("conv_id", "depth", "ends_sha256"), zip(*out, strict=True), strict=True)))
        if node is not None:
            yield pa.record_batch({"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]})

    return ordered.mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie of ``turns`` (conv_id, i, sig, chars; i runs from 1); ``convs`` has every conv_id once.

    conv_id is the node's smallest member; n_leaves and saved_tokens hold for the subtree; ends_sha256 is of the
    ids of the conversations that end at the node.
    """
    convs = materialize(convs.select("conv_id"), "convs")
    root = convs.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    lanes = {"a": F.xxhash64("sig", "i", F.lit(1)), "b": F.xxhash64("i", "sig", F.lit(2))}
    prefixes = materialize(running(turns, ["conv_id"], ["i"], {}, lanes).select("conv_id", F.col("i").alias("depth"), "a", "b", "chars"), "prefixes")
    shared = prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 1")
    shared = materialize(shared, "shared")
    size = prefixes.groupBy("conv_id").agg(F.max("depth").alias("n"))
    none = F.when(F.col("conv_id") == F.lit(root["root"]), 0)  # the least conversation owns all its prefixes
    info = shuffled(shuffled(convs, size, ["conv_id"], "left"), _first_owned(prefixes, shared), ["conv_id"], "left")
    info = info.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("f", F.coalesce(none, "f", F.col("n") + 1).cast("long"))
    # where each chain, or a conversation without one, hangs
    before = shuffled(info.filter("f > 1").select("conv_id", (F.col("f") - 1).alias("depth")), prefixes.drop("chars"), ["conv_id", "depth"])
    above = shuffled(before, shared.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).select("conv_id", "owner")
    hung = F.when(F.col("f") == 1, F.lit(root["root"])).otherwise(F.col("owner")).cast("long")
    info = materialize(shuffled(info, above, ["conv_id"], "left").select("conv_id", "n", "f", hung.alias("up")), "info")
    nodes = spread_join(prefixes, info.select("conv_id", "n", "f"), ["conv_id"], BROADCAST_CONVS, by="depth").filter("depth >= f")
    nodes = shuffled(nodes, shared.drop("owner"), ["depth", "a", "b"], "left").select("conv_id", "depth", "n", "f", "chars", F.coalesce("n_convs", F.lit(1)).alias("n_convs"))
    top = info.filter("f = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), "n", "f", F.lit(0).cast("long").alias("chars"), F.lit(root["n"]).cast("long").alias("n_convs"))
    nodes = materialize(nodes.unionByName(top).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    hanging = info.filter("f <= n AND f > 0").select("conv_id", F.col("up"), (F.col("f") - 1).alias("depth"))
    under = materialize(hanging.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("chains")), "under")
    leaf = info.filter("f <= n OR f = 0").select("conv_id", F.col("n").alias("depth"), F.when(F.col("f") > 0, F.col("up")).alias("up"))
    leaf = shuffled(leaf, under, ["conv_id", "depth"], "left")
    saved = nodes.groupBy("conv_id").agg(F.sum("saving").alias("saved"))
    chains = shuffled(leaf.withColumn("leaves", F.when(F.col("chains").isNull(), 1).otherwise(0).cast("long")), saved, ["conv_id"])
    totals = _totals(chains)
    below = shuffled(hanging, totals, ["conv_id"]).groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("chains"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    met = shuffled(nodes, below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("chains", F.lit(0)) + F.when(F.col("depth") < F.col("n"), 1).otherwise(0))
    leaves = F.coalesce("leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)
    summed = running(met.withColumns({"x": leaves, "y": F.col("saving") + F.coalesce("saved", F.lit(0))}).drop("leaves", "saved"), ["conv_id"], [F.col("depth").desc()], {"n_leaves": F.col("x"), "saved_tokens": F.col("y")})
    heads = info.select("conv_id", F.col("f").alias("depth"), "up")
    ends = _digests(info.select(F.when(F.col("f") <= F.col("n"), F.col("conv_id")).when(F.col("f") == 0, F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member")))
    out = shuffled(shuffled(summed, heads, ["conv_id", "depth"], "left"), ends, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("f"), F.col("up")).otherwise(F.col("conv_id"))
    return out.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
