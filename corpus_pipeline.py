"""A corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources
are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again for the next.

Defined results: all but the last stage return the columns they are given, in their order, whatever their names: own
columns are set aside under other names while an operator works, so none meets a column of the operator. Only text
(and n_chars, its length in code points) is changed, by the line stage. Null texts are empty, null sources are a
source, null ids are kept; rows of one id are judged each by its own text. Empty tables give empty results. The last
stage returns the columns of ``dupelens.llm.bpe.encode``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupelens.llm.bpe import encode
from dupelens.llm.common import materialize
from dupelens.llm.linededup import dedup_lines
from dupelens.llm.mixing import mix, quality_weights
from dupelens.llm.ngramjoin import one_of_each
from dupelens.llm.queries import BYTE_VOCABULARY, table, vocabulary
from dupelens.llm.toxicity import held_out, score, train


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``needed`` columns under names that no operator uses, and what gives the names back."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    names = {c: c if c in needed else f"_aside_{k}" for k, c in enumerate(docs.columns)}
    return docs.select([quoted(c).alias(n) for c, n in names.items()]), lambda out: out.select([F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    rows, back = _aside(docs, "doc_id", "text")
    return back(score(rows, *train(rows, labels)).filter(F.col("predicted") == 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows."""
    rows, back = _aside(docs, "doc_id", "text")
    out = back(dedup_lines(rows))
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    rows, back = _aside(docs, "doc_id", "text")
    return back(one_of_each(rows))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's budget takes it."""
    rows, back = _aside(docs, "doc_id", "text", "source")
    mixed = mix(rows, quality=quality_weights(table(spark, sf_dir, "labels")), keep_text=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return back(mixed.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' numbers and digests of each document that is left."""
    return encode(docs, vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN, ids=False, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]
#: The classifier can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
