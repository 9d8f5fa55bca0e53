"""Duplicates of a growing inventory: files arrive in a stream, digests are kept by Structured Streaming.

Each new file is matched with the first of its size and digest that ever arrived. State is one row for each
distinct content, held by the state store on executors, so no batch reads earlier ones again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expr import full_hash

FOUND = "path string, size long, hash string, first_path string"
STATE = "first_path string"


def read_landing(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    size, digest = key
    first = state.get[0] if state.exists else None
    for pdf in batches:
        pdf = pdf.sort_values("walk_ord")
        start = 0
        if first is None and len(pdf):
            first, start = pdf["path"].iloc[0], 1
            state.update((first,))
        rest = pdf.iloc[start:]
        yield pd.DataFrame({"path": rest["path"], "size": size, "hash": digest, "first_path": first})


def stream_duplicates(files: DataFrame) -> DataFrame:
    """path, size, hash and first_path of each streamed file (path, size, walk_ord, content) whose content has been seen."""
    slim = files.filter("size > 0").select("path", "size", "walk_ord", full_hash(F.col("content")).alias("hash")).filter("hash IS NOT NULL")
    return slim.groupBy("size", "hash").applyInPandasWithState(_match, FOUND, STATE, "append", GroupStateTimeout.NoTimeout)
