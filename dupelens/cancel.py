"""Cancelling what runs: Spark jobs started within a block end when another thread says so."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The block's jobs were cancelled; it has no result."""


class Handle:
    """What other threads hold; ``cancel`` may be called at any time and more than once."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag, self.cancelled, self.partial = spark, tag, False, False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """Raise between two steps of a longer action, so that none begins after the word."""
        if self.cancelled:
            raise Cancelled


@contextmanager
def cancellable(spark: SparkSession, partial: bool = False) -> Iterator[Handle]:
    """``with cancellable(spark) as handle``: a cancelled block raises ``Cancelled``, whatever its jobs raised.

    With ``partial``, a block in which a walk of trees was given the handle and stopped with what it had
    (``handle.partial`` is true then) ends as usual.
    """
    context, handle = spark.sparkContext, Handle(spark, f"dupelens-{uuid.uuid4().hex}")
    context.addJobTag(handle.tag)
    try:
        yield handle
        if not (partial and handle.partial):
            handle.check()
    except Exception as error:
        if handle.cancelled and not isinstance(error, Cancelled):
            raise Cancelled from error
        raise
    finally:
        context.removeJobTag(handle.tag)
