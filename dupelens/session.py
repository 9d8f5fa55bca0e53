"""Sessions with the settings that the operators are tuned for."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, as many shuffle partitions as cores."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]").appName("dupelens")
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on this machine find this package, whatever their folder; on a cluster use --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


_own: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its store: that of the default file system, where it names none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when this process ends: what is written once is read until then."""
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local.

    It is deleted at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="dupelens-")]
        base = "file://" + _own[0]
    return removed_at_exit(spark, f"{qualified(spark, base).rstrip('/')}/dupelens-{uuid.uuid4().hex}")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives executors; deleted at exit."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
