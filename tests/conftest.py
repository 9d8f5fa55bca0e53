"""One local session for all tests, and helpers to make inventories of a few rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from dupelens.session import ship_package

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def files(spark):
    """files([(path, content, modified)...]) -> inventory; inodes differ unless given as a fourth value."""
    from dupelens.sources.inventory import derived

    def make(rows):
        full = []
        for k, (path, content, modified, *ino) in enumerate(rows):
            size = len(content) if content is not None else 1
            full.append((path, path.rsplit("/", 1)[-1], size, 0.0, float(modified), 1, ino[0] if ino else k + 1, k, content))
        return derived(spark.createDataFrame(full, "path string, name string, size long, created double, modified double, dev long, ino long, walk_ord long, content binary"))

    return make
