from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """The rows as a sorted list of tuples, nulls first."""
    got = [tuple(r[c] for c in cols or df.columns) for r in df.collect()]
    return sorted(got, key=lambda t: tuple((v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in t))


@pytest.fixture
def as_rows():
    return rows
