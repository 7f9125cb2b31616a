import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def normal(value):
    """A value as comparable text: floats to six digits."""
    import numpy as np

    if value is None or value != value and isinstance(value, float) or str(value) in ("<NA>", "NaT"):
        return "~"
    if isinstance(value, (list, np.ndarray)):
        return str([normal(v) for v in value])
    if isinstance(value, (float, np.floating)):
        return f"{value:.6g}"
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(normal, r)) for r in frame[columns].astype(object).values)
