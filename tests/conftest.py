import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

EVENTS = "id long, time timestamp_ntz, class string, text_value string, numeric_value double, _src long"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def events(spark):
    """Rows (id, time, class, text, number) to an event table; times are ISO strings or None."""

    def make(rows, extra=None):
        out = [(i, None if t is None else dt.datetime.fromisoformat(t), c, x, None if v is None else float(v), k) for k, (i, t, c, x, v) in enumerate(rows)]
        return spark.createDataFrame(out, EVENTS)

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, list) else (False, "", str(x)) for x in r))
