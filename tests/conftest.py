import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import types as T  # noqa: E402

from paypulse.schemas import ORDERS, PAYMENTS  # noqa: E402
from paypulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text):
    """``hh:mm[:ss]`` on 2024-01-01, or a full ISO time; None stays None."""
    if text is None:
        return None
    return datetime.fromisoformat(text if "-" in text else f"2024-01-01T{text}")


@pytest.fixture
def payments(spark):
    """CURATED payments from (payment_id, order_id, status, amount, event_ts[, load_time])."""

    def make(rows):
        full = [(*r[:4], at(r[4]), at(r[5] if len(r) > 5 else r[4])) for r in rows]
        return spark.createDataFrame(full, PAYMENTS.schema)

    return make


@pytest.fixture
def orders(spark):
    """CURATED orders from (order_id, event_ts[, load_time])."""

    def make(rows):
        full = [
            (r[0], "C1", 10.0, "USD", at(r[1]), at(r[2] if len(r) > 2 else r[1])) for r in rows
        ]
        return spark.createDataFrame(full, ORDERS.schema)

    return make


@pytest.fixture
def versions(spark):
    """Keyed versions from (key, value, load_time, seq)."""
    schema = T.StructType([
        T.StructField("k", T.StringType()),
        T.StructField("v", T.StringType()),
        T.StructField("load_time", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
    ])

    def make(rows):
        return spark.createDataFrame([(k, v, at(t), s) for k, v, t, s in rows], schema)

    return make


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
