"""Views that outlive the session that made them."""

import pytest

from paypulse.operators import metrics
from paypulse.operators.unpack import unpack_payments
from paypulse.schemas import ORDERS, PAYMENTS
from paypulse.sources import keyed
from paypulse.sources.catalog import publish_views
from paypulse.sources.layers import compact_curated, read_curated, register_layers, scan
from paypulse.streaming.promote import start_promote

from tests.conftest import rows_of
from tests.test_streaming import ONCE, history, land


@pytest.fixture
def catalog(spark):
    def drop():
        for database in ("raw", "curated", "analytics"):
            spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")

    drop()
    yield spark
    drop()


def test_another_session_reads_the_views(catalog, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "TIER", 2)
    spark, root, records = catalog, str(tmp_path), history(41, 60)
    register_layers(spark, root, catalog=True)
    publish_views(spark, root)
    other = spark.newSession()
    assert other.table("curated.orders").count() == 0 and other.table("curated.payments").dtypes == read_curated(spark, root, PAYMENTS).dtypes
    for batch in range(4):
        land(spark, root, records[15 * batch : 15 * batch + 15])
        if batch == 3:
            compact_curated(spark, root, PAYMENTS)
        start_promote(spark, root, ONCE, catalog=True).awaitTermination()
        if batch < 2:
            continue
        orders, payments = (read_curated(spark, root, t) for t in (ORDERS, PAYMENTS))
        assert rows_of(other.table("curated.orders")) == rows_of(orders)
        assert rows_of(other.table("curated.payments")) == rows_of(payments)
    for name, frame in (
        ("v_revenue_per_minute", metrics.revenue_per_minute(payments)), ("v_payment_failure_rate", metrics.payment_failure_rate(payments)),
        ("v_order_conversion", metrics.order_conversion(orders, payments)),
    ):
        view = other.table(f"analytics.{name}")
        assert view.columns == frame.columns and rows_of(view) == rows_of(frame)
    other.catalog.refreshTable("raw.payments_events")
    raw = unpack_payments(scan(spark, root, "raw", PAYMENTS.raw_table)).drop("payload")
    assert rows_of(other.table("raw.v_payments").drop("payload")) == rows_of(raw)
    assert other.sql("SELECT count(*) AS n FROM raw.v_orders WHERE payload IS NOT NULL").first().n == sum(r[2] == "orders" for r in records)
