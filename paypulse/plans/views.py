"""The named views over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paypulse.operators.metrics import order_conversion, payment_failure_rate, revenue_per_minute
from paypulse.operators.unpack import unpack_orders, unpack_payments

#: The names ad-hoc queries may use.
VIEWS = (
    "curated_orders", "curated_payments", "v_revenue_per_minute", "v_payment_failure_rate", "v_order_conversion",
    "raw_orders_events", "v_orders", "raw_payments_events", "v_payments",
)


def register_views(
    *,
    orders: DataFrame,
    payments: DataFrame,
    raw_orders: DataFrame | None = None,
    raw_payments: DataFrame | None = None,
) -> list[str]:
    """Create or replace the temp views ad-hoc queries run on; returns their names.

    The views are plans, computed on read. They are unsorted: sort in the query.
    """
    views = {
        "curated_orders": orders,
        "curated_payments": payments,
        "v_revenue_per_minute": revenue_per_minute(payments),
        "v_payment_failure_rate": payment_failure_rate(payments),
        "v_order_conversion": order_conversion(orders, payments),
    }
    if raw_orders is not None:
        views |= {"raw_orders_events": raw_orders, "v_orders": unpack_orders(raw_orders)}
    if raw_payments is not None:
        views |= {"raw_payments_events": raw_payments, "v_payments": unpack_payments(raw_payments)}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)
