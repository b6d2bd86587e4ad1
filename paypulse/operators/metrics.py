"""Per-minute payment metrics and the queries over their most recent minutes.

The metric functions return unsorted frames; only the ``*_last`` queries sort,
so no aggregate ever runs on top of a global sort.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from paypulse.functions.ratio import safe_pct
from paypulse.functions.time import as_utc, bucket_ceil, bucket_start, minutes_before, ntz
from paypulse.schemas import FAILED, PAID

# Default spans in minutes and rounding of the queries.
REVENUE_MINUTES = 60
RATE_MINUTES = 10
LOOKBACK_MINUTES, BASELINE_MINUTES = 5, 30
RATE_DIGITS, MEAN_DIGITS, CHANGE_DIGITS = 2, 2, 1


def payment_measures() -> list[Column]:
    """The aggregates behind revenue and failure rate, for any grouping of payments."""
    paid_amount = F.when(F.col("status") == PAID, F.col("amount")).otherwise(F.lit(0.0))
    failed = F.col("status") == FAILED
    return [
        F.sum(paid_amount).alias("revenue"),
        F.count("*").alias("total_payments"),
        F.count_if(failed).alias("failed_payments"),
        safe_pct(F.count_if(failed), F.count("*"), RATE_DIGITS).alias("failure_rate_pct"),
    ]


def payment_minutes(payments: DataFrame, grain: str = "minute") -> DataFrame:
    """minute, revenue, total_payments, failed_payments, failure_rate_pct in one aggregate."""
    minute = bucket_start(F.col("event_ts"), grain).alias("minute")
    return payments.groupBy(minute).agg(*payment_measures())


def revenue_per_minute(payments: DataFrame, grain: str = "minute") -> DataFrame:
    """minute, revenue: sum of paid amounts. A minute with failed payments only has 0."""
    return payment_minutes(payments, grain).select("minute", "revenue")


def payment_failure_rate(payments: DataFrame, grain: str = "minute") -> DataFrame:
    """minute, total_payments, failed_payments, failure_rate_pct."""
    return payment_minutes(payments, grain).select(
        "minute", "total_payments", "failed_payments", "failure_rate_pct"
    )


def order_conversion(
    orders: DataFrame, payments: DataFrame, grain: str = "minute", *, few_orders: bool = False
) -> DataFrame:
    """minute, total_orders, paid_orders, conversion_rate_pct, by the order's minute.

    An order counts once however many payments it has; payments without an order
    count nowhere.

    With ``few_orders``, for orders that are a part of those ever paid for, payments are
    reduced to theirs by a semi join first: Catalyst streams all payments past the broadcast
    ids where these are small enough, so no more than their payments is shuffled.

    Both sides are reduced to their distinct keys before the join. The reductions
    combine map-side, so neither an order with a huge number of payments nor an
    order id (or NULL) repeated over many order rows makes a hot join partition;
    and after them plain counts replace two distinct counts.
    """
    order_keys = orders.select(
        bucket_start(F.col("event_ts"), grain).alias("minute"), "order_id"
    ).distinct()
    paid = payments.where((F.col("status") == PAID) & F.col("order_id").isNotNull())
    if few_orders:
        paid = paid.join(orders.select("order_id").distinct(), "order_id", "left_semi")
    paid_keys = paid.select(F.col("order_id").alias("paid_id")).distinct()
    counts = (
        order_keys.join(paid_keys, F.col("order_id") == F.col("paid_id"), "left")
        .groupBy("minute")
        .agg(F.count("order_id").alias("total_orders"), F.count("paid_id").alias("paid_orders"))
    )
    return counts.withColumn(
        "conversion_rate_pct", safe_pct(F.col("paid_orders"), F.col("total_orders"), RATE_DIGITS)
    )


def _since(rows: DataFrame, start: datetime) -> DataFrame:
    """Rows whose minute is at or after ``start``; the filter reaches the scan."""
    return rows.where(F.col("event_ts") >= ntz(bucket_ceil(start)))


def _newest(metric: DataFrame, cap: int | None) -> DataFrame:
    """Newest minutes first; all of them unless ``cap`` asks for the newest ones only.

    A window has few minutes: the task that ends the aggregation sorts them, which takes no exchange of its own.
    """
    if cap is not None:
        return metric.orderBy(F.desc("minute")).limit(int(cap))
    return metric.coalesce(1).sortWithinPartitions(F.desc("minute"))


def last_minutes(
    per_minute: DataFrame, as_of: datetime | str | None, minutes: int, cap: int | None = None
) -> DataFrame:
    """The rows of a metric by minute from ``minutes`` before ``as_of`` on, newest first; ``cap`` keeps the newest ones."""
    start = bucket_ceil(minutes_before(as_utc(as_of), minutes))
    return _newest(per_minute.where(F.col("minute") >= ntz(start)), cap)


def revenue_last_minutes(
    payments: DataFrame,
    as_of: datetime | str | None = None,
    minutes: int = REVENUE_MINUTES,
    cap: int | None = None,
) -> DataFrame:
    """Revenue per minute from ``minutes`` before ``as_of`` on, newest first; ``cap`` keeps the newest ones."""
    start = minutes_before(as_utc(as_of), minutes)
    return _newest(revenue_per_minute(_since(payments, start)), cap)


def payment_failure_rate_last(
    payments: DataFrame,
    as_of: datetime | str | None = None,
    minutes: int = RATE_MINUTES,
    cap: int | None = None,
) -> DataFrame:
    """Failure rate per minute from ``minutes`` before ``as_of`` on, newest first."""
    start = minutes_before(as_utc(as_of), minutes)
    return _newest(payment_failure_rate(_since(payments, start)), cap)


def order_conversion_last(
    orders: DataFrame,
    payments: DataFrame,
    as_of: datetime | str | None = None,
    minutes: int = RATE_MINUTES,
    cap: int | None = None,
) -> DataFrame:
    """Conversion per minute from ``minutes`` before ``as_of`` on, newest first.

    Only orders are restricted in time: a payment may come any time after its order.
    """
    start = minutes_before(as_utc(as_of), minutes)
    return _newest(order_conversion(_since(orders, start), payments, few_orders=True), cap)


def revenue_anomaly(
    payments: DataFrame,
    as_of: datetime | str | None = None,
    lookback_minutes: int = LOOKBACK_MINUTES,
    baseline_minutes: int = BASELINE_MINUTES,
) -> DataFrame:
    """recent_avg_per_min, baseline_avg_per_min, pct_change; always one row.

    Means run over the minutes that have payments. The two windows are adjacent,
    so one scan of their union and one conditional aggregate serve both. The
    change is computed from the unrounded means.
    """
    as_of = as_utc(as_of)
    baseline_start = minutes_before(minutes_before(as_of, lookback_minutes), baseline_minutes)
    return anomaly_of(revenue_per_minute(_since(payments, baseline_start)), as_of, lookback_minutes, baseline_minutes)


def anomaly_of(
    per_minute: DataFrame, as_of: datetime | str | None = None, lookback_minutes: int = LOOKBACK_MINUTES,
    baseline_minutes: int = BASELINE_MINUTES,
) -> DataFrame:
    """``revenue_anomaly`` of revenue by minute, which may reach further back."""
    recent_start = minutes_before(as_utc(as_of), lookback_minutes)
    baseline_start = minutes_before(recent_start, baseline_minutes)
    is_recent = F.col("minute") >= ntz(recent_start)
    means = per_minute.where(F.col("minute") >= ntz(bucket_ceil(baseline_start))).agg(
        F.avg(F.when(is_recent, F.col("revenue"))).alias("recent"),
        F.avg(F.when(~is_recent, F.col("revenue"))).alias("baseline"),
    )
    recent, baseline = F.col("recent"), F.col("baseline")
    return means.select(
        F.round(recent, MEAN_DIGITS).alias("recent_avg_per_min"),
        F.round(baseline, MEAN_DIGITS).alias("baseline_avg_per_min"),
        safe_pct(recent - baseline, baseline, CHANGE_DIGITS).alias("pct_change"),
    )
