"""Metrics straight from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paypulse.operators.metrics import payment_measures


def tumbling_metrics(payments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """minute, revenue, total_payments, failed_payments, failure_rate_pct per closed minute.

    For append-only streams of typed payments. Unlike the metrics kept up to date
    from the CURATED tables, this drops payments later than ``delay`` and payments
    without a time, and in append mode emits a minute only once the watermark has
    passed its end. State is one small row per open minute. Watermarks need zoned
    times: run it in a UTC session, where the conversion changes nothing.
    """
    counts = (
        payments.withColumn("_at", F.col("event_ts").cast("timestamp"))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", "1 minute"))
        .agg(*payment_measures())
    )
    minute = F.col("window.start").cast("timestamp_ntz").alias("minute")
    return counts.select(minute, *[c for c in counts.columns if c != "window"])
