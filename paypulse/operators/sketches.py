"""Approximate distinct counts from sketches that are kept by minute and merged into hours and days without their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paypulse.functions.ratio import safe_pct
from paypulse.functions.time import bucket_start
from paypulse.operators.metrics import RATE_DIGITS
from paypulse.schemas import PAID

#: Sketches have 2 to this power registers.
SKETCH_BITS = 14
#: Four standard errors, 1.04 / sqrt(2 ** SKETCH_BITS) each: an estimate is further off once in 16,000 times.
ERROR_BOUND = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


def conversion_sketches(orders: DataFrame, payments: DataFrame, grain: str = "minute") -> DataFrame:
    """minute, orders, paid: sketches of the order ids of each bucket, and of those that a payment has paid for.

    Orders are sketched as they come, however often one is repeated; sketches combine before the shuffle, so a bucket costs
    one small row for each task. Rows without an order_id are in no sketch.
    """
    paid = payments.where((F.col("status") == PAID) & F.col("order_id").isNotNull()).select(F.col("order_id").alias("paid_id")).distinct()
    known = orders.select(bucket_start(F.col("event_ts"), grain).alias("minute"), "order_id")
    joined = known.join(paid, F.col("order_id") == F.col("paid_id"), "left")
    return joined.groupBy("minute").agg(
        F.hll_sketch_agg("order_id", SKETCH_BITS).alias("orders"), F.hll_sketch_agg("paid_id", SKETCH_BITS).alias("paid")
    )


def merge_sketches(sketches: DataFrame, grain: str) -> DataFrame:
    """The sketches of finer buckets as those of ``grain``; an id that several of them hold counts once."""
    bucket = bucket_start(F.col("minute"), grain).alias("bucket")
    merged = sketches.groupBy(bucket).agg(F.hll_union_agg("orders").alias("orders"), F.hll_union_agg("paid").alias("paid"))
    return merged.withColumnRenamed("bucket", "minute")


def approximate_conversion(sketches: DataFrame) -> DataFrame:
    """minute, total_orders, paid_orders, conversion_rate_pct as ``order_conversion`` gives them, the counts within
    ``ERROR_BOUND`` of the exact ones."""
    total, paid = (F.hll_sketch_estimate(c) for c in ("orders", "paid"))
    counts = sketches.select("minute", total.alias("total_orders"), paid.alias("paid_orders"))
    return counts.withColumn("conversion_rate_pct", safe_pct(F.col("paid_orders"), F.col("total_orders"), RATE_DIGITS))
