"""Exact metrics kept up to date batch by batch.

An update may move a payment to another minute, change its status or point it to another order. Sums of amounts can't be
corrected exactly by differences, so each batch recomputes, from the CURATED payments, the minutes its changes touched, before
and after. Counts can: conversion is kept by what each touched order was and is, its minute and how many payments have paid for
it, which two indexes by order tell without a scan of the orders or the payments. The stored metric is a log: per minute the
last batch that wrote it counts.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paypulse.functions.ratio import safe_pct
from paypulse.functions.time import bucket_start
from paypulse.operators.metrics import RATE_DIGITS, order_conversion, payment_minutes
from paypulse.schemas import MINUTES, ORDERS, PAID, PAYMENTS, EventTable
from paypulse.session import together
from paypulse.sources import batchlog, keyed
from paypulse.sources.layers import (
    change_schema, committed_batch, curated_path, curated_table, layer_path, paid_orders_table, read_curated, read_minutes,
)

#: Ranges of days in a filter.
MAX_RANGES = 100

# The metrics and the stored columns they consist of.
METRICS = {
    "revenue_per_minute": ("payment_minutes", ("revenue",)),
    "payment_failure_rate": (
        "payment_minutes", ("total_payments", "failed_payments", "failure_rate_pct"),
    ),
    "order_conversion": ("order_minutes", ("total_orders", "paid_orders", "conversion_rate_pct")),
}


def _touched_minutes(changes: DataFrame) -> DataFrame:
    """Minutes of the new and the replaced rows; a NULL time is a minute of its own."""
    times = changes.select("event_ts").unionByName(
        changes.where(F.col("before").isNotNull()).select(F.col("before.event_ts").alias("event_ts"))
    )
    return times.select(bucket_start(F.col("event_ts")).alias("minute")).distinct()


def _in_minutes(rows: DataFrame, minutes: DataFrame) -> DataFrame:
    """The rows whose minute is among ``minutes``, a cached frame.

    The days of the minutes go into a filter on the time column, as ranges, so the scan
    skips what lies outside them and a single late event costs its own day; the join then
    picks the minutes themselves. Very many separate days are filtered by ``MAX_RANGES``
    wider ranges. Taking the days fills the cache, so Catalyst knows the true size of the
    join's small side when it decides whether to broadcast it.
    """
    days = sorted({r.day for r in minutes.select(F.to_date("minute").alias("day")).distinct().collect()}, key=str)
    ts = F.col("event_ts")
    keep = ts.isNull() if None in days else F.lit(False)
    for first, last in _ranges([d for d in days if d is not None]):
        after = F.lit(str(last + timedelta(days=1))).cast("timestamp_ntz")
        keep = keep | ((ts >= F.lit(str(first)).cast("timestamp_ntz")) & (ts < after))
    wanted = minutes.select(F.col("minute").alias("_wanted"))
    return (
        rows.where(keep)
        .withColumn("_minute", bucket_start(ts))
        .join(wanted, F.col("_minute").eqNullSafe(F.col("_wanted")), "left_semi")
        .drop("_minute")
    )


def _ranges(days: list[date]) -> list[tuple[date, date]]:
    """Sorted days as (first, last) of runs without gaps; the smallest gaps close where there are too many."""
    if not days:
        return []
    gaps = sorted(((b - a).days, k) for k, (a, b) in enumerate(zip(days, days[1:])))
    cuts = sorted(k for gap, k in gaps[-(MAX_RANGES - 1):] if gap > 1)
    return list(zip([days[0], *(days[k + 1] for k in cuts)], [*(days[k] for k in cuts), days[-1]]))


def _store(values: DataFrame, minutes: DataFrame, root: str, stored: str, batch_id: int) -> None:
    """Store the new values of ``minutes``; a minute without rows is stored as gone."""
    names = MINUTES[stored].names[1:]
    values = values.select(F.col("minute").alias("_minute"), *names, F.lit(True).alias("_found"))
    rows = minutes.join(values, F.col("minute").eqNullSafe(F.col("_minute")), "left").select(
        "minute", *names, F.coalesce("_found", F.lit(False)).alias("present")
    )
    batchlog.write_batch(rows, layer_path(root, "analytics", stored), batch_id)


def _changes_of(spark: SparkSession, root: str, table: EventTable, batch_id: int) -> DataFrame:
    return batchlog.read_batches(
        spark, curated_path(root, table), change_schema(table), batch_id - 1, batch_id
    )


def update_metrics(spark: SparkSession, root: str, batch_id: int) -> None:
    """Bring the stored metrics up to ``batch_id``, whose changes must be written already."""
    payment_changes = _changes_of(spark, root, PAYMENTS, batch_id)
    steps = []
    if batch_id > batchlog.manifest_of(spark, layer_path(root, "analytics", "payment_minutes")).merged:
        steps.append(partial(_update_payment_minutes, spark, root, batch_id, payment_changes))
    merged = max(
        batchlog.manifest_of(spark, path).merged
        for path in (paid_orders_table(root).path, layer_path(root, "analytics", "order_minutes"))
    )
    if batch_id > merged:
        steps.append(partial(_update_conversion, spark, root, batch_id, _changes_of(spark, root, ORDERS, batch_id), payment_changes))
    if steps:
        together(spark, *steps)


def _update_payment_minutes(spark: SparkSession, root: str, batch_id: int, payment_changes: DataFrame) -> None:
    minutes = _touched_minutes(payment_changes).persist()
    try:
        touched = _in_minutes(read_curated(spark, root, PAYMENTS, batch_id), minutes)
        _store(payment_minutes(touched), minutes, root, "payment_minutes", batch_id)
    finally:
        minutes.unpersist()


def _paid(status: str, order_id: str) -> Column:
    return (F.col(status) == PAID) & F.col(order_id).isNotNull()


def _update_conversion(
    spark: SparkSession, root: str, batch_id: int, order_changes: DataFrame, payment_changes: DataFrame
) -> None:
    """Store how often the batch's orders are paid now, and the minutes whose counts that has changed.

    The batch's order ids are looked up in two indexes: how often they were paid, and, for those that only payments name, when
    the order was made. Both as of the batch before, so that a replay gives the same. The ids of a batch of more than
    ``keyed.MANY_ROWS`` changes are not looked up one by one, but joined with the whole indexes.
    """
    paid_orders = paid_orders_table(root)
    paid_now = payment_changes.where(_paid("status", "order_id")).select("order_id", F.lit(1).alias("step"))
    paid_before = payment_changes.where(_paid("before.status", "before.order_id")).select(
        F.col("before.order_id").alias("order_id"), F.lit(-1).alias("step")
    )
    changed = order_changes.where("order_id is not null").select(
        "order_id", F.lit(True).alias("changed"), "event_ts", F.col("before").isNotNull().alias("existed"),
        F.col("before.event_ts").alias("old_ts"),
    )
    # A batch changes an order once, so each maximum is that of one value.
    touched = paid_now.unionByName(paid_before).unionByName(changed, allowMissingColumns=True).groupBy("order_id").agg(
        F.coalesce(F.sum("step"), F.lit(0)).alias("step"),
        *(F.max(c).alias(c) for c in ("changed", "event_ts", "existed", "old_ts")),
    ).where("step <> 0 or changed")
    few = order_changes.count() + payment_changes.count() <= keyed.MANY_ROWS
    frames = []
    try:
        if few:
            touched.persist().count()
            frames.append(touched)
        others = touched.where("changed is null").select("order_id")
        was_paid = keyed.lookup(spark, paid_orders, touched if few else None, batch_id - 1).withColumnRenamed("paid", "was")
        made = keyed.lookup(spark, curated_table(root, ORDERS), others if few else None, batch_id - 1).select(
            "order_id", F.lit(True).alias("found"), F.col("event_ts").alias("its_ts")
        )
        state = touched.join(was_paid, "order_id", "left").join(made, "order_id", "left")
        state = state.withColumn("found", F.col("found") & F.col("changed").isNull())
        state = state.withColumn("now", F.coalesce("was", F.lit(0)) + F.col("step")).persist()
        frames.append(state)
        paid = state.where("step <> 0").select(
            "order_id", F.col("now").alias("paid"), F.when(F.col("was").isNotNull(), F.struct(F.col("was").alias("paid"))).alias("before")
        )
        batchlog.write_batch(paid, paid_orders.path, batch_id)
        new = state.where("changed or found").select(
            F.when(F.col("changed"), F.col("event_ts")).otherwise(F.col("its_ts")).alias("ts"),
            F.lit(1).alias("orders"), (F.col("now") > 0).cast("int").alias("paid"), F.lit(0).alias("keyless"),
        )
        old = state.where("existed or found").select(
            F.when(F.col("changed"), F.col("old_ts")).otherwise(F.col("its_ts")).alias("ts"),
            F.lit(-1).alias("orders"), (-(F.coalesce("was", F.lit(0)) > 0).cast("int")).alias("paid"), F.lit(0).alias("keyless"),
        )
        keyless = order_changes.where("order_id is null").select(
            F.col("event_ts").alias("ts"), F.lit(0).alias("orders"), F.lit(0).alias("paid"), F.lit(1).alias("keyless")
        )
        _store_conversion(spark, root, batch_id, new.unionByName(old).unionByName(keyless))
    finally:
        for frame in frames:
            frame.unpersist()


def _store_conversion(spark: SparkSession, root: str, batch_id: int, steps: DataFrame) -> None:
    """Add ``steps`` (ts, orders, paid, keyless) to the stored counts of their minutes."""
    sums = steps.groupBy(bucket_start(F.col("ts")).alias("minute")).agg(*(F.sum(c).alias(c) for c in ("orders", "paid", "keyless")))
    sums = sums.where("orders <> 0 or paid <> 0 or keyless <> 0")
    stored = read_minutes(spark, root, "order_minutes", batch_id - 1, hidden=True).select(
        F.col("minute").alias("_minute"), F.col("total_orders").alias("_orders"), F.col("paid_orders").alias("_paid"),
        F.col("keyless").alias("_keyless"),
    )
    found = sums.join(stored, F.col("minute").eqNullSafe(F.col("_minute")), "left")
    now = {c: (F.coalesce(f"_{c}", F.lit(0)) + F.col(c)).cast("bigint") for c in ("orders", "paid", "keyless")}
    rows = found.select(
        "minute", now["orders"].alias("total_orders"), now["paid"].alias("paid_orders"), now["keyless"].alias("keyless")
    )
    rate = safe_pct(F.col("paid_orders"), F.col("total_orders"), RATE_DIGITS).alias("conversion_rate_pct")
    present = ((F.col("total_orders") > 0) | (F.col("keyless") > 0)).alias("present")
    rows = rows.select("minute", "total_orders", "paid_orders", rate, "keyless", present)
    batchlog.write_batch(rows, layer_path(root, "analytics", "order_minutes"), batch_id)


def read_metric(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """The stored metric as of the last promoted batch."""
    stored, names = METRICS[metric]
    return read_minutes(spark, root, stored).select("minute", *names)


def served_minutes(spark: SparkSession, root: str, stored: str) -> DataFrame | None:
    """The per-minute values as of the last committed batch, from the stored ones.

    Where batches were promoted without metrics, the minutes that those have touched are computed from the CURATED tables, and
    only those. ``None`` if nothing is stored, or if the tables have merged such batches, so that what they touched is lost.
    """
    committed = committed_batch(spark, root)
    kept = min(committed, batchlog.last_complete_batch(spark, layer_path(root, "analytics", stored)))
    if kept < 0:
        return None
    if kept == committed:
        return read_minutes(spark, root, stored, committed)
    if any(batchlog.manifest_of(spark, curated_path(root, t)).merged > kept for t in (ORDERS, PAYMENTS)):
        return None
    orders, payments = (read_curated(spark, root, t, committed) for t in (ORDERS, PAYMENTS))
    paid_for = batchlog.read_batches(spark, curated_path(root, PAYMENTS), change_schema(PAYMENTS), kept, committed)
    if stored == "payment_minutes":
        touched = _touched_minutes(paid_for)
        fresh = payment_minutes(_in_minutes(payments, touched))
    else:
        made = batchlog.read_batches(spark, curated_path(root, ORDERS), change_schema(ORDERS), kept, committed)
        ids = paid_for.select("order_id").unionByName(paid_for.select("before.order_id")).where("order_id is not null").distinct()
        named = keyed.lookup(spark, curated_table(root, ORDERS), ids, committed)
        touched = _touched_minutes(made).unionByName(named.select(bucket_start(F.col("event_ts")).alias("minute"))).distinct()
        fresh = order_conversion(_in_minutes(orders, touched).select("event_ts", "order_id"), payments, few_orders=True)
    names = MINUTES[stored].names
    settled = read_minutes(spark, root, stored, kept).alias("s").join(
        touched.alias("t"), F.col("s.minute").eqNullSafe(F.col("t.minute")), "left_anti"
    )
    return settled.select(*names).unionByName(fresh.select(*names))
