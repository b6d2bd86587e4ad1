"""Pipeline health computed from the event log and the tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paypulse.functions.time import as_utc, minutes_before, ntz
from paypulse.functions.variant import log_position

# Span of the throughput counts, topics and consumer group of the summary.
THROUGHPUT_MINUTES = 5
SUMMARY_TOPICS = ("orders", "payments")
SUMMARY_GROUP = "connect-cluster"


def raw_log(raw: DataFrame) -> DataFrame:
    """topic, partition, offset of landed RAW rows, from their metadata."""
    return raw.select(*log_position(F.col("record_metadata")))


def end_offsets(log: DataFrame, topic: str | None = None) -> DataFrame:
    """topic, partition, end_offset: the offset the next record will get.

    An unknown topic gives no rows.
    """
    if topic is not None:
        log = log.where(F.col("topic") == topic)
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def group_commits(log: DataFrame, group: str) -> DataFrame:
    """group, topic, partition, committed: how far ``group`` has come, given what it consumed."""
    return end_offsets(log).select(
        F.lit(group).alias("group"), "topic", "partition", F.col("end_offset").alias("committed")
    )


def consumer_lag(log: DataFrame, committed: DataFrame, topic: str, group: str) -> DataFrame:
    """partition, end_offset, committed, lag of one topic and group.

    A partition without a commit counts from 0. ``committed`` may hold several
    commits per partition (it is appended to); the furthest one counts.
    """
    ends = end_offsets(log, topic)
    commits = (
        committed.where((F.col("group") == group) & (F.col("topic") == topic))
        .groupBy("partition")
        .agg(F.max("committed").alias("committed"))
    )
    done = F.coalesce("committed", F.lit(0).cast("bigint"))
    return ends.join(commits, "partition", "left").select(
        "partition", "end_offset", done.alias("committed"), (F.col("end_offset") - done).alias("lag")
    )


def total_lag(log: DataFrame, committed: DataFrame, topic: str, group: str) -> DataFrame:
    """topic, group, lag over all partitions; one row, 0 for an unknown topic."""
    per_partition = consumer_lag(log, committed, topic, group)
    return per_partition.agg(F.coalesce(F.sum("lag"), F.lit(0).cast("bigint")).alias("lag")).select(
        F.lit(topic).alias("topic"), F.lit(group).alias("group"), "lag"
    )


def new_records(log: DataFrame, committed: DataFrame, group: str) -> DataFrame:
    """The records of ``log`` that ``group`` has not consumed yet.

    There is one commit row per topic partition. Where they are small enough Catalyst
    broadcasts them and does not shuffle the log; otherwise it joins by shuffling, and
    adaptive execution splits a partition that is too large.
    """
    commits = (
        committed.where(F.col("group") == group)
        .groupBy("topic", "partition")
        .agg(F.max("committed").alias("_committed"))
    )
    return (
        log.join(commits, ["topic", "partition"], "left")
        .where(F.col("offset") >= F.coalesce("_committed", F.lit(0)))
        .select(*log.columns)
    )


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row frames with different columns side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _recent(raw_orders: DataFrame, raw_payments: DataFrame, as_of: datetime | str | None, minutes: int) -> list[DataFrame]:
    recent = F.col("load_time") >= ntz(minutes_before(as_utc(as_of), minutes))
    return [
        raw_orders.where(recent).agg(F.count("*").alias("orders_5min")),
        raw_payments.where(recent).agg(F.count("*").alias("payments_5min")),
    ]


def _totals(curated_orders: DataFrame, curated_payments: DataFrame) -> list[DataFrame]:
    return [
        curated_orders.agg(F.count("*").alias("curated_orders_total")),
        curated_payments.agg(F.count("*").alias("curated_payments_total")),
    ]


def _kept_totals(totals: DataFrame) -> list[DataFrame]:
    """The same of kept totals (table, total), without a count of the tables."""
    return [
        totals.agg(F.coalesce(F.max(F.when(F.col("table") == t, F.col("total"))), F.lit(0).cast("bigint")).alias(f"curated_{t}_total"))
        for t in ("orders", "payments")
    ]


def ingest_throughput(
    raw_orders: DataFrame,
    raw_payments: DataFrame,
    curated_orders: DataFrame,
    curated_payments: DataFrame,
    as_of: datetime | str | None = None,
    minutes: int = THROUGHPUT_MINUTES,
) -> DataFrame:
    """orders_5min, payments_5min (rows landed lately), curated_orders_total, curated_payments_total."""
    return _one_row(_recent(raw_orders, raw_payments, as_of, minutes) + _totals(curated_orders, curated_payments))


def kept_throughput(
    raw_orders: DataFrame, raw_payments: DataFrame, totals: DataFrame, as_of: datetime | str | None = None,
    minutes: int = THROUGHPUT_MINUTES,
) -> DataFrame:
    """``ingest_throughput`` with the totals that the promotion keeps."""
    return _one_row(_recent(raw_orders, raw_payments, as_of, minutes) + _kept_totals(totals))


def _lags(log: DataFrame, committed: DataFrame, group: str) -> list[DataFrame]:
    return [
        total_lag(log, committed, topic, group).select(F.col("lag").alias(f"{topic}_lag"))
        for topic in SUMMARY_TOPICS
    ]


def pipeline_summary(
    log: DataFrame,
    committed: DataFrame,
    raw_orders: DataFrame,
    raw_payments: DataFrame,
    curated_orders: DataFrame,
    curated_payments: DataFrame,
    as_of: datetime | str | None = None,
    group: str = SUMMARY_GROUP,
    minutes: int = THROUGHPUT_MINUTES,
) -> DataFrame:
    """orders_lag, payments_lag and the columns of ``ingest_throughput`` in one row."""
    recent = _recent(raw_orders, raw_payments, as_of, minutes)
    return _one_row(_lags(log, committed, group) + recent + _totals(curated_orders, curated_payments))


def kept_summary(
    log: DataFrame, committed: DataFrame, raw_orders: DataFrame, raw_payments: DataFrame, totals: DataFrame,
    as_of: datetime | str | None = None, group: str = SUMMARY_GROUP, minutes: int = THROUGHPUT_MINUTES,
) -> DataFrame:
    """``pipeline_summary`` with the totals that the promotion keeps."""
    return _one_row(_lags(log, committed, group) + _recent(raw_orders, raw_payments, as_of, minutes) + _kept_totals(totals))
