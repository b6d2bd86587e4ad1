"""The monitoring queries over the stored layers, one method per question."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paypulse.functions.time import as_utc, minutes_before
from paypulse.operators import health, metrics
from paypulse.plans.read_only_sql import DEFAULT_LIMIT, read_only_sql
from paypulse.plans.views import register_views
from paypulse.schemas import ORDERS, PAYMENTS, EventTable
from paypulse.sources import batchlog
from paypulse.sources.layers import (
    ingested_path, read_curated, read_ingested, read_source_ends, read_totals, scan, scan_raw_since, totals_path,
)
from paypulse.streaming.incremental import METRICS, served_minutes
from paypulse.streaming.promote import PROMOTE_GROUP

#: The group under which the ingest's own progress counts.
INGEST_GROUP = "ingest"
METRIC_COLUMNS = {name: ("minute", *columns) for name, (_, columns) in METRICS.items()}


class PaymentMonitor:
    """Queries on the layers below ``root``; every method returns a DataFrame.

    Metrics come from the stored minutes, and health from what ingest and promotion have noted; the tables themselves are
    read only where layers lack those. ``as_of`` fixes the time the windows end at; by default they end now.
    """

    def __init__(self, spark: SparkSession, root: str, as_of: datetime | str | None = None):
        self.spark, self.root, self.as_of = spark, root, as_of

    @property
    def orders(self) -> DataFrame:
        return read_curated(self.spark, self.root, ORDERS)

    @property
    def payments(self) -> DataFrame:
        return read_curated(self.spark, self.root, PAYMENTS)

    @property
    def raw_orders(self) -> DataFrame:
        return scan(self.spark, self.root, "raw", ORDERS.raw_table)

    @property
    def raw_payments(self) -> DataFrame:
        return scan(self.spark, self.root, "raw", PAYMENTS.raw_table)

    @property
    def log(self) -> DataFrame:
        """topic, partition, offset: the last record taken from each topic partition, landed or rejected, as the ingest has
        noted it, and the last one of the topic itself where the source tells. Only layers that something else has
        filled are scanned for every record."""
        if not self._noted(ingested_path(self.root)):
            landed = health.raw_log(self.raw_orders.unionByName(self.raw_payments))
            rejected = scan(self.spark, self.root, "raw", "quarantine")
            return landed.unionByName(rejected.select(*landed.columns))
        taken = read_ingested(self.spark, self.root).select("topic", "partition", "end_offset")
        ends = self.spark.createDataFrame(read_source_ends(self.spark, self.root), taken.schema)
        return taken.unionByName(ends).select("topic", "partition", (F.col("end_offset") - 1).alias("offset"))

    def _noted(self, path: str) -> bool:
        return batchlog.last_complete_batch(self.spark, path) >= 0

    @property
    def committed(self) -> DataFrame:
        """The commits of the promotion, and those of the ingest: how far it has landed or rejected the topics."""
        commits = scan(self.spark, self.root, "curated", "committed_offsets")
        taken = read_ingested(self.spark, self.root)
        return commits.unionByName(taken.select(
            F.lit(INGEST_GROUP).alias("group"), "topic", "partition", F.col("end_offset").alias("committed")
        ))

    def run_sql(self, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        register_views(
            orders=self.orders, payments=self.payments,
            raw_orders=self.raw_orders, raw_payments=self.raw_payments,
        )
        return read_only_sql(self.spark, query, limit)

    def _minutes(self, stored: str) -> DataFrame | None:
        return served_minutes(self.spark, self.root, stored)

    def revenue_last_minutes(
        self, minutes: int = metrics.REVENUE_MINUTES, cap: int | None = None
    ) -> DataFrame:
        stored = self._minutes("payment_minutes")
        if stored is None:
            return metrics.revenue_last_minutes(self.payments, self.as_of, minutes, cap)
        return metrics.last_minutes(stored.select(*METRIC_COLUMNS["revenue_per_minute"]), self.as_of, minutes, cap)

    def revenue_anomaly(
        self,
        lookback_minutes: int = metrics.LOOKBACK_MINUTES,
        baseline_minutes: int = metrics.BASELINE_MINUTES,
    ) -> DataFrame:
        stored = self._minutes("payment_minutes")
        if stored is None:
            return metrics.revenue_anomaly(self.payments, self.as_of, lookback_minutes, baseline_minutes)
        return metrics.anomaly_of(stored, self.as_of, lookback_minutes, baseline_minutes)

    def payment_failure_rate(
        self, minutes: int = metrics.RATE_MINUTES, cap: int | None = None
    ) -> DataFrame:
        stored = self._minutes("payment_minutes")
        if stored is None:
            return metrics.payment_failure_rate_last(self.payments, self.as_of, minutes, cap)
        return metrics.last_minutes(stored.select(*METRIC_COLUMNS["payment_failure_rate"]), self.as_of, minutes, cap)

    def order_conversion_rate(
        self, minutes: int = metrics.RATE_MINUTES, cap: int | None = None
    ) -> DataFrame:
        stored = self._minutes("order_minutes")
        if stored is None:
            return metrics.order_conversion_last(self.orders, self.payments, self.as_of, minutes, cap)
        return metrics.last_minutes(stored.select(*METRIC_COLUMNS["order_conversion"]), self.as_of, minutes, cap)

    def end_offsets(self, topic: str) -> DataFrame:
        return health.end_offsets(self.log, topic)

    def consumer_lag(self, topic: str, group: str = PROMOTE_GROUP) -> DataFrame:
        return health.consumer_lag(self.log, self.committed, topic, group)

    def total_lag(self, topic: str, group: str = PROMOTE_GROUP) -> DataFrame:
        return health.total_lag(self.log, self.committed, topic, group)

    def _raw_since(self, table: EventTable, minutes: int) -> DataFrame:
        day = minutes_before(as_utc(self.as_of), minutes).date()
        return scan_raw_since(self.spark, self.root, table.raw_table, day)

    def ingest_throughput(self, minutes: int = health.THROUGHPUT_MINUTES) -> DataFrame:
        raw = self._raw_since(ORDERS, minutes), self._raw_since(PAYMENTS, minutes)
        if self._noted(totals_path(self.root)):
            return health.kept_throughput(*raw, read_totals(self.spark, self.root), self.as_of, minutes)
        return health.ingest_throughput(*raw, self.orders, self.payments, self.as_of, minutes)

    def pipeline_summary(self, group: str = PROMOTE_GROUP) -> DataFrame:
        minutes = health.THROUGHPUT_MINUTES
        raw = self._raw_since(ORDERS, minutes), self._raw_since(PAYMENTS, minutes)
        if self._noted(totals_path(self.root)):
            totals = read_totals(self.spark, self.root)
            return health.kept_summary(self.log, self.committed, *raw, totals, self.as_of, group)
        return health.pipeline_summary(self.log, self.committed, *raw, self.orders, self.payments, self.as_of, group)
