"""The event tables of this domain, derived from star-schema and click-stream tables.

Three shapes: minute-grain payments and a topic log from ``events``; orders with
several payments each, and with repeated payment keys, from ``orders`` and
``lineitem``. Everything is a projection or a filter, so the inputs scale with the
given tables and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paypulse.functions.variant import iso_utc
from paypulse.schemas import FAILED, ORDERS, PAID, PAYMENTS

LOG_PARTITIONS = 3
#: Above every supplier key up to scale factor 100,000.
SEQ_BASE = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, table: str, streaming: bool = False) -> DataFrame:
    """A given table, whole; as a stream, its files in turn."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    if not streaming:
        return spark.read.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def event_payments(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """CURATED payments: purchases are paid, errors are failed."""
    return (
        read(spark, sf_dir, "events", streaming)
        .where(F.col("event_type").isin("purchase", "error"))
        .select(
            F.concat(F.lit("P"), _text("event_id")).alias("payment_id"),
            F.concat(F.lit("O"), _text("user_id")).alias("order_id"),
            F.when(F.col("event_type") == "purchase", PAID).otherwise(FAILED).alias("status"),
            F.col("value").alias("amount"),
            F.col("ts").alias("event_ts"),
            F.col("ts").alias("load_time"),
        )
    )


def star_orders(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """CURATED orders from ``orders``."""
    return read(spark, sf_dir, "orders", streaming).select(
        _text("o_orderkey").alias("order_id"),
        F.concat(F.lit("C"), _text("o_custkey")).alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("o_orderdate").alias("event_ts"),
        F.col("o_orderdate").alias("load_time"),
    )


def star_payments(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Payments from ``lineitem`` with ``seq``; payment_id repeats."""
    return read(spark, sf_dir, "lineitem", streaming).select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("payment_id"),
        _text("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", FAILED).otherwise(PAID).alias("status"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("event_ts"),
        F.col("l_shipdate").alias("load_time"),
        (F.col("l_partkey") * SEQ_BASE + F.col("l_suppkey")).alias("seq"),
    )


def _envelope(rows: DataFrame, key: Column, value: Column, topic: Column, partition: Column,
              offset: Column, timestamp: Column) -> DataFrame:
    return rows.select(
        key.alias("key"), value.alias("value"), topic.alias("topic"),
        partition.cast("int").alias("partition"), offset.cast("bigint").alias("offset"),
        timestamp.alias("timestamp"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic log with one record per event.

    Purchases and errors go to ``payments``, all other kinds to ``orders``. The
    partition is the remainder of the event id and the offset its quotient: event
    ids are dense and in time order, so no global numbering is needed.
    """
    events = read(spark, sf_dir, "events")
    payload = F.to_json(
        F.struct(
            _text("event_id").alias("event_id"), "user_id", "event_type",
            F.col("value").alias("amount"), iso_utc(F.col("ts")).alias("event_ts"),
        )
    )
    is_payment = F.col("event_type").isin("purchase", "error")
    return _envelope(
        events,
        key=_text("event_id"),
        value=payload,
        topic=F.when(is_payment, PAYMENTS.topic).otherwise(ORDERS.topic),
        partition=F.col("event_id") % LOG_PARTITIONS,
        offset=F.expr(f"event_id div {LOG_PARTITIONS}"),
        timestamp=F.col("ts"),
    )


def faulty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of ``event_log`` with every kind of bad value.

    Views lose their closing brace, clicks carry a bare number, signups nothing.
    """
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), "event_type", "value")
    bad = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"event_id": '), _text("_id")))
        .when(F.col("event_type") == "click", _text("_id"))
        .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit('{"event_id": '), _text("_id"), F.lit("}")))
    )
    return _envelope(
        events,
        key=_text("_id"),
        value=bad,
        topic=F.lit("events"),
        partition=F.col("_id") % LOG_PARTITIONS,
        offset=F.expr(f"_id div {LOG_PARTITIONS}"),
        timestamp=F.lit(None).cast("timestamp_ntz"),
    )


def order_records(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Topic records of ``star_orders``."""
    orders = star_orders(spark, sf_dir, streaming)
    payload = F.to_json(
        F.struct(
            F.lit("order_created").alias("event_type"), iso_utc(F.col("event_ts")).alias("event_ts"),
            "order_id", "customer_id", "amount", "currency",
        )
    )
    number = F.col("order_id").cast("bigint")
    return _envelope(
        orders, key=F.col("order_id"), value=payload, topic=F.lit(ORDERS.topic),
        partition=number % LOG_PARTITIONS, offset=number, timestamp=F.col("load_time"),
    )


def payment_records(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Topic records of ``star_payments``; the sequence number serves as offset."""
    payments = star_payments(spark, sf_dir, streaming)
    payload = F.to_json(
        F.struct(
            F.lit("payment").alias("event_type"), iso_utc(F.col("event_ts")).alias("event_ts"),
            "payment_id", "order_id", "status", "amount",
        )
    )
    return _envelope(
        payments, key=F.col("payment_id"), value=payload, topic=F.lit(PAYMENTS.topic),
        partition=F.col("order_id").cast("bigint") % LOG_PARTITIONS, offset=F.col("seq"),
        timestamp=F.col("load_time"),
    )
