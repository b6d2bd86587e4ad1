"""Fixed schemas of the event log, the RAW layer and the CURATED layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _D, _L, _N, _V = (
    T.StringType(), T.DoubleType(), T.LongType(), T.TimestampNTZType(), T.VariantType(),
)

# One record of a keyed JSON topic, in the shape of Spark's Kafka source.
ENVELOPE = T.StructType([
    T.StructField("key", _S),
    T.StructField("value", _S),
    T.StructField("topic", _S),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", _L),
    T.StructField("timestamp", _N),
])

RAW = T.StructType([
    T.StructField("record_metadata", _V),
    T.StructField("record_content", _V),
    T.StructField("load_time", _N),
])

QUARANTINE = T.StructType([
    T.StructField("topic", _S),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", _L),
    T.StructField("value", _S),
    T.StructField("reason", _S),
])

COMMITTED = T.StructType([
    T.StructField("group", _S),
    T.StructField("topic", _S),
    T.StructField("partition", T.IntegerType()),
    T.StructField("committed", _L),
])

# What the ingest has taken of a topic partition.
INGESTED = T.StructType([
    T.StructField("topic", _S),
    T.StructField("partition", T.IntegerType()),
    T.StructField("end_offset", _L),
    T.StructField("landed", _L),
    T.StructField("rejected", _L),
])

# Rows of a CURATED table after a batch.
TOTALS = T.StructType([T.StructField("table", _S), T.StructField("total", _L)])

# How many current payments have paid for an order.
PAID_ORDERS = T.StructType([T.StructField("order_id", _S), T.StructField("paid", _L)])


@dataclass(frozen=True)
class EventTable:
    """One event kind: its topic, its RAW table and its typed, keyed CURATED table."""

    name: str
    topic: str
    raw_table: str
    key: str
    fields: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> T.StructType:
        """CURATED columns: the event's fields, then the load time."""
        out = T.StructType()
        for column, type_name in self.fields:
            out = out.add(column, T.DataType.fromDDL(type_name))
        return out.add("load_time", _N)


# Table, topic and field names and types of the two event kinds.
ORDERS = EventTable(
    name="orders",
    topic="orders",
    raw_table="orders_events",
    key="order_id",
    fields=(
        ("order_id", "string"),
        ("customer_id", "string"),
        ("amount", "double"),
        ("currency", "string"),
        ("event_ts", "timestamp_ntz"),
    ),
)
PAYMENTS = EventTable(
    name="payments",
    topic="payments",
    raw_table="payments_events",
    key="payment_id",
    fields=(
        ("payment_id", "string"),
        ("order_id", "string"),
        ("status", "string"),
        ("amount", "double"),
        ("event_ts", "timestamp_ntz"),
    ),
)
TABLES = {t.name: t for t in (ORDERS, PAYMENTS)}

# Payment states.
PAID = "PAID"
FAILED = "FAILED"

# What one recomputation of a minute stores: by payment time, and by order time.
MINUTES = {
    "payment_minutes": T.StructType([
        T.StructField("minute", _N),
        T.StructField("revenue", _D),
        T.StructField("total_payments", _L),
        T.StructField("failed_payments", _L),
        T.StructField("failure_rate_pct", _D),
    ]),
    "order_minutes": T.StructType([
        T.StructField("minute", _N),
        T.StructField("total_orders", _L),
        T.StructField("paid_orders", _L),
        T.StructField("conversion_rate_pct", _D),
    ]),
}
