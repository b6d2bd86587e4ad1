"""From RAW rows to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paypulse.functions.variant import log_position, variant_field
from paypulse.schemas import ORDERS, PAYMENTS, EventTable


def unpack(
    raw: DataFrame, table: EventTable, *, with_payload: bool = True, with_position: bool = False
) -> DataFrame:
    """Typed columns of ``table`` from RAW rows; bad or missing fields become NULL.

    ``with_payload`` keeps the whole VARIANT; ``with_position`` adds topic, partition
    and offset, of which the offset orders the records of one key.
    """
    columns = [F.col("load_time")]
    columns += [variant_field(F.col("record_content"), f, t).alias(f) for f, t in table.fields]
    if with_payload:
        columns.append(F.col("record_content").alias("payload"))
    if with_position:
        columns += log_position(F.col("record_metadata"))
    return raw.select(*columns)


def unpack_orders(raw: DataFrame, **options: bool) -> DataFrame:
    """load_time, order_id, customer_id, amount, currency, event_ts, payload."""
    return unpack(raw, ORDERS, **options)


def unpack_payments(raw: DataFrame, **options: bool) -> DataFrame:
    """load_time, payment_id, order_id, status, amount, event_ts, payload."""
    return unpack(raw, PAYMENTS, **options)
