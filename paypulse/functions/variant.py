"""Access to semi-structured payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def variant_field(payload: Column, field: str, type_name: str) -> Column:
    """One field of a VARIANT object; NULL if it is missing, null or not castable."""
    return F.try_variant_get(payload, f"$.{field}", type_name)


def json_field(text: Column, field: str, type_name: str) -> Column:
    """One field of a JSON text; NULL also where the text is not JSON."""
    return variant_field(F.try_parse_json(text), field, type_name)


def log_position(metadata: Column) -> list[Column]:
    """topic, partition, offset from the metadata of a landed record."""
    return [
        variant_field(metadata, "topic", "string").alias("topic"),
        variant_field(metadata, "partition", "int").alias("partition"),
        variant_field(metadata, "offset", "bigint").alias("offset"),
    ]


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a UTC offset, as event producers write it."""
    return F.concat(F.translate(ts.cast("string"), " ", "T"), F.lit("+00:00"))
