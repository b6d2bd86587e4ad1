"""From topic records to RAW rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

_OBJECT_START = r"^[ \t\n\r]*\{"

# Flush thresholds of the ingest buffer.
BUFFER_RECORDS = 5000
BUFFER_SECONDS = 30


def _reject_reason() -> Column:
    """Why a record cannot be landed; NULL for a JSON object."""
    value = F.col("value")
    return (
        F.when(value.isNull(), F.lit("empty"))
        .when(F.col("content").isNull(), F.lit("malformed"))
        .when(~value.rlike(_OBJECT_START), F.lit("not_object"))
    )


def judge(records: DataFrame) -> DataFrame:
    """Records with their parsed ``content`` and the ``reason`` why they can't be landed, NULL where they can.

    The parsed value passes through an ``explode`` of one element. Catalyst does not
    move filters and projections across that, so each value is parsed once and not
    once for the check and again for the landing.
    """
    parsed = records.withColumn("content", F.explode(F.array(F.try_parse_json("value"))))
    return parsed.withColumn("reason", _reject_reason())


def split_malformed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records into landable ones, with their parsed ``content``, and a quarantine.

    Bad records never stop the pipeline: they are set aside whole, so the two
    frames together hold every input record. As with most JSON readers, text after a
    complete value does not make a record bad; it is ignored.
    """
    judged = judge(records)
    bad = judged.where(F.col("reason").isNotNull())
    return judged.where(F.col("reason").isNull()).drop("reason"), bad.select("topic", "partition", "offset", "value", "reason")


def load_clock() -> Column:
    """The current time (UTC). In a stream that is the time of the micro-batch, which a replayed batch keeps."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def land_raw(records: DataFrame, load_time: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as RAW rows: metadata and content as VARIANT, plus the load time, and the columns to ``keep`` as they are.

    Uses the ``content`` that ``judge`` has parsed, or parses the value.
    Without ``load_time`` (or where it is NULL) rows get the current time.
    """
    content = F.col("content") if "content" in records.columns else F.try_parse_json("value")
    return records.select(
        F.to_variant_object(
            F.struct("topic", "partition", "offset", "key", F.col("timestamp").alias("create_time"))
        ).alias("record_metadata"),
        content.alias("record_content"),
        (load_clock() if load_time is None else F.coalesce(load_time, load_clock())).alias("load_time"),
        *keep,
    )


def route(records: DataFrame, topic_to_table: Mapping[str, str]) -> dict[str, DataFrame]:
    """The records of each target table; several topics may feed one table."""
    topics: dict[str, list[str]] = {}
    for topic, table in topic_to_table.items():
        topics.setdefault(table, []).append(topic)
    return {table: records.where(F.col("topic").isin(names)) for table, names in topics.items()}


def ingest_options(
    source: str,
    records: int = BUFFER_RECORDS,
    seconds: int = BUFFER_SECONDS,
    size: int | None = None,
) -> tuple[dict[str, str], dict[str, str]]:
    """Reader options and trigger that flush at whichever comes first of records and time.

    These are thresholds, not ceilings: a batch takes all that has arrived. From Kafka one
    starts as soon as ``records`` wait, or after ``seconds``, and the next as soon as it is
    done. File sources know no such threshold; they start a batch every ``seconds`` with all
    new files. ``size`` bounds the bytes of a file batch, for a backlog that is read in parts.
    """
    if source == "kafka":
        return {"minOffsetsPerTrigger": str(records), "maxTriggerDelay": f"{seconds}s"}, {"processingTime": "0 seconds"}
    reader = {} if size is None else {"maxBytesPerTrigger": str(size)}
    return reader, {"processingTime": f"{seconds} seconds"}
