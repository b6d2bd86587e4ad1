"""Keyed JSON topics as streaming or batch frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paypulse.schemas import ENVELOPE


def read_topics(
    spark: SparkSession,
    topics: Iterable[str],
    source: str,
    *,
    path: str | None = None,
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """Records of ``topics`` as key, value, topic, partition, offset, timestamp.

    ``source`` is ``kafka`` (give ``kafka.bootstrap.servers`` among the options; the
    connector package must be on the classpath) or a file format such as
    ``parquet`` or ``json`` holding envelopes below ``path``.
    """
    topics = list(topics)
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(source).options(**options)
    if source == "kafka":
        records = reader.option("subscribe", ",".join(topics)).load().select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            "topic",
            "partition",
            "offset",
            F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        )
    else:
        if path is None:
            raise ValueError(f"source {source!r} needs a path")
        records = reader.schema(ENVELOPE).load(path)
    return records.where(F.col("topic").isin(topics))
