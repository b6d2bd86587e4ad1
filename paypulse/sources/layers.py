"""The RAW, CURATED and ANALYTICS layers below one root.

RAW tables are append-only Parquet folders by load date. CURATED tables are keyed tables (``sources.keyed``): logs of
batches that hold the rows which won their key, merged in tiers. ANALYTICS holds the stored minutes, and how often each order
is paid. The small logs beside them say what has happened: ``ingest_offsets`` what the ingest took from the topics,
``committed_offsets`` what the promotion took from RAW, ``totals`` how many rows the CURATED tables have.

A batch writes orders, payments, metrics and last its commits. Readers and compaction stop
at the last batch that has committed, so they never see a part of one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from functools import partial
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paypulse.schemas import COMMITTED, INGESTED, MINUTES, PAID_ORDERS, QUARANTINE, RAW, TABLES, TOTALS, EventTable
from paypulse.session import together
from paypulse.sources import batchlog, files, keyed
from paypulse.sources.keyed import KeyedTable

#: Columns that a promotion compares and metrics need of a replaced row; a table's index keeps them.
NARROW = ("order_id", "status", "event_ts", "load_time", "seq")


def layer_path(root: str, layer: str, table: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{table}"


def curated_path(root: str, table: EventTable) -> str:
    return layer_path(root, "curated", table.name)


def offsets_path(root: str) -> str:
    return layer_path(root, "curated", "committed_offsets")


def ingested_path(root: str) -> str:
    return layer_path(root, "raw", "ingest_offsets")


def source_ends_path(root: str) -> str:
    return layer_path(root, "raw", "source_ends")


def totals_path(root: str) -> str:
    return layer_path(root, "curated", "totals")


def curated_table(root: str, table: EventTable) -> KeyedTable:
    """Its files are sorted by event time; key and load time split an event time that very many rows share."""
    schema = stored_schema(table)
    narrow = tuple(c for c in schema.names if c in NARROW)
    return KeyedTable(curated_path(root, table), table.key, schema, narrow, ("event_ts", table.key, "load_time"))


def paid_orders_table(root: str) -> KeyedTable:
    """order_id, paid: how many current payments have paid for it."""
    return KeyedTable(layer_path(root, "analytics", "paid_orders"), "order_id", PAID_ORDERS, ("order_id", "paid"), ("order_id",))


def keyed_tables(root: str) -> list[KeyedTable]:
    return [*(curated_table(root, t) for t in TABLES.values()), paid_orders_table(root)]


def change_schema(table: EventTable) -> T.StructType:
    """A change: the new row, its sequence number, and what is needed of the row it replaced."""
    return curated_table("", table).change_schema


def stored_schema(table: EventTable) -> T.StructType:
    """A row of a snapshot: the typed columns and the offset that decides between equal load times."""
    return T.StructType(list(table.schema.fields)).add("seq", T.LongType())


def minute_values(stored: str) -> T.StructType:
    """The values of a minute, and for orders how many without an order_id lie in it."""
    values = T.StructType(list(MINUTES[stored].fields))
    return values.add("keyless", T.LongType()) if stored == "order_minutes" else values


def minutes_schema(stored: str) -> T.StructType:
    """The values of a minute; ``present`` is false for a minute that has lost all its rows."""
    return minute_values(stored).add("present", T.BooleanType())


def _raw_schemas() -> dict[str, T.StructType]:
    return {**{t.raw_table: RAW for t in TABLES.values()}, "quarantine": QUARANTINE}


def register_layers(spark: SparkSession, root: str, *, catalog: bool = False) -> None:
    """Create the layers' tables where they are missing; existing data stays as it is.

    With ``catalog`` the databases and the RAW tables are declared in the session
    catalog as well, so SQL can name them.
    """
    for name, schema in _raw_schemas().items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(layer_path(root, "raw", name))
    for table in keyed_tables(root):
        keyed.create(spark, table)
    for path, schema in ((offsets_path(root), COMMITTED), (ingested_path(root), INGESTED), (totals_path(root), TOTALS)):
        batchlog.create(spark, path, schema)
    for stored in MINUTES:
        batchlog.create(spark, layer_path(root, "analytics", stored), minutes_schema(stored))
    if catalog:
        for layer in ("raw", "curated", "analytics"):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer} LOCATION '{layer_path(root, layer, '_db')}'")
        for name, schema in _raw_schemas().items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS raw.{name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') "
                f"LOCATION '{layer_path(root, 'raw', name)}'"
            )


def scan(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    """Full scan of a stored table with its declared schema; nothing is inferred."""
    if layer == "raw":
        schema = _raw_schemas()[table]
        reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(layer_path(root, layer, table)).select(*schema.names)
    if (layer, table) == ("curated", "committed_offsets"):
        return read_offsets(spark, root)
    if layer == "curated":
        return read_curated(spark, root, TABLES[table])
    raise ValueError(f"unknown layer {layer!r}")


def scan_raw_since(spark: SparkSession, root: str, table: str, day: date) -> DataFrame:
    """The files of a RAW table that may hold rows loaded on ``day`` or later; folders of earlier days aren't opened."""
    path, days = layer_path(root, "raw", table), "load_date="
    found = [e for e in files.entries(spark, path) if e.name.startswith(days)]
    if not found:
        return scan(spark, root, "raw", table)
    recent = [e.path for e in found if e.name.removeprefix(days) >= day.isoformat()]
    return spark.read.schema(RAW).parquet(*recent) if recent else spark.createDataFrame([], RAW)


def new_rows(spark: SparkSession, root: str, table: EventTable, **options: str) -> DataFrame:
    """The append-only change feed of a RAW table: each row once per checkpoint."""
    path = layer_path(root, "raw", table.raw_table)
    return spark.readStream.schema(RAW).options(recursiveFileLookup="true", **options).parquet(path).select(*RAW.names)


def new_files(spark: SparkSession, root: str, table: EventTable, **options: str) -> DataFrame:
    """The change feed of a RAW table as the files (``file``) that its rows lie in, one for each row; no column is read."""
    return new_rows(spark, root, table, **options).select(F.col("_metadata.file_path").alias("file"))


def read_raw_files(spark: SparkSession, files_of: list[str]) -> DataFrame:
    """The RAW rows of the files that ``new_files`` has named; RAW files don't change once they are there."""
    paths = [unquote(f) for f in files_of]
    if not paths:
        return spark.createDataFrame([], RAW)
    return spark.read.schema(RAW).option("recursiveFileLookup", "true").parquet(*paths).select(*RAW.names)


def committed_batch(spark: SparkSession, root: str) -> int:
    """The last batch whose commits, which are written last, are there; -1 without any."""
    return batchlog.last_complete_batch(spark, offsets_path(root))


def read_curated(
    spark: SparkSession, root: str, table: EventTable, upto_batch: int | None = None
) -> DataFrame:
    """The typed table with one row per key, as of ``upto_batch`` or of the last committed batch."""
    upto = committed_batch(spark, root) if upto_batch is None else upto_batch
    return keyed.read(spark, curated_table(root, table), upto).select(*table.schema.names)


def compact_curated(spark: SparkSession, root: str, table: EventTable) -> int | None:
    """Fold all committed changes into a new snapshot; returns its last batch, ``None`` if nothing is new."""
    return _compact_keyed(spark, curated_table(root, table), committed_batch(spark, root))


def _compact_keyed(spark: SparkSession, table: KeyedTable, committed: int) -> int | None:
    last = batchlog.last_batch(spark, table.path, table.change_schema, committed)
    if last is not None:
        keyed.compact(spark, table, last)
    return last


# --- small logs ----------------------------------------------------------------

def _read_log(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The rows of a log with their ``batch_id``; those of the snapshot have its last one."""
    manifest = batchlog.manifest_of(spark, path)
    rows = batchlog.read_batches(spark, path, schema, manifest.upto, upto)
    if manifest.snapshot is None:
        return rows
    folded = spark.read.schema(schema).parquet(f"{path}/{manifest.snapshot.folder}")
    return folded.withColumn("batch_id", F.lit(manifest.upto).cast("bigint")).unionByName(rows)


def _fold(spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]) -> int | None:
    """``fold`` the rows of the finished batches into a snapshot; returns the last of them, ``None`` if nothing is new."""
    last = batchlog.last_complete_batch(spark, path)
    if last <= batchlog.manifest_of(spark, path).upto:
        return None
    batchlog.publish_snapshot(spark, fold(_read_log(spark, path, schema, last)).select(*schema.names), path, last)
    return last


def _furthest(commits: DataFrame) -> DataFrame:
    return commits.groupBy("group", "topic", "partition").agg(F.max("committed").alias("committed"))


def read_offsets(spark: SparkSession, root: str) -> DataFrame:
    """group, topic, partition, committed: every commit; the furthest one counts."""
    return _read_log(spark, offsets_path(root), COMMITTED).drop("batch_id")


def compact_offsets(spark: SparkSession, root: str) -> int | None:
    """Keep one commit per group and topic partition."""
    return _fold(spark, offsets_path(root), COMMITTED, _furthest)


def _ingested(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", "partition").agg(
        F.max("end_offset").alias("end_offset"), F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected")
    )


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    """topic, partition, end_offset, landed, rejected: how far the ingest has come, and how many records it landed and rejected."""
    return _ingested(_read_log(spark, ingested_path(root), INGESTED))


def read_source_ends(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """(topic, partition, end offset) as the source last reported them to the ingest; empty if it doesn't report any."""
    reports = files.entries(spark, source_ends_path(root))
    return [tuple(r) for r in json.loads(files.read_text(spark, reports[-1].path))] if reports else []


def compact_ingested(spark: SparkSession, root: str) -> int | None:
    return _fold(spark, ingested_path(root), INGESTED, _ingested)


def _newest_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table").agg(F.max_by("total", "batch_id").alias("total"))


def read_totals(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """table, total: the rows of each CURATED table as of the last committed batch, or of ``upto``."""
    upto = committed_batch(spark, root) if upto is None else upto
    return _newest_totals(_read_log(spark, totals_path(root), TOTALS, upto))


def compact_totals(spark: SparkSession, root: str) -> int | None:
    return _fold(spark, totals_path(root), TOTALS, _newest_totals)


def read_minutes(spark: SparkSession, root: str, stored: str, upto: int | None = None, hidden: bool = False) -> DataFrame:
    """Stored per-minute values: for each minute those of the last committed batch that wrote it, or of ``upto``.

    ``hidden`` adds the columns that only updates need.
    """
    path, names = layer_path(root, "analytics", stored), minute_values(stored).names
    manifest = batchlog.manifest_of(spark, path)
    upto = committed_batch(spark, root) if upto is None else upto
    log = batchlog.read_batches(spark, path, minutes_schema(stored), manifest.upto, upto)
    if manifest.snapshot is not None:
        folded = spark.read.schema(minute_values(stored)).parquet(f"{path}/{manifest.snapshot.folder}").select(
            "*", F.lit(True).alias("present"), F.lit(manifest.upto).cast("bigint").alias("batch_id")
        )
        log = log.unionByName(folded)
    latest = log.groupBy("minute").agg(
        F.max_by(F.struct("present", *names[1:]), "batch_id").alias("value")
    )
    shown = names[1:] if hidden else MINUTES[stored].names[1:]
    return latest.where("value.present").select("minute", *[f"value.{n}" for n in shown])


def compact_minutes(spark: SparkSession, root: str, stored: str) -> int | None:
    """Fold the batches of a stored metric into a new snapshot."""
    path = layer_path(root, "analytics", stored)
    last = batchlog.last_batch(spark, path, minutes_schema(stored), committed_batch(spark, root))
    if last is not None:
        batchlog.publish_snapshot(spark, read_minutes(spark, root, stored, last, hidden=True), path, last)
    return last


# --- upkeep --------------------------------------------------------------------

def log_paths(root: str) -> list[str]:
    """Every table that is a log of batches."""
    stored = [layer_path(root, "analytics", s) for s in MINUTES]
    return [*(t.path for t in keyed_tables(root)), *stored, offsets_path(root), totals_path(root), ingested_path(root)]


def _compact_small(spark: SparkSession, root: str) -> None:
    for stored in MINUTES:
        compact_minutes(spark, root, stored)
    compact_offsets(spark, root)
    compact_totals(spark, root)


def compact_all(spark: SparkSession, root: str, *, remove: bool = False) -> None:
    """Compact every table; with ``remove`` also delete what the snapshots have replaced, so no earlier reader may be running.

    Run it between promotion batches: everything is folded up to the last committed batch.
    """
    committed = committed_batch(spark, root)
    together(
        spark, *(partial(_compact_keyed, spark, table, committed) for table in keyed_tables(root)),
        partial(_compact_small, spark, root), partial(compact_ingested, spark, root),
    )
    if remove:
        for path in log_paths(root):
            batchlog.remove_folded(spark, path)


def maintain(spark: SparkSession, root: str, *, small: bool, retain: int = batchlog.RETAIN_SECONDS) -> None:
    """Merge the tiers that are due; with ``small`` fold the small logs too, and remove what no reader can need any more."""
    committed = committed_batch(spark, root)
    for table in keyed_tables(root):
        keyed.merge_tiers(spark, table, committed)
    if small:
        _compact_small(spark, root)
        since = batchlog.oldest_reader(spark, root, retain)
        for path in log_paths(root):
            batchlog.remove_folded(spark, path, since)
