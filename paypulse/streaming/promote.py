"""RAW to CURATED, incrementally."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paypulse.operators.health import group_commits
from paypulse.operators.unpack import unpack
from paypulse.operators.upsert import is_newer, latest_by_key
from paypulse.schemas import ORDERS, PAYMENTS, TABLES, TOTALS, EventTable
from paypulse.session import together
from paypulse.sources import batchlog, keyed
from paypulse.sources.catalog import publish_views
from paypulse.sources.layers import (
    curated_path, curated_table, layer_path, maintain, new_files, offsets_path, read_raw_files, read_totals, totals_path,
)
from paypulse.streaming.incremental import update_metrics

# Fixed value: period of the promotion.
PROMOTE_TRIGGER = {"processingTime": "1 minute"}
PROMOTE_GROUP = "promote"
#: Batches between compactions.
COMPACT_EVERY = 60


class Size(NamedTuple):
    """How many rows a batch has of a table, and how many of them with a key."""

    rows: int
    keyed: int


def promote_batch(
    spark: SparkSession, new: DataFrame, root: str, table: EventTable, batch_id: int, size: Size | None = None
) -> None:
    """Merge new typed rows into the CURATED table: latest load time wins, at the same time the highest offset.

    Only the current rows of the batch's keys take part in the comparison, and only the columns that decide it or that
    metrics need; the table's index finds them without a scan of the table. The batch is counted first, unless the caller knows its ``size``. One of at most
    ``keyed.MANY_ROWS`` is cached, so Catalyst decides on its true size whether to broadcast it. A larger one streams through one
    shuffle, which dedupes it and joins it with the index, into the table; nothing of it is cached.
    Rows without a key match nothing; they are added without being joined.
    """
    target, columns = curated_table(root, table), table.schema.names
    if batch_id <= batchlog.manifest_of(spark, target.path).merged:
        return
    rows = new.select(*columns, F.col("offset").alias("seq"))
    size = size or Size(*rows.agg(F.count("*"), F.count(table.key)).first())
    if size.rows == 0:
        return
    has_key = latest_by_key(rows.where(F.col(table.key).isNotNull()), table.key, "load_time", "seq", keyed=True)
    few = size.rows <= keyed.MANY_ROWS
    try:
        if few:
            has_key.persist().count()
        current = keyed.lookup(spark, target, has_key if few else None, batch_id - 1)
        kept = target.change_schema["before"].dataType.names
        before = current.select(F.col(table.key).alias("_key"), "load_time", "seq", F.struct(*kept).alias("before"))
        winners = (
            has_key.alias("s").join(before.alias("t"), F.col(f"s.{table.key}") == F.col("_key"), "left")
            .where(F.col("_key").isNull() | is_newer("s", "t", "load_time", "seq"))
            .select("s.*", "before")
        )
        if size.keyed < size.rows:
            keyless = rows.where(F.col(table.key).isNull())
            winners = winners.unionByName(keyless, allowMissingColumns=True)
        batchlog.write_batch(winners, target.path, batch_id)
    finally:
        if few:
            has_key.unpersist()


def _write_totals(spark: SparkSession, root: str, batch_id: int) -> None:
    """The tables' numbers of rows: those before the batch, and the rows it has added without replacing one."""
    if batch_id <= batchlog.manifest_of(spark, totals_path(root)).upto:
        return
    added = read_totals(spark, root, batch_id - 1)
    for table in TABLES.values():
        changes = batchlog.read_batches(spark, curated_path(root, table), curated_table(root, table).change_schema, batch_id - 1, batch_id)
        new = changes.where(F.col("before").isNull()).agg(F.count("*").alias("total"))
        added = added.unionByName(new.select(F.lit(table.name).alias("table"), "total"))
    totals = added.groupBy("table").agg(F.sum("total").alias("total")).select(*TOTALS.names)
    batchlog.write_batch(totals.coalesce(1), totals_path(root), batch_id)


def _taken(rows: DataFrame, table: EventTable) -> list[Row]:
    """What a batch has of each topic partition: its last offset, its rows, and those with a key. One pass, a few rows."""
    return rows.groupBy("topic", "partition").agg(
        F.max("offset").alias("offset"), F.count("*").alias("rows"), F.count(table.key).alias("keyed")
    ).collect()


def _write_commits(spark: SparkSession, taken: list[Row], root: str, batch_id: int) -> None:
    ends = spark.createDataFrame([(r.topic, r.partition, r.offset) for r in taken], "topic string, partition int, offset bigint")
    commits = group_commits(ends, PROMOTE_GROUP).coalesce(1)
    batchlog.write_batch(commits, offsets_path(root), batch_id)


def start_promote(
    spark: SparkSession,
    root: str,
    trigger: Mapping[str, object] = PROMOTE_TRIGGER,
    *,
    with_metrics: bool = True,
    compact_every: int | None = COMPACT_EVERY,
    catalog: bool = False,
    **source_options: str,
) -> StreamingQuery:
    """Promote new RAW rows: orders and payments, then the metrics they touch, last the commits.

    Both tables share one query, hence one batch number. Spark plans what a batch function gets to its end before the function
    sees it, so each use would unpack all fields of both tables: the query names the batch's files, and each step reads of them
    the fields that it needs. Every step of a batch overwrites its own output folder, so a batch run again after a failure leaves
    the same result. Keep the checkpoint with the tables: batch numbers come from it.
    The keyed tables are merged in tiers as they grow. ``compact_every`` folds the small logs after that many batches,
    an hour's by default, and removes what no reader can need any more; with ``None`` nothing is merged or removed, which
    leaves all that to the caller. ``catalog`` replaces the views of the session catalog after each batch.
    """
    feeds = [
        new_files(spark, root, table, **source_options).withColumn("table", F.lit(table.name))
        for table in (ORDERS, PAYMENTS)
    ]

    def run(batch: DataFrame, batch_id: int) -> None:
        session, found = batch.sparkSession, batch.distinct().collect()
        rows = {
            table: unpack(
                read_raw_files(session, sorted(r.file for r in found if r.table == table.name)), table,
                with_payload=False, with_position=True,
            )
            for table in (ORDERS, PAYMENTS)
        }
        taken: dict[EventTable, list[Row]] = {}

        def promote(table: EventTable) -> None:
            taken[table] = _taken(rows[table], table)
            size = Size(sum(r.rows for r in taken[table]), sum(r.keyed for r in taken[table]))
            promote_batch(session, rows[table], root, table, batch_id, size)

        together(session, *(partial(promote, table) for table in rows))
        derived = [partial(_write_totals, session, root, batch_id)]
        if with_metrics:
            derived.append(partial(update_metrics, session, root, batch_id))
        together(session, *derived)
        _write_commits(session, [*taken[ORDERS], *taken[PAYMENTS]], root, batch_id)
        if compact_every:
            maintain(session, root, small=(batch_id + 1) % compact_every == 0)
        if catalog:
            publish_views(session, root)

    return (
        feeds[0].unionByName(feeds[1])
        .writeStream.queryName("promote")
        .option("checkpointLocation", layer_path(root, "checkpoints", "promote"))
        .trigger(**trigger)
        .foreachBatch(run)
        .start()
    )
