"""Topics to RAW, continuously."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from paypulse.operators.landing import judge, land_raw
from paypulse.schemas import INGESTED, QUARANTINE, RAW, TABLES
from paypulse.sources import batchlog, files
from paypulse.sources.layers import compact_ingested, ingested_path, layer_path, source_ends_path

DEFAULT_ROUTES = {t.topic: t.raw_table for t in TABLES.values()}
#: Batches between two folds of the ingest's own log.
FOLD_EVERY = 60

_STAGED = T.StructType([*RAW.fields, *QUARANTINE.fields, T.StructField("table", T.StringType())])


def routed(records: DataFrame, routes: Mapping[str, str] = DEFAULT_ROUTES, load_time: Column | None = None) -> DataFrame:
    """Every record once, parsed once, as a row for its ``table``, with RAW and quarantine columns.

    A record that can't be landed goes to the quarantine with its value, any other to its topic's RAW table.
    """
    table = F.when(F.col("reason").isNotNull(), F.lit("quarantine"))
    for topic, name in routes.items():
        table = table.when(F.col("topic") == topic, F.lit(name))
    judged = judge(records.where(F.col("topic").isin(list(routes)))).withColumn("table", table)
    value = F.when(F.col("reason").isNotNull(), F.col("value")).alias("value")
    rows = land_raw(judged, load_time, ("topic", "partition", "offset", value, "reason", "table"))
    content = F.when(F.col("reason").isNull(), F.col("record_content"))
    return rows.withColumn("record_content", content)


def _staging(root: str, batch_id: int) -> str:
    return f"{layer_path(root, 'checkpoints', 'ingest_staging')}/{batch_id:012}"


def land_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """Put the rows of one batch into all tables they go to, whole and once, however often that is tried.

    They are written to a folder of the batch, in one job, and their offsets beside them; then the files are moved to the
    tables, where readers see a file whole or not at all, and last the offsets are published, which ends the batch. A
    second attempt goes on where the first one has stopped; it writes again only what was not written to its end.

    A table's files go to the folder of the latest day that the batch has loaded, so a reader of recent rows can leave out
    the folders of earlier days, and a backfill over many days makes no more folders than any batch.
    """
    spark, staged = rows.sparkSession, _staging(root, batch_id)
    if batch_id <= batchlog.last_complete_batch(spark, ingested_path(root)):
        return
    if not files.is_complete(spark, staged):
        rows.write.mode("overwrite").partitionBy("table").parquet(staged)
    if not files.exists(spark, f"{staged}-days.json"):
        written = spark.read.schema(_STAGED).parquet(staged) if files.entries(spark, staged)[1:] else spark.createDataFrame([], _STAGED)
        found = _found(written).persist()
        try:
            _offsets(found).coalesce(1).write.mode("overwrite").parquet(f"{staged}-offsets")
            days = found.groupBy("table").agg(F.max("day").cast("string").alias("day")).collect()
        finally:
            found.unpersist()
        files.write_text(spark, f"{staged}-days.json", json.dumps({r.table: r.day for r in days}))
    for table, day in json.loads(files.read_text(spark, f"{staged}-days.json")).items():
        for file in files.entries(spark, f"{staged}/table={table}"):
            files.move(spark, file.path, f"{layer_path(root, 'raw', table)}/load_date={day}/{batch_id:012}-{file.name}")
    batchlog.write_batch(spark.read.schema(INGESTED).parquet(f"{staged}-offsets"), ingested_path(root), batch_id)
    for name in ("", "-offsets", "-days.json"):
        files.delete(spark, f"{staged}{name}")


def _found(rows: DataFrame) -> DataFrame:
    """What a batch has written by table and topic partition: a few rows, from one pass."""
    good = F.col("reason").isNull()
    return rows.groupBy("table", "topic", "partition").agg(
        (F.max("offset") + 1).alias("end_offset"), F.count_if(good).alias("landed"), F.count_if(~good).alias("rejected"),
        F.max(F.to_date("load_time")).alias("day"),
    )


def _offsets(found: DataFrame) -> DataFrame:
    return found.groupBy("topic", "partition").agg(
        F.max("end_offset").alias("end_offset"), F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected")
    )


def start_ingest(
    records_of: Callable[[list[str]], DataFrame],
    root: str,
    trigger: Mapping[str, object],
    routes: Mapping[str, str] = DEFAULT_ROUTES,
    load_time: Column | None = None,
) -> list[StreamingQuery]:
    """Start the query that fills the RAW tables and the quarantine; a list of one.

    ``records_of`` opens the stream of the given topics, which is read and parsed once for all tables. Parallelism
    is that of the source partitions; there is no shuffle of records. Keep the checkpoint with the tables: batch numbers come
    from it. What the source says of its own end is kept too, see ``SourceEnds``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        land_batch(batch, root, batch_id)
        if (batch_id + 1) % FOLD_EVERY == 0:
            compact_ingested(batch.sparkSession, root)

    rows = routed(records_of(list(routes)), routes, load_time)
    spark = rows.sparkSession
    query = (
        rows.writeStream.queryName("ingest")
        .option("checkpointLocation", layer_path(root, "checkpoints", "ingest"))
        .trigger(**trigger)
        .foreachBatch(run)
        .start()
    )
    spark.streams.addListener(SourceEnds(spark, root, str(query.id)))
    return [query]


def source_ends(progress: str) -> list[tuple[str, int, int]]:
    """(topic, partition, end offset) of a progress report, as far as its sources tell ends by topic, as Kafka's does."""
    found = []
    for source in json.loads(progress).get("sources", []):
        ends = source.get("latestOffset")
        ends = json.loads(ends) if isinstance(ends, str) else ends
        for topic, partitions in (ends or {}).items():
            if isinstance(partitions, dict):
                found += [(topic, int(p), int(end)) for p, end in partitions.items()]
    return sorted(found)


def record_source_ends(spark: SparkSession, root: str, progress: str) -> bool:
    """Keep the topics' end offsets of a progress report; the newest report counts. Returns whether it has told any."""
    ends = source_ends(progress)
    if ends:
        folder = source_ends_path(root)
        old = files.entries(spark, folder)
        number = int(old[-1].name.split(".")[0]) + 1 if old else 0
        files.write_text(spark, f"{folder}/{number:012}.json", json.dumps(ends))
        for entry in old[:-1]:  # a reader may just have listed the last one
            files.delete(spark, entry.path)
    return bool(ends)


class SourceEnds(StreamingQueryListener):
    """Keeps what the sources of one query report of their ends, so that the lag of the ingest itself is known."""

    def __init__(self, spark: SparkSession, root: str, query_id: str):
        self.spark, self.root, self.query_id = spark, root, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query_id:
            record_source_ends(self.spark, self.root, event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.spark.streams.removeListener(self)
