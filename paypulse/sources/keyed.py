"""Keyed tables on a batch log: one current row per key, a log merged in tiers, and an index by key.

A batch holds the rows that won their key, with what the earlier row of the key had in ``before`` (null for a new key). A row
is current unless a later batch or run replaces its key; only the few keys that were replaced take part in that comparison.

``TIER`` batches become a run, ``TIER`` runs of one level a run of the next, so a row is rewritten as often as the logarithm of
the number of batches, and there are never more than ``TIER`` folders of a level. Once the runs have grown to half of the
snapshot, they are folded into a new one.

Each run and snapshot has an index: the narrow columns that a promotion or a metric asks for, in files of ``BUCKET_ROWS`` rows
dealt by the hash of the key. A lookup opens the files that its keys fall into, however long the history is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from paypulse.sources import batchlog, files
from paypulse.sources.batchlog import Run

TIER = 10
BUCKET_ROWS = 100_000
#: A batch of more rows than this is compared with all current rows; its keys are neither cached nor broadcast.
MANY_ROWS = 1_000_000
#: Buckets are counted in powers of two up to this one; a lookup in more than ``LOOKUP_BUCKETS`` of them reads the whole index.
MOST_BUCKETS, LOOKUP_BUCKETS = 1 << 20, 4096


@dataclass(frozen=True)
class KeyedTable:
    """Where it lies, its key, its columns, the columns that ``before`` and the index keep, and the order of its files."""

    path: str
    key: str
    schema: T.StructType
    narrow: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def change_schema(self) -> T.StructType:
        before = T.StructType([f for f in self.schema.fields if f.name in self.narrow and f.name != self.key])
        return T.StructType(list(self.schema.fields)).add("before", before)

    @property
    def run_schema(self) -> T.StructType:
        return T.StructType(list(self.schema.fields)).add("replaces", T.BooleanType())

    @property
    def index_columns(self) -> list[str]:
        return [self.key, *(c for c in self.narrow if c != self.key)]


def create(spark: SparkSession, table: KeyedTable) -> None:
    batchlog.create(spark, table.path, table.change_schema)


def _changes(spark: SparkSession, table: KeyedTable, after: int, upto: int) -> DataFrame:
    """The rows of batches in (after, upto] with ``at``, their batch, and ``replaces``."""
    rows = batchlog.read_batches(spark, table.path, table.change_schema, after, upto)
    return rows.select(*table.schema.names, F.col("before").isNotNull().alias("replaces"), F.col("batch_id").alias("at"))


def _folder(spark: SparkSession, table: KeyedTable, run: Run) -> DataFrame:
    schema = table.schema if run.level < 0 else table.run_schema
    rows = spark.read.schema(schema).parquet(f"{table.path}/{run.folder}")
    replaces = F.lit(False) if run.level < 0 else F.col("replaces")
    return rows.select(*table.schema.names, replaces.alias("replaces"), F.lit(run.last).cast("bigint").alias("at"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def read(spark: SparkSession, table: KeyedTable, upto: int) -> DataFrame:
    """The current row of each key as of batch ``upto``; rows without a key are all current.

    Rows stream past the keys that later batches or runs have replaced, which Catalyst broadcasts where they are few by
    their file sizes. A single batch, such as a first load, holds each key once and needs no join.
    """
    manifest, columns = batchlog.manifest_of(spark, table.path), table.schema.names
    frames = [_folder(spark, table, run) for run in manifest.folders]
    replaced = [_replaced(spark, table, run) for run in manifest.runs]
    if upto > manifest.merged or not frames:
        changes = _changes(spark, table, manifest.merged, upto)
        frames.append(changes)
        replaced.append(changes.where("replaces").select(F.col(table.key).alias("_key"), F.col("at").alias("_at")))
    if len(frames) == 1 and (manifest.folders or upto - manifest.merged <= 1):
        return frames[0].select(*columns)
    newer = (F.col(table.key) == F.col("_key")) & (F.col("_at") > F.col("at"))
    return _union(frames).join(_union(replaced), newer, "left_anti").select(*columns)


def _replaced(spark: SparkSession, table: KeyedTable, run: Run) -> DataFrame:
    """The keys that a run has replaced, kept in a folder of their own, so that Catalyst knows how few they are."""
    schema = T.StructType([table.schema[table.key]])
    keys = spark.read.schema(schema).parquet(f"{table.path}/{run.folder}-replaced")
    return keys.select(F.col(table.key).alias("_key"), F.lit(run.last).cast("bigint").alias("_at"))


def lookup(spark: SparkSession, table: KeyedTable, keys: DataFrame | None, upto: int) -> DataFrame:
    """The index columns of the current rows, as of batch ``upto``, whose key is among ``keys``: a frame with the key column,
    cached by the caller, without nulls. Without ``keys`` those of all current rows with a key, for a batch of very many keys.

    A single folder or batch holds each key once, so its rows need no comparison with each other. Batches that aren't merged yet are read whole, of runs and snapshot only the index files that the keys fall into.
    """
    manifest, columns = batchlog.manifest_of(spark, table.path), table.index_columns
    frames = []
    wanted = None if keys is None else keys.select(table.key)
    touched = _touched(wanted, table.key) if keys is not None and any(run.buckets > 1 for run in manifest.folders) else None
    for run in manifest.folders:
        found = _index(spark, table, run, touched)
        if found is not None:
            frames.append(found.select(*columns, F.lit(run.last).cast("bigint").alias("at")))
    if upto > manifest.merged or not frames:
        frames.append(_changes(spark, table, manifest.merged, upto).select(*columns, "at"))
    rows = _union(frames)
    rows = rows.where(F.col(table.key).isNotNull()) if wanted is None else rows.join(wanted, table.key, "left_semi")
    if len(frames) == 1 and upto - manifest.merged <= 1:
        return rows.select(*columns)
    latest = rows.groupBy(table.key).agg(F.max_by(F.struct(*columns[1:]), "at").alias("row"))
    return latest.select(table.key, "row.*")


def _hash(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _touched(keys: DataFrame, key: str) -> list[int] | None:
    """The finest buckets of the keys; ``None`` if there are more than ``LOOKUP_BUCKETS``."""
    found = keys.select(_hash(key, MOST_BUCKETS).alias("bucket")).distinct().limit(LOOKUP_BUCKETS + 1).collect()
    return None if len(found) > LOOKUP_BUCKETS else [r.bucket for r in found]


def _index(spark: SparkSession, table: KeyedTable, run: Run, touched: list[int] | None) -> DataFrame | None:
    folder = f"{table.path}/{run.folder}-keys"
    if run.buckets == 0:
        return None
    schema = T.StructType([table.schema[c] for c in table.index_columns])
    if touched is None or run.buckets <= 1:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    paths = [f"{folder}/bucket={b}" for b in sorted({t % run.buckets for t in touched})]
    paths = [p for p in paths if files.exists(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def _write_index(spark: SparkSession, table: KeyedTable, folder: str, rows: int) -> int:
    """Writes the index of a folder of so many rows; returns its buckets."""
    if rows == 0:
        return 0
    buckets = min(MOST_BUCKETS, 1 << max(0, (-(-rows // BUCKET_ROWS) - 1).bit_length()))
    schema = T.StructType([table.schema[c] for c in table.index_columns])
    keyed = spark.read.schema(schema).parquet(f"{table.path}/{folder}").where(F.col(table.key).isNotNull())
    keyed = keyed.withColumn("bucket", _hash(table.key, buckets))
    keyed = keyed.repartition(min(buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    keyed.sortWithinPartitions("bucket", table.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{table.path}/{folder}-keys")
    return buckets


def _write_folder(spark: SparkSession, table: KeyedTable, rows: DataFrame, run: Run) -> Run:
    """Writes a run or snapshot with its index, sorted by the table's order so that file statistics let queries skip most of it."""
    rows.repartitionByRange(*table.order).sortWithinPartitions(*table.order).write.mode("overwrite").parquet(f"{table.path}/{run.folder}")
    count = spark.read.parquet(f"{table.path}/{run.folder}").count()
    if run.level >= 0:
        written = _folder(spark, table, run).where("replaces").select(table.key)
        written.write.mode("overwrite").parquet(f"{table.path}/{run.folder}-replaced")
    run = Run(run.first, run.last, run.level, run.folder, count, _write_index(spark, table, run.folder, count))
    batchlog.replace_by(spark, table.path, run)
    return run


def _merged(table: KeyedTable, frames: list[DataFrame]) -> DataFrame:
    """The newest row of each key; it replaces an earlier row if the key's first one among ``frames`` does."""
    rows = _union(frames)
    by_key = Window.partitionBy(table.key)
    keyed = rows.where(F.col(table.key).isNotNull()).select(
        "*", F.row_number().over(by_key.orderBy(F.desc("at"))).alias("_rank"), F.min_by("replaces", "at").over(by_key).alias("_replaces")
    ).where("_rank = 1").withColumn("replaces", F.col("_replaces"))
    names = [*table.schema.names, "replaces"]
    return keyed.select(*names).unionByName(rows.where(F.col(table.key).isNull()).select(*names))


def merge_tiers(spark: SparkSession, table: KeyedTable, upto: int) -> int:
    """Merge what has become due up to the committed batch ``upto``; returns the number of runs and snapshots written."""
    written = 0
    manifest = batchlog.manifest_of(spark, table.path)
    if upto - manifest.merged >= TIER:
        first = manifest.merged + 1
        rows = _merged(table, [_changes(spark, table, manifest.merged, upto)])
        _write_folder(spark, table, rows, Run(first, upto, 1, f"runs/first={first}_last={upto}"))
        written += 1
    while True:
        manifest = batchlog.manifest_of(spark, table.path)
        level = next((k for k in sorted({r.level for r in manifest.runs}) if sum(r.level == k for r in manifest.runs) >= TIER), None)
        if level is None:
            return written
        runs = [r for r in manifest.runs if r.level == level]
        held = 0 if manifest.snapshot is None else manifest.snapshot.rows
        if 2 * sum(r.rows for r in manifest.runs) >= held:
            compact(spark, table, manifest.merged)
        else:
            first, last = runs[0].first, runs[-1].last
            rows = _merged(table, [_folder(spark, table, r) for r in runs])
            _write_folder(spark, table, rows, Run(first, last, level + 1, f"runs/first={first}_last={last}"))
        written += 1


def compact(spark: SparkSession, table: KeyedTable, upto: int) -> Run:
    """Fold everything up to batch ``upto`` into a new snapshot."""
    return _write_folder(spark, table, read(spark, table, upto), Run(0, upto, -1, f"snapshot/upto={upto}"))
