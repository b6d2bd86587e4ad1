"""Keyed tables: tiers, index, leases; promotion and metrics over many batches."""

import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from paypulse.schemas import ORDERS, PAYMENTS
from paypulse.sources import batchlog, files, keyed
from paypulse.sources.keyed import KeyedTable
from paypulse.sources.layers import (
    committed_batch, curated_table, keyed_tables, log_paths, maintain, paid_orders_table, read_curated, read_totals, register_layers,
)
from paypulse.streaming.promote import start_promote

from tests.conftest import rows_of
from tests.test_streaming import ONCE, assert_consistent, history, land

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("w", T.StringType())])


def make_table(path):
    return KeyedTable(str(path), "k", SCHEMA, ("k", "v"), ("v", "k"))


def write(spark, table, current, batch, rows):
    """Write a batch of (key, value) as a promotion does; ``current`` holds the state as a dict, keyless rows as a list."""
    changes = []
    for k, v in rows:
        changes.append((k, v, "x", (current[k],) if k in current else None))
        if k is None:
            current.setdefault(None, []).append(v)
            changes[-1] = (None, v, "x", None)
        else:
            current[k] = v
    frame = spark.createDataFrame(changes, table.change_schema)
    batchlog.write_batch(frame.coalesce(1), table.path, batch)


def state_of(current):
    return sorted([(k, v) for k, v in current.items() if k is not None] + [(None, v) for v in current.get(None, [])], key=repr)


def read(spark, table, upto):
    return rows_of(keyed.read(spark, table, upto).select("k", "v"))


@pytest.mark.parametrize("seed", [1, 2])
def test_tiers_hold_the_current_rows(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(keyed, "TIER", 3)
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 4)
    rng, table, current = random.Random(seed), make_table(tmp_path / "t"), {}
    keyed.create(spark, table)
    assert read(spark, table, -1) == []
    most = 0
    for batch in range(18):
        keys = rng.sample([f"k{n}" for n in range(10 + 4 * batch)], 4)
        write(spark, table, current, batch, [(k, rng.randrange(100)) for k in keys] + [(None, batch)])
        if batch % 2:
            keyed.merge_tiers(spark, table, batch)
            folders = batchlog.manifest_of(spark, table.path).folders
            most = max(most, len(folders))
            batchlog.remove_folded(spark, table.path)
            assert len(batchlog.batch_numbers(spark, table.path)) <= 3
        if batch % 6 == 5:
            assert read(spark, table, batch) == state_of(current)
            asked = spark.createDataFrame([(k,) for k in keys + ["nobody"]], "k string").persist()
            found = rows_of(keyed.lookup(spark, table, asked, batch))
            assert found == sorted((k, current[k]) for k in keys)
    levels = {r.level for r in batchlog.manifest_of(spark, table.path).folders}
    assert most <= 7 and -1 in levels
    run = keyed.compact(spark, table, 17)
    assert read(spark, table, 17) == state_of(current) and run.rows == len(state_of(current))
    assert run.buckets == 1 << (-(-run.rows // 4) - 1).bit_length()


def index_bytes(frame):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in frame.inputFiles())


def test_a_lookup_reads_the_same_however_long_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 50)
    read_bytes, opened = [], []
    for rows in (4000, 8000):
        table = make_table(tmp_path / f"t{rows}")
        keyed.create(spark, table)
        before = T.StructType([T.StructField("before", table.change_schema["before"].dataType)])
        history = spark.range(rows).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.lit("w").alias("w"))
        history = history.withColumn("before", F.lit(None).cast(before["before"].dataType))
        batchlog.write_batch(history, table.path, 0)
        keyed.compact(spark, table, 0)
        asked = spark.createDataFrame([(f"k{n * 37 % 4000}",) for n in range(20)], "k string").persist()
        frame = keyed.lookup(spark, table, asked, 0)
        assert {r.k: r.v for r in frame.collect()} == {f"k{n * 37 % 4000}": n * 37 % 4000 for n in range(20)}
        read_bytes.append(index_bytes(frame))
        opened.append(len(frame.inputFiles()))
    assert max(opened) <= 20 + 1 and read_bytes[1] < 1.2 * read_bytes[0]
    # More buckets than a lookup names: the whole index is read, with the same result.
    monkeypatch.setattr(keyed, "LOOKUP_BUCKETS", 3)
    assert rows_of(keyed.lookup(spark, table, asked, 0)) == rows_of(frame)


def test_a_lookup_without_keys_gives_all_current_rows(spark, tmp_path):
    table, current = make_table(tmp_path / "t"), {}
    keyed.create(spark, table)
    assert rows_of(keyed.lookup(spark, table, None, -1)) == []
    write(spark, table, current, 0, [("a", 1), ("b", 2), (None, 3)])
    assert rows_of(keyed.lookup(spark, table, None, 0)) == [("a", 1), ("b", 2)]
    keyed.compact(spark, table, 0)
    frame = keyed.lookup(spark, table, None, 0)
    assert rows_of(frame) == [("a", 1), ("b", 2)] and "Aggregate" not in frame._jdf.queryExecution().executedPlan().toString()
    write(spark, table, current, 1, [("b", 5), ("c", 6), (None, 7)])
    assert rows_of(keyed.lookup(spark, table, None, 1)) == [("a", 1), ("b", 5), ("c", 6)]


def test_a_slow_reader_finishes_and_a_crashed_one_does_not_hold_for_ever(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "TIER", 2)
    root, table, current = str(tmp_path), make_table(tmp_path / "t"), {}
    keyed.create(spark, table)
    write(spark, table, current, 0, [("a", 1), ("b", 2)])
    with batchlog.lease(spark, root):
        slow, want = keyed.read(spark, table, 0), state_of(current)
        for batch in range(1, 5):
            write(spark, table, current, batch, [("a", batch), (f"c{batch}", 0)])
            keyed.merge_tiers(spark, table, batch)
            batchlog.remove_folded(spark, table.path, batchlog.oldest_reader(spark, root, retain=0))
        assert rows_of(slow.select("k", "v")) == want
    assert batchlog.remove_folded(spark, table.path, batchlog.oldest_reader(spark, root, retain=3600)) == 0
    assert batchlog.remove_folded(spark, table.path, batchlog.oldest_reader(spark, root, retain=-1)) > 0
    assert read(spark, table, 4) == state_of(current)
    files.write_text(spark, f"{root}/leases/until=1_crashed", "")
    assert batchlog.oldest_reader(spark, root, retain=0) > 1e9
    assert [e.name for e in files.entries(spark, f"{root}/leases")] == []


@pytest.mark.parametrize("seed", [11])
def test_many_batches_with_tiers_and_removal(spark, tmp_path, monkeypatch, seed):
    """Stored metrics and tables equal a batch run after each of several batches; folders stay few."""
    monkeypatch.setattr(keyed, "TIER", 2)
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 3)
    root, records = str(tmp_path), history(seed, 60)
    register_layers(spark, root)
    for start in range(0, 50, 10):
        land(spark, root, records[start : start + 10])
        start_promote(spark, root, ONCE, compact_every=2).awaitTermination()
        maintain(spark, root, small=True, retain=-1)
        if start in (20, 40):
            assert_consistent(spark, root, records[: start + 10])
    totals = {r.table: r.total for r in read_totals(spark, root).collect()}
    assert totals == {t.name: read_curated(spark, root, t).count() for t in (ORDERS, PAYMENTS)}
    for path in log_paths(root):
        assert len(batchlog.batch_numbers(spark, path)) <= 2
        assert len(files.entries(spark, f"{path}/manifest")) <= 2


def test_conversion_reads_neither_orders_nor_payments(spark, tmp_path, monkeypatch):
    """What an update asks of the CURATED tables are index files and the batch's own changes."""
    root, records, plans = str(tmp_path), history(21, 40), []
    register_layers(spark, root)
    land(spark, root, records[:30])
    start_promote(spark, root, ONCE).awaitTermination()
    for table in keyed_tables(root):
        keyed.compact(spark, table, committed_batch(spark, root))
    real_write, real_lookup, looked_up = batchlog.write_batch, keyed.lookup, []

    def paths(frame):
        return [f.removeprefix("file://") for f in frame.inputFiles()]

    def write_batch(rows, path, batch_id):
        plans.append((path, paths(rows)))
        real_write(rows, path, batch_id)

    def lookup(spark, table, keys, upto):
        frame = real_lookup(spark, table, keys, upto)
        looked_up.append((table.path, paths(frame)))
        return frame

    monkeypatch.setattr(batchlog, "write_batch", write_batch)
    monkeypatch.setattr(keyed, "lookup", lookup)
    land(spark, root, records[30:])
    start_promote(spark, root, ONCE).awaitTermination()
    monkeypatch.undo()
    tables = (curated_table(root, ORDERS), curated_table(root, PAYMENTS), paid_orders_table(root))
    snapshots = [f"{t.path}/snapshot/upto=0/" for t in tables]
    read = dict(plans) | {f"lookup {path}": files_read for path, files_read in looked_up}
    del read[f"{root}/analytics/payment_minutes"]  # whose minutes are computed again, from the days they lie in
    assert not any(f.startswith(s) for files_read in read.values() for f in files_read for s in snapshots)
    assert {path for path, files_read in looked_up if any("-keys/" in f for f in files_read)} == {t.path for t in tables}
    assert_consistent(spark, root, records)


def test_a_read_broadcasts_the_replaced_keys_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "TIER", 2)
    table, current = make_table(tmp_path / "t"), {}
    keyed.create(spark, table)
    write(spark, table, current, 0, [(f"k{n}", n) for n in range(50)])
    keyed.compact(spark, table, 0)
    for batch in (1, 2):
        write(spark, table, current, batch, [("k1", 100 + batch), (f"new{batch}", 7)])
    keyed.merge_tiers(spark, table, 2)
    frame = keyed.read(spark, table, 2).where("v >= 10")
    assert rows_of(frame.select("k", "v")) == [x for x in state_of(current) if x[1] >= 10]
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in text and "SortMergeJoin" not in text and "GreaterThanOrEqual(v" in text
