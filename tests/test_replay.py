"""What the promotion and its replay read, and how often."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from paypulse.plans import inputs
from paypulse.schemas import ENVELOPE, ORDERS, PAYMENTS
from paypulse.sources.layers import read_curated, read_offsets, register_layers, scan
from paypulse.streaming import promote

from tests.conftest import at, rows_of
from tests.test_streaming import ONCE, history, land


def test_a_replay_parses_a_record_once_and_promotes_only_what_was_landed(spark, monkeypatch):
    """Without the check, a broken value would come back from the topics as a row without a key."""
    def records(table, values):
        rows = [(None, v, table.topic, 0, i, at(f"10:{i:02d}")) for i, v in enumerate(values)]
        return lambda spark, sf_dir: spark.createDataFrame(rows, ENVELOPE)

    bad = ["{broken", None, "[1]", "{broken", "7", None, "[2]", "{also"]
    monkeypatch.setattr(inputs, "order_records", records(ORDERS, [f'{{"order_id": "o{i}"}}' for i in range(8)] + bad))
    monkeypatch.setattr(inputs, "payment_records", records(PAYMENTS, [f'{{"payment_id": "p{i}"}}' for i in range(8)] + bad + ["{}"]))
    plans, real = [], entry.promote_batch

    def spied(spark, new, root, table, batch_id):
        plans.append(new.where(F.col(table.key).isNotNull())._jdf.queryExecution().executedPlan().toString())
        real(spark, new, root, table, batch_id)

    monkeypatch.setattr(entry, "promote_batch", spied)
    root = entry.run_pipeline(spark, "unused")
    assert rows_of(read_curated(spark, root, ORDERS).select("order_id")) == [(f"o{i}",) for i in range(8)]
    # "{}" is an object, so it is landed and kept, once, without a key
    assert rows_of(read_curated(spark, root, PAYMENTS).select("payment_id")) == sorted([(None,), *((f"p{i}",) for i in range(8))], key=repr)
    assert scan(spark, root, "raw", "quarantine").count() == 2 * len(bad)
    assert len(plans) == 2 and all(p.count("parseJson(") == 1 for p in plans)


def test_commits_come_from_the_pass_that_counts_a_batch(spark, tmp_path, monkeypatch):
    root, records, logs, real = str(tmp_path), history(3, 40), [], promote.group_commits
    register_layers(spark, root)

    def spied(log, group):
        logs.append(log)
        return real(log, group)

    monkeypatch.setattr(promote, "group_commits", spied)
    for start, end in ((0, 25), (25, 40)):
        land(spark, root, records[start:end])
        promote.start_promote(spark, root, ONCE).awaitTermination()
    assert len(logs) == 2 and not any("FileScan" in log._jdf.queryExecution().executedPlan().toString() for log in logs)
    ends = {}
    for _, value, topic, partition, offset, _ in records:
        if value is not None and value.lstrip().startswith("{"):
            ends[topic, partition] = max(offset + 1, ends.get((topic, partition), 0))
    furthest = read_offsets(spark, root).groupBy("topic", "partition").agg(F.max("committed").alias("committed"))
    found = {(r.topic, r.partition): r.committed for r in furthest.collect()}
    assert found and set(found) <= set(ends) and all(found[k] == ends[k] for k in found)
