"""The ingest: one read, one parse, all tables once, its own offsets and lag."""

import json

import pytest
from pyspark.sql import functions as F

from paypulse.plans.monitor import INGEST_GROUP, PaymentMonitor
from paypulse.schemas import ENVELOPE, PAYMENTS
from paypulse.sources import files
from paypulse.sources.layers import (
    compact_ingested, layer_path, new_rows, read_ingested, register_layers, scan, scan_raw_since,
)
from paypulse.sources.topics import read_topics
from paypulse.streaming import ingest
from paypulse.streaming.ingest import land_batch, record_source_ends, routed, source_ends, start_ingest
from paypulse.streaming.promote import start_promote

from tests.conftest import at, rows_of
from tests.test_streaming import ONCE


def records(values, first=0, topic="payments", day=1):
    return [("k", v, topic, 0, first + i, at(f"2024-01-{day:02d}T10:00")) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, ENVELOPE)


BATCH = records(['{"payment_id": "p"}', "{broken", None]) + records(['{"order_id": "o"}', "[1]"], topic="orders") + records(["{}"], topic="unrelated")


def landed(spark, root):
    return {t: scan(spark, root, "raw", t).count() for t in ("payments_events", "orders_events", "quarantine")}


def test_every_record_goes_to_one_table(spark):
    rows = routed(frame(spark, BATCH), load_time=F.col("timestamp"))
    assert rows_of(rows.select("table", "topic", "offset", "value")) == sorted([
        ("payments_events", "payments", 0, None), ("quarantine", "payments", 1, "{broken"), ("quarantine", "payments", 2, None),
        ("orders_events", "orders", 0, None), ("quarantine", "orders", 1, "[1]"),
    ], key=repr)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("try_parse_json") + text.count("parse_json(") <= 2  # once, and in the name of its column


@pytest.mark.parametrize("step", ["moved", "published", "offsets"])
def test_a_batch_tried_again_lands_once(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    register_layers(spark, root)
    rows = routed(frame(spark, BATCH).repartition(3), load_time=F.col("timestamp"))

    def fail(*args):
        raise OSError("lost")

    if step == "moved":  # after the first file
        real, done = files.move, []

        def some(spark, source, target):
            if "/raw/" in target and done:
                fail()
            done.append(real(spark, source, target)) if "/raw/" in target else real(spark, source, target)

        monkeypatch.setattr(ingest.files, "move", some)
    elif step == "published":
        monkeypatch.setattr(ingest.batchlog, "write_batch", fail)
    else:
        monkeypatch.setattr(ingest, "_offsets", fail)
    with pytest.raises(OSError):
        land_batch(rows, root, 0)
    monkeypatch.undo()
    for _ in range(2):
        land_batch(rows, root, 0)
        assert landed(spark, root) == {"payments_events": 1, "orders_events": 1, "quarantine": 3}
    assert rows_of(read_ingested(spark, root)) == [("orders", 0, 2, 1, 1), ("payments", 0, 3, 1, 2)]
    assert files.entries(spark, layer_path(root, "checkpoints", "ingest_staging")) == []


def test_one_source_serves_all_tables(spark, tmp_path):
    root, source = str(tmp_path / "layers"), str(tmp_path / "topics")
    register_layers(spark, root)
    opened = []

    def records_of(topics):
        opened.append(topics)
        return read_topics(spark, topics, "parquet", path=source)

    frame(spark, BATCH).write.parquet(source)
    queries = start_ingest(records_of, root, ONCE, load_time=F.col("timestamp"))
    for query in queries:
        query.awaitTermination()
    assert len(opened) == 1 and len(queries) == 1 and len(queries[0].lastProgress["sources"]) == 1
    assert 5 <= queries[0].lastProgress["sources"][0]["numInputRows"] <= len(BATCH)  # the unrelated topic may be skipped
    assert landed(spark, root) == {"payments_events": 1, "orders_events": 1, "quarantine": 3}


def test_health_needs_neither_raw_nor_curated(spark, tmp_path):
    root = str(tmp_path)
    register_layers(spark, root)
    for batch, day in enumerate((1, 2, 3)):
        values = [json.dumps({"payment_id": f"p{batch}{k}", "order_id": "o", "status": "PAID", "amount": 1.0}) for k in range(4)]
        rows = routed(frame(spark, records([*values, "broken"], 5 * batch, day=day)), load_time=F.col("timestamp"))
        land_batch(rows, root, batch)
        if batch == 1:
            start_promote(spark, root, ONCE).awaitTermination()
            assert compact_ingested(spark, root) == 1 and compact_ingested(spark, root) is None
    monitor = PaymentMonitor(spark, root, at("2024-01-03T10:02"))
    assert rows_of(monitor.end_offsets("payments")) == [("payments", 0, 15)]
    assert monitor.total_lag("payments").first().lag == 6 and monitor.total_lag("payments", INGEST_GROUP).first().lag == 0
    throughput = monitor.ingest_throughput()
    assert tuple(throughput.first()) == (0, 4, 0, 8)
    summary = monitor.pipeline_summary(INGEST_GROUP)
    assert (summary.first().payments_lag, summary.first().payments_5min, summary.first().curated_payments_total) == (0, 4, 8)
    for read in (throughput.inputFiles(), summary.inputFiles()):
        assert not any("load_date=2024-01-01" in f or "load_date=2024-01-02" in f for f in read)
        assert not any("/curated/payments/" in f or "/curated/orders/" in f or "/quarantine/" in f for f in read)
    # The topic itself may be further than the ingest.
    assert record_source_ends(spark, root, json.dumps({"sources": [{"latestOffset": {"payments": {"0": 40}}}]}))
    assert monitor.total_lag("payments", INGEST_GROUP).first().lag == 25
    assert record_source_ends(spark, root, json.dumps({"sources": [{"latestOffset": json.dumps({"payments": {"0": 42}})}]}))
    assert monitor.total_lag("payments", INGEST_GROUP).first().lag == 27


def test_reports_without_ends_are_passed_over(spark, tmp_path):
    assert source_ends('{"sources": [{"latestOffset": null}, {"latestOffset": {"logOffset": 3}}, {}]}') == []
    assert not record_source_ends(spark, str(tmp_path), '{"sources": []}')
    assert source_ends('{"sources": [{"latestOffset": {"b": {"1": 5, "0": 7}, "a": {"0": 1}}}]}') == [("a", 0, 1), ("b", 0, 7), ("b", 1, 5)]


def test_recent_days(spark, tmp_path):
    root = str(tmp_path)
    register_layers(spark, root)
    assert scan_raw_since(spark, root, PAYMENTS.raw_table, at("00:00").date()).count() == 0
    # A batch over several days lies in the folder of the last one, so no recent row is left out.
    rows = records(["{}"], day=1) + records(["{}"], 1, day=5)
    land_batch(routed(frame(spark, rows), load_time=F.col("timestamp")), root, 0)
    land_batch(routed(frame(spark, records(["{}"], 2, day=3)), load_time=F.col("timestamp")), root, 1)
    days = {d: scan_raw_since(spark, root, PAYMENTS.raw_table, at(f"2024-01-{d:02d}T00:00").date()).count() for d in (1, 4, 5, 6)}
    assert days == {1: 3, 4: 2, 5: 2, 6: 0}


def test_small_flushes_by_records_and_by_time(spark, tmp_path):
    """A file source takes a batch every so often, or splits a backlog by files; every record arrives once."""
    root, source = str(tmp_path / "layers"), str(tmp_path / "topics")
    register_layers(spark, root)
    for k in range(3):
        frame(spark, records(['{"payment_id": "p%d"}' % k], k)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda topics: read_topics(spark, topics, "parquet", path=source, maxFilesPerTrigger="1")
    query, = start_ingest(stream, root, ONCE)
    query.awaitTermination()
    assert landed(spark, root)["payments_events"] == 3 and query.lastProgress["batchId"] == 2
    query, = start_ingest(stream, root, {"processingTime": "1 second"})
    frame(spark, records(['{"payment_id": "late"}'], 3)).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert landed(spark, root)["payments_events"] == 4
    feed = new_rows(spark, root, PAYMENTS).writeStream.format("memory").queryName("feed").trigger(**ONCE).start()
    feed.awaitTermination()
    assert spark.table("feed").count() == 4
