"""How the stream pipeline's records are cut into files and tasks."""

import os

import __spark_entry__ as entry
from paypulse.plans import inputs
from paypulse.session import SPLITS_A_CORE, fine_splits

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_fine_splits_give_each_core_several_parts(spark, tmp_path):
    setting, cores = "spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism
    path = str(tmp_path / "files")
    spark.range(100 * cores, numPartitions=16 * cores).write.parquet(path)
    plain = spark.read.parquet(path).rdd.getNumPartitions()
    with fine_splits(spark):
        fine = spark.read.parquet(path).rdd.getNumPartitions()
        assert spark.read.parquet(path).count() == 100 * cores
    assert fine >= (SPLITS_A_CORE - 1) * cores and fine >= 2 * plain
    assert spark.conf.get(setting, None) is None
    spark.conf.set(setting, "7")
    try:
        with fine_splits(spark):
            assert spark.conf.get(setting) == "7"
    finally:
        spark.conf.unset(setting)


def test_topics_lie_in_small_files_by_topic_and_part(spark, monkeypatch):
    monkeypatch.setattr(entry, "FILE_RECORDS", 100)
    root = entry.run_pipeline(spark, SF_DIR)
    for table, records in ((entry.ORDERS, inputs.order_records), (entry.PAYMENTS, inputs.payment_records)):
        parts = [spark.read.parquet(f"{root}/topics/{table.topic}/part-{k}") for k in range(entry.PARTS)]
        for part in parts:
            sizes = part.groupBy(entry.F.input_file_name()).count().collect()
            assert max(r["count"] for r in sizes) <= 100
        found, want = parts[0].unionByName(parts[1]), records(spark, SF_DIR)
        assert found.count() == want.count() and found.exceptAll(want.select(*found.columns)).isEmpty()
    assert entry.scan(spark, root, "raw", entry.PAYMENTS.raw_table).count() == want.count()
