"""Registered queries against their SQL forms, and the pipeline's stages against brute force."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from paypulse.llm.queries import oracle_sql, queries
from paypulse.llm.mixing import mix_sources
from tests.llm.test_near_dedup import linked_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    result = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted((tuple(map(normal, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(normal, r)) for r in frame.select(*columns).collect()), key=repr) == want


def test_registered_names():
    assert sorted(queries()) == sorted([f"op{n}_{name}" for n, name in (
        (1, "chat_formatting"), (2, "secret_scan"), (3, "personal_data"), (4, "exact_dedup"), (5, "near_dedup"), (6, "packing"),
        (7, "mixing"), (8, "substring_dedup"), (9, "embedding_dedup"), (10, "toxicity"), (11, "spelling"), (12, "warc"), (13, "collocations"))] + ["pipeline"])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF_DIR)
        if name == "packing":
            break
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["toxicity"]
    labels = dict(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic").collect())
    dropped = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert not any(labels.get(i) == 0 for i in dropped)

    before, after = kept["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())

    before, after = kept["near_dedup"]
    component = linked_components(sorted((r.doc_id, r.text) for r in before), 80)
    assert sorted(r.doc_id for r in after) == [i for i, least in component if i == least]

    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in mix_sources(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in copies.items() if n})

    pieces = docs.collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in after)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in pieces)


def test_pipeline_stages_with_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF_DIR)
            assert out.columns == frame.columns
            assert out.count() <= 3 * frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).count() >= frame.count()


def test_package_is_sent_once(spark):
    from paypulse.llm.shared import ship_package

    ship_package(spark)
    ship_package(spark)
    assert len([f for f in spark.sparkContext.listFiles if f.endswith("/paypulse.zip")]) == 1
