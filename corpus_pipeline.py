"""The corpus pipeline: toxic documents, exact and near copies go, sources are mixed, and the mix is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of ``documents``; the last returns the pieces of packed sequences. Where
a stage's operator defines a result for nulls, empty texts, repeated rows and empty tables, the stage has the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paypulse.llm.exact_dedup import drop_exact_duplicates
from paypulse.llm.mixing import take_mix
from paypulse.llm.near_dedup import drop_near_duplicates
from paypulse.llm.packing import pack
from paypulse.llm.queries import tokenizer_path
from paypulse.llm.shared import read, ship_package
from paypulse.llm.toxicity import drop_toxic
from paypulse.session import shared_dir

#: Similarity from which on the near_dedup stage drops copies, in hundredths; op5_near_dedup has 85.
NEAR = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, doesn't reject."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose 5-word shingles have a similarity of ``NEAR`` hundredths or more with no earlier one's."""
    ship_package(spark)
    return drop_near_duplicates(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]
#: A trained classifier, sketches and tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = read(spark, sf_dir, "documents"), shared_dir(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
