"""Helpers of the operators: cutting lineage, sizing, and hashing the words of Arrow texts in numpy."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import paypulse
from paypulse.session import shared_dir

#: The white space of all contracts, as a character class of Java, RE2 and Python alike.
SPACE = r"\x20\x09-\x0D"
#: Texts are hashed in pieces of about so many bytes, which bounds the memory of a task.
PIECE_BYTES = 2 * 1024 * 1024

#: ``join_sized`` broadcasts the rows of at most so many keys.
HEAVY_KEYS = 1000

_GOLDEN = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACES] = 0
#: The same hash for A-Z as for a-z.
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's modules to the executors' Python workers, once an application."""
    context, name = spark.sparkContext, f"{paypulse.__name__}.zip"
    if any(f.endswith(f"/{name}") for f in context.listFiles):
        return
    root, packed = Path(paypulse.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = f"{shared_dir(spark, 'package')}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder of ``spark.checkpoint.dir``; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_sized(rows: DataFrame, sized: DataFrame, on: list[str], size: str, total: int | None = None) -> DataFrame:
    """``rows`` left-joined with the one row of ``sized`` that has their key; keys are not null. Both are read twice: cut them.

    ``size`` of a key bounds how many of the rows have it, and all keys' sizes add up to ``total`` (by default the rows') at most.
    Keys of a thousandth of it or more are a thousand at most; they are broadcast, so that their rows stay where
    they are. No other key holds enough rows to be a hot one after the shuffle.
    """
    total = rows.count() if total is None else total
    is_heavy = F.col(size) * HEAVY_KEYS >= max(total, 1)
    heavy = F.broadcast(sized.where(is_heavy).withColumn("__heavy", F.lit(True)))
    met = rows.join(heavy, on, "left")
    light = met.where(F.col("__heavy").isNull()).select(*rows.columns).join(sized.where(~is_heavy), on, "left")
    return met.where("__heavy").drop("__heavy").unionByName(light)


def keep_rows(docs: DataFrame, decided: DataFrame, add_key: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, kept, text_key; a row for each of ``docs``, cut) keeps, one of each (doc_id, text_key).

    Where an id has one row, the id decides. Rows whose id is null or repeated are decided by id and text: ``add_key`` adds the
    column ``__key`` that equals their text_key; a null key is a text that every row keeps. Few rows are expected to
    need that, and tables without any are read once. Rows that repeat both are reduced before they are shuffled.
    """
    times = cut(decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    shared = times.where("doc_id is null or n > 1")
    alone = docs.join(times.where("doc_id is not null and n = 1 and kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if shared.isEmpty():
        return alone
    rows = docs.where("doc_id is null").unionByName(docs.join(shared.select("doc_id"), "doc_id", "left_semi").select(*docs.columns))
    keys = decided.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__kept_key")).distinct()
    rows = add_key(rows)
    unknown = rows.where(F.col("__key").isNull())
    first = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.xxhash64(*docs.columns)))
    rows = rows.where(F.col("__key").isNotNull()).withColumn("__first", first).where("__first = 1")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept_key"))
    return alone.unionByName(rows.join(keys, same, "left_semi").select(*docs.columns)).unionByName(unknown.select(*docs.columns))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal values of the first ``keys`` columns, with the rows' other columns; a run has to fit into memory."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key and held:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_GOLDEN)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """The words of some rows: hashes of all words, and where each row's words begin (one entry more than rows)."""

    hashes: np.ndarray
    first: np.ndarray


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    if not n:
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    letter = ~_SPACES[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = letter[edges]
    starts = np.flatnonzero(begins)
    size = max(PIECE_BYTES, 1 << int(n - 1).bit_length())
    if not len(starts):
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    # A polynomial of the place in the piece; the inverse power of a word's start makes it one of the place in the word.
    sums = np.add.reduceat(table[data] * _powers(_BASE, size)[:n], starts)
    return Words(mix(sums * _powers(_INVERSE, size)[starts]), np.searchsorted(starts, offsets))


def word_pieces(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """The words of a text column, ``[^\\x20\\x09-\\x0D]+``, as 64-bit hashes: (first row, its piece's words).

    Null counts as empty. ``lower`` hashes A-Z as a-z. A piece holds whole rows.
    """
    data, offsets = _buffers(column)
    table = _BYTE_LOWER if lower else _BYTE
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        end = min(end, len(column))
        yield row, _hash_words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], table)
        row = end


@functools.lru_cache(maxsize=8)
def _factors(width: int) -> tuple[np.uint64, ...]:
    return tuple(np.random.default_rng(width).integers(1, 2**62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words, across row bounds too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_factors(width)):
        out += hashes[k : k + n] * factor
    return mix(out)
