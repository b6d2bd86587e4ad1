"""Exact deduplication with counting quotient filters.

Texts are equal when identical after white space runs became one space. Each partition builds counting quotient filters
of its texts' 64-bit fingerprints: the leading bits choose a shard, the next ones (the quotient) a run, and the rest (the
remainder) is stored sorted in its run, with a count. Filters of a shard merge losslessly, so the merged count of every
fingerprint is exact. Texts of fingerprints with a count above one are compared byte by byte; the others are unique.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paypulse.llm.shared import SPACE, cut, keep_rows, shuffle_partitions

#: A shard of the merged filter holds about so many fingerprints at most.
SHARD_ROWS = 1 << 20
#: A task keeps at most so many fingerprints before it emits filters; a partition may emit several for a shard.
TASK_ROWS = 1 << 21


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def encode_filter(prints: np.ndarray, counts: np.ndarray, skip: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints that agree in their first ``skip`` bits.

    Layout: number of entries, quotient bits, shared leading bits; a bit for each quotient that occurs; a bit for each
    entry that ends its quotient's run; remainders; a bit for each entry with a count above one; those counts.
    """
    n = len(prints)
    quotient_bits = min(64 - skip, max(1, int(n - 1).bit_length()))
    rest = 64 - skip - quotient_bits
    below = prints & np.uint64((1 << (64 - skip)) - 1)
    quotients = (below >> np.uint64(rest)).astype(np.int64)
    remainders = below & np.uint64((1 << rest) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True)
    repeated = counts > 1
    width = -(-rest // 8)
    lead = int(prints[0]) >> (64 - skip) if skip else 0
    return b"".join((
        struct.pack("<IBBQ", n, quotient_bits, skip, lead),
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes(),
        np.packbits(repeated).tobytes(),
        counts[repeated].astype("<u8").tobytes(),
    ))


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter, and their counts."""
    n, quotient_bits, skip, lead = struct.unpack_from("<IBBQ", data)
    at = struct.calcsize("<IBBQ")

    def bits(size: int) -> np.ndarray:
        nonlocal at
        out = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool)
        at += -(-size // 8)
        return out

    occupied, ends = np.flatnonzero(bits(1 << quotient_bits)), bits(n)
    rest = 64 - skip - quotient_bits
    width = -(-rest // 8)
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    repeated = bits(n)
    counts = np.ones(n, np.uint64)
    counts[repeated] = np.frombuffer(data, "<u8", int(repeated.sum()), at)
    run = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64)
    high = (np.uint64(lead << quotient_bits) + occupied[run].astype(np.uint64)) << np.uint64(rest)
    return high | remainders.reshape(-1).view("<u8").astype(np.uint64), counts


def merge_entries(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of several sorted lists, with summed counts."""
    all_prints = np.concatenate(prints)
    order = np.argsort(all_prints, kind="stable")
    all_prints, all_counts = all_prints[order], np.concatenate(counts)[order]
    starts = np.flatnonzero(np.append(True, all_prints[1:] != all_prints[:-1]))
    return all_prints[starts], np.add.reduceat(all_counts, starts)


def _filters(prints: np.ndarray, shard_bits: int) -> Iterator[tuple[int, bytes]]:
    prints, counts = np.unique(prints, return_counts=True)
    shards = (prints >> np.uint64(64 - shard_bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(prints)), strict=True):
        yield int(shards[a]), encode_filter(prints[a:b], counts[a:b].astype(np.uint64), shard_bits)


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of all values that occur more than once in the bigint column ``fp``, found with merged filters."""
    spark = fingerprints.sparkSession
    partitions = shuffle_partitions(spark)
    shard_bits = max(1, (max(2 * partitions, -(-fingerprints.count() // SHARD_ROWS)) - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = list(_filters(np.concatenate(held), shard_bits))
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.int32()), pa.array([f for _, f in found], pa.binary())],
                ["shard", "filter"],
            )

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(batch)
            if size >= TASK_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            prints, counts = merge_entries(*zip(*entries, strict=True))
            again = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(prints[again].view(np.int64)), pa.array(counts[again].astype(np.int64))], ["fp", "n"]
            )

        shard, entries, size = None, [], 0
        for batch in batches:
            for next_shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if next_shard != shard and entries:
                    yield result()
                    entries, size = [], 0
                shard = next_shard
                entries.append(decode_filter(data.as_py()))
                size += len(entries[-1][0])
                if size > 4 * SHARD_ROWS:
                    entries = [merge_entries(*zip(*entries, strict=True))]
                    size = 0
        if entries:
            yield result()

    filters = fingerprints.select("fp").mapInArrow(build, "shard int, filter binary")
    return filters.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id among equal texts. A null text counts as empty; empty texts are equal to each other. A row
    that repeats an id counts in group_size and is kept or dropped like the other. A null id is never the smallest unless
    a group has no other. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    keys = cut(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")))
    several = keys.join(repeated_fingerprints(keys), "fp").select("doc_id", "fp").distinct().alias("s")
    same_row = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.fp") == F.col("s.fp"))
    classes = (
        texts.alias("t").join(several, same_row, "left_semi")
        .groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    found = keys.join(classes, "text_sha256", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: the one with the smallest doc_id.

    A row without doc_id stays only where no row with one has the text. Of rows that repeat both id and text one stays. Ids that
    rows with other texts share, null ones among them, are decided by row.
    """
    found = cut(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"))
    digest = F.sha2(normalised(F.col("text")), 256)
    return keep_rows(docs, found.select("doc_id", "kept", F.col("text_sha256").alias("text_key")), lambda rows: rows.withColumn("__key", digest))
