"""Near-duplicate embeddings by counting collisions in many sorted one-dimensional projections.

Each of many tables sorts the vectors by a random projection; every vector is the centre of a window, and pairs are counted
that meet in a window. A window of one projection holds the same share of all vectors at any size, so its collisions would
grow with the square of their number. Each table therefore sorts by the signs of further random projections first, as many
as keep the vectors that share them few. The needed count, and the number of tables, follow from the probability that a
pair at the threshold meets in a table. Pairs with enough collisions are verified in double precision.

Equal vectors count as one. Large cells are dealt as pairs of blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paypulse.llm.components import components
from paypulse.llm.shared import cut, groups, shuffle_partitions

THRESHOLD = 0.95
#: Vectors that share the signs of a table, on average.
CELL = 16
#: Half a window, in standard deviations of the projected difference of a pair at the threshold.
REACH = 2.0
#: A pair is verified after so many collisions; there are enough tables for this share of the pairs at the threshold.
COLLISIONS, RECALL = 2, 0.999
#: Members of a cell that one task compares with each other.
BLOCK = 2048


def tables_for(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(sign projections of a table, tables) for a number of vectors."""
    signs = max(0, math.ceil(math.log2(max(1, vectors) / CELL)))
    meet = (1 - math.acos(threshold) / math.pi) ** signs * (2 * NormalDist().cdf(REACH) - 1)
    tables = COLLISIONS
    while sum(math.comb(tables, k) * meet**k * (1 - meet) ** (tables - k) for k in range(COLLISIONS)) > 1 - RECALL:
        tables += 1
    return signs, tables


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, units = [], []
        for value in batch.column(1):
            x = value.as_py() or ()
            x = np.array([np.nan if v is None else v for v in x], float) + 0.0  # no negative zeros
            largest = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(largest) or largest == 0:
                nodes.append(None)
                units.append(None)
                continue
            nodes.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
            x = x / largest
            units.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "node", "unit"]
        )


def _window_pairs(place: np.ndarray, node: np.ndarray, block: np.ndarray, across: bool, reach: float) -> Iterator[tuple]:
    """Pairs (smaller node, larger node) whose places differ by ``reach`` at most; with ``across`` of different blocks."""
    order = np.argsort(place, kind="stable")
    place, node, block = place[order], node[order], block[order]
    after = np.searchsorted(place, place + reach, side="right") - np.arange(len(place)) - 1
    for at in range(0, len(place), 256):
        counts = after[at : at + 256]
        first = np.repeat(np.arange(at, at + len(counts)), counts)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
        if across:
            apart = block[first] != block[second]
            first, second = first[apart], second[apart]
        if len(first):
            yield np.minimum(node[first], node[second]), np.maximum(node[first], node[second])


def _collisions(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs that meet often enough."""
    signs, tables = tables_for(nodes.count(), threshold)
    reach = REACH * math.sqrt(2 - 2 * threshold)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sizes = batch.column(0).to_numpy(), np.array([len(u) // 8 for u in batch.column(1).to_pylist()])
            for size in np.unique(sizes):  # vectors of other lengths never share a cell
                own = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(batch.column(1).take(pa.array(own)).to_pylist())).reshape(-1, size)
                random = np.random.default_rng(int(size))
                for table in range(tables):
                    places = x @ random.standard_normal((size, signs + 1))
                    code = (places[:, 1:] > 0) @ (1 << np.arange(signs, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), table * 1_000_003 + int(size))), pa.array(code.astype(np.int64)),
                         pa.array(places[:, 0]), pa.array(node[own])],
                        ["table", "code", "place", "node"],
                    )

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (*_, low, high), rows in groups(batches, 4):
            block, place, node = map(np.array, zip(*rows, strict=True))
            for pair in _window_pairs(place, node, block, low != high, reach):
                held.append(pair)
                if sum(len(a) for a, _ in held) > 50_000 or len(held) > 2000:
                    yield _pair_batch(held)
                    held = []
        if held:
            yield _pair_batch(held)

    cell = ["table", "code"]
    rows = cut(nodes.select("node", "unit").mapInArrow(project, "table long, code long, place double, node long"))
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, cell).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*cell, "low", "high"]
    rows = rows.select(*cell, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "place", "node")
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *group).sortWithinPartitions(*group)
    met = dealt.mapInArrow(collide, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= COLLISIONS).select("a", "b")


def _pair_batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            size = len(batch.column(2)[0].as_py())
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist())) for k in (2, 3))
            if len(x) * 8 == size * len(batch):
                cosine = np.einsum("ij,ij->i", x.reshape(len(batch), -1), y.reshape(len(batch), -1))
            else:  # several lengths in one batch
                cosine = np.array([np.frombuffer(a) @ np.frombuffer(b) for a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)])
            keep = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    units = nodes.select("node", "unit")
    columns = pairs.join(units.withColumnsRenamed({"node": "a", "unit": "x"}), "a").join(
        units.withColumnsRenamed({"node": "b", "unit": "y"}), "b"
    )
    return columns.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``threshold`` in double precision that enough projections show; nothing
    below it is linked. Vectors that are null, empty or zero or hold null or non-finite components are linked with
    nothing, and vectors of different lengths not with each other. Equal vectors are linked, repeated rows too. A null id
    is never the smallest of a component unless it has no other. An empty table gives an empty result; other columns are
    not read. n_links needs every link, so pairs are as many as links.
    """
    columns = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    rows = cut(columns.mapInArrow(_units, "vec_id long, node long, unit binary"))
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("unit").alias("unit"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")
    ))
    links = cut(_verified(_collisions(nodes, threshold), nodes, threshold))
    copies = nodes.select(F.col("node").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    grouped = nodes.drop("unit").join(components(links), "node", "left").join(degrees, "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    own = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    known = grouped.join(least, "component").select("node", own, "component_id")
    found = rows.select("vec_id", "node").join(known, "node", "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
