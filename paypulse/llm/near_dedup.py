"""Near-duplicate documents by SetSketch registers, with links confirmed on whole shingle sets.

A document is the set of its 5-word shingles. Register i of its sketch keeps the smallest of the set's exponential hash
values h_i in steps that grow by the factor ``BASE``, cut to 16 bits: floor(1 - log_BASE(min h_i)). Registers are mergeable
and equal in two sets with about the probability of their Jaccard similarity J. Bands of registers deal similar sets
into buckets; the numbers of larger, smaller and equal registers and the set sizes give the likelihood of J, and pairs for
which the threshold isn't too unlikely are verified on their texts.

Equal sets count as one. A bucket is not paired out: its members are first compared with its hub, the member that shares
most with others, and what then hangs together needs no more comparisons. Only members that are still apart are compared
with each other, in blocks of bounded size: likely pairs are verified in the task that finds them, as long as they are apart,
so no more links leave it than connect its members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from paypulse.llm.components import components
from paypulse.llm.shared import cut, groups, keep_rows, rolling, shuffle_partitions, word_pieces

SHINGLE = 5
#: Unless another threshold is given. In hundredths: links have 100 * intersection >= threshold * union.
THRESHOLD = 85
REGISTERS = 240
#: A pair at the threshold shares no band with this probability at most; bands and registers of a band, at most.
MISSED, MOST_BANDS, WIDEST = 8e-5, 24, 9
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: A pair is verified unless its best similarity is e to this power times likelier than the threshold.
DOUBT = 7.0
#: Members of a bucket that one task compares with each other; texts that one hub's group holds.
BLOCK, GROUP = 512, 64
#: A task keeps so many bytes of shingle sets of a group.
SET_BYTES = 64_000_000
NO_ID = 2**63 - 1

_RNG = np.random.default_rng(85)
_A, _B = (_RNG.integers(0, 2**31, REGISTERS).astype(np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_MIX = _RNG.integers(0, 2**62, (MOST_BANDS, WIDEST + 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_shape(threshold: int) -> tuple[int, int]:
    """Bands and registers of a band, as many as possible, so that a pair at the threshold is missed once in 12,500 times
    at most: (1 - (threshold / 100) ** width) ** bands. 20 bands of 6 at 85, 24 of 5 at 80."""
    if not 50 <= threshold <= 99:
        raise ValueError(f"threshold has to be 50 to 99 hundredths, not {threshold}")
    for width in range(WIDEST, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log(1 - (threshold / 100) ** width))
        if bands <= MOST_BANDS:
            break
    return bands, width


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles, A-Z as a-z; fewer words are one shingle."""
    for _, words in word_pieces(texts, lower=True):
        runs = rolling(words.hashes, SHINGLE)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(runs[a : b - SHINGLE + 1])
            else:
                yield rolling(words.hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.empty(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    high, low = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 1024):
        values = high[at : at + 1024, None] * _A + low[at : at + 1024, None] * _B
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            sizes.append(len(shingles))
            digests.append(_digest(shingles) if len(shingles) else None)
            sketches.append(registers(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
            ["doc_id", "n", "node", "sketch"],
        )


def _band_registers(sketches: np.ndarray, threshold: int) -> np.ndarray:
    bands, width = band_shape(threshold)
    return sketches[:, : bands * width].reshape(-1, bands, width)


def _band_keys(sketches: np.ndarray, threshold: int) -> np.ndarray:
    used = _band_registers(sketches, threshold).astype(np.uint64)
    bands, width = used.shape[1:]
    keys = (used * _MIX[:bands, :width]).sum(axis=2, dtype=np.uint64) ^ _MIX[:bands, WIDEST]
    return ((keys ^ (keys >> np.uint64(31))) * _MIX[0, 0]).view(np.int64)


def _rows(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u2").reshape(-1, REGISTERS)


def _bands(nodes: DataFrame, threshold: int) -> DataFrame:
    """(key, node) for each band of the sketches of ``nodes`` (node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _band_keys(_rows(batch.column(1).to_pylist()), threshold)
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), own], ["key", "node"])

    return nodes.mapInArrow(run, "key long, node binary")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """For pairs of sketches (rows of ``a`` and ``b``) and set sizes: whether the threshold isn't too unlikely."""
    total = n_a + n_b
    u, v = n_a / total, n_b / total
    largest = np.minimum(u / v, v / u)
    least = threshold / 100
    out = largest >= least - 1e-12
    equal = np.count_nonzero(a == b, axis=1)
    out &= equal >= REGISTERS * least - 5 * np.sqrt(REGISTERS * least * (1 - least))
    k = np.flatnonzero(out)
    if not len(k):
        return out
    larger = np.count_nonzero(a[k] > b[k], axis=1)
    equal = equal[k]
    smaller = REGISTERS - equal - larger

    def step(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)

    best, at_least = np.full(len(k), -np.inf), np.full(len(k), -np.inf)
    for j in (0.5, 0.6, 0.7, 0.75, 0.8, least, 0.88, 0.91, 0.94, 0.97, 1.0):
        j = np.minimum(j, largest[k])
        more, less = step(u[k] - v[k] * j), step(v[k] - u[k] * j)
        value = larger * np.log(more) + smaller * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-9))
        best = np.maximum(best, value)
        at_least = np.where(j >= least - 1e-12, np.maximum(at_least, value), at_least)
    out[k] = at_least >= best - DOUBT
    return out


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (hub, node) whose sketches make a link likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_rows(batch.column(k).to_pylist()) for k in (2, 4))
            sizes = (batch.column(k).to_numpy().astype(float) for k in (3, 5))
            keep = likely(a, b, *sizes, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["hub", "node"])

    own = nodes.select("node", "sketch", "n")
    hubs = own.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("n").alias("hub_n"))
    columns = pairs.join(own, "node").join(hubs, "hub").select("hub", "node", "hub_sketch", "hub_n", "sketch", "n")
    return columns.mapInArrow(run, "hub binary, node binary")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (hub, node) that are links, as (a, b); ``texts``: (node, text). A hub's text is sent once for each
    ``GROUP`` of its nodes, and read as one stream with theirs."""
    pairs = cut(pairs)
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("size"))
    group = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)).cast("int")
    tasks = cut(pairs.join(sizes, "hub").select("hub", group.alias("part"), "node"))
    rows = tasks.select("hub", "part", "node").unionByName(tasks.select("hub", "part", F.col("hub").alias("node")).distinct())
    rows = rows.join(texts, "node").select("hub", "part", (F.col("node") != F.col("hub")).alias("second"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, None
        for batch in batches:
            hubs, parts, seconds, nodes = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for hub, part, second, node, shingles in zip(
                hubs, parts, seconds, nodes, shingle_sets(batch.column(4)), strict=True
            ):
                if not second:
                    group, first = (hub, part), shingles
                elif group == (hub, part):
                    if _linked(first, shingles, threshold):
                        found.append((hub, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"]
            )

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "hub", "part")
    return dealt.sortWithinPartitions("hub", "part", "second").mapInArrow(run, "a binary, b binary")


def _block_links(key: int, across: bool, members: list[tuple], threshold: int) -> list[tuple[bytes, bytes]]:
    """Links that connect components among the members (block, node, n, component, sketch, text) of one bucket; with
    ``across`` only links between blocks. Likely pairs are verified, the likeliest first, unless earlier ones connect them."""
    block, node, n, component, sketch, text = zip(*members, strict=True)
    sketch, block, n = _rows(sketch), np.array(block), np.array(n, float)
    _, component = np.unique(np.array(component, dtype="S16"), return_inverse=True)
    bands = _band_registers(sketch, threshold)
    own_band = int(np.flatnonzero(_band_keys(sketch[:1], threshold)[0] == key)[0])
    firsts, seconds = [], []
    for k in range(len(node) - 1):
        apart = component[k + 1 :] != component[k]
        if across:
            apart &= block[k + 1 :] != block[k]
        rest = np.flatnonzero(apart) + k + 1
        rest = rest[100 * np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k])]
        # An earlier band that the two share has the pair already.
        rest = rest[~(bands[rest, :own_band] == bands[k, :own_band]).all(axis=2).any(axis=1)]
        if len(rest):
            own = np.broadcast_to(sketch[k], (len(rest), REGISTERS))
            rest = rest[likely(own, sketch[rest], np.full(len(rest), n[k]), n[rest], threshold)]
            firsts.append(np.full(len(rest), k))
            seconds.append(rest)
    if not firsts:
        return []
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    order = np.argsort(-np.concatenate([np.count_nonzero(sketch[s] == sketch[f[0]], axis=1) if len(f) else f for f, s in zip(firsts, seconds, strict=True)]), kind="stable")
    label, sets, held, out = list(range(component.max() + 1)), {}, 0, []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in zip(first[order].tolist(), second[order].tolist(), strict=True):
        x, y = root(component[a]), root(component[b])
        if x == y:
            continue
        for k in (a, b):
            if k not in sets:
                if held > SET_BYTES:
                    sets, held = {}, 0
                sets[k] = next(shingle_sets(pa.array([text[k]])))
                held += sets[k].nbytes
        own, other = (sets[k] if k in sets else next(shingle_sets(pa.array([text[k]]))) for k in (a, b))
        if _linked(own, other, threshold):
            label[x] = y
            out.append((node[a], node[b]))
    return out


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def _apart(members: DataFrame, linked: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) among members (key, node) of one bucket that ``linked`` (node, component) leaves apart; as many as
    connect them. A bucket's members are dealt into blocks, and each pair of blocks is one group, of bounded size."""
    own = nodes.select("node", "sketch", "n").join(linked, "node", "left")
    own = own.select("node", "n", F.coalesce("component", "node").alias("component"), "sketch")
    several = members.join(own.select("node", "component"), "node").groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")
    ).where("least <> most").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(several, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, low, high), group in groups(batches, 3):
            found = _block_links(key, low != high, group, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = rows.join(own.join(texts, "node"), "node")
    dealt = dealt.select("key", "low", "high", "block", "node", "n", "component", "sketch", "text").repartition(
        shuffle_partitions(rows.sparkSession), "key", "low", "high"
    )
    return dealt.sortWithinPartitions("key", "low", "high").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets are linked whose Jaccard similarity is ``threshold`` hundredths or more, 50 to 99.
    component_id is the smallest id that links lead to, its own included. Null and empty texts have no shingles and are
    linked with nothing; equal sets are linked with each other, repeated rows too. Rows without id come after all others
    and get a null component unless they are linked with one. An empty table gives an empty result. Other columns are not
    read.
    """
    found = _decided(docs, id_column, text_column, threshold)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component_id").alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def _decided(docs: DataFrame, id_column: str, text_column: str, threshold: int) -> DataFrame:
    """For each row its doc_id (``NO_ID`` for null), n, node, and of its component: component_id and the smallest node with it."""
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_column).alias("text")
    )
    sets = cut(texts.mapInArrow(_sketches, "doc_id long, n long, node binary, sketch binary"))
    first = F.min(F.struct("doc_id", "n", "sketch")).alias("first")
    nodes = cut(sets.where("n > 0").groupBy("node").agg(first).select("node", "first.*"))

    bands = _bands(nodes.select("node", "sketch"), threshold)
    buckets = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(buckets, "key"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "node")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    members = members.select("key", "node")
    star = members.join(hubs, "key").where("hub <> node").select("hub", "node").distinct()

    own_text = cut(_texts_of(members.select("node").distinct(), nodes, sets, texts))
    links = cut(_verified(_likely_pairs(star, nodes, threshold), own_text, threshold))
    linked = components(links)
    further = cut(_apart(members, linked, nodes, own_text, threshold))
    if not further.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further))

    grouped = nodes.select("node", "doc_id").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    of_node = grouped.join(least, "component").select(
        "node", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("first_node")
    )
    found = sets.select("doc_id", "n", "node").join(of_node, "node", "left")
    return found.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _texts_of(wanted: DataFrame, nodes: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) for each of the ``wanted`` nodes: a text whose set is the node's.

    An id that one row has finds its text. Rows that share an id, those without one among them, are found by their sets, and
    only one text of each set goes on.
    """
    ids = cut(wanted.join(nodes.select("node", "doc_id"), "node"))
    shared = cut(sets.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    found = texts.join(ids.join(shared, "doc_id", "left_anti"), "doc_id").select("node", "text")
    if shared.isEmpty():
        return found
    by_set = _with_node(texts.join(shared, "doc_id", "left_semi").select("text")).where("__key is not null")
    by_set = by_set.groupBy(F.col("__key").alias("node")).agg(F.first("text").alias("text"))
    return found.unionByName(by_set.join(ids.join(shared, "doc_id", "left_semi").select("node"), "node", "left_semi"))


def _with_node(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__key``: the digest of their shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(x) if len(x) else None for x in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "__key"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__key", T.BinaryType())]))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group that links connect, with all its columns: the one with the smallest doc_id.

    Texts without words are linked with nothing and stay. Rows without doc_id come after all others. Where rows of one
    group share its smallest id, or have none, one of them stays. Ids that several rows have are decided by row.
    """
    found = cut(_decided(docs, "doc_id", "text", threshold))
    first = (F.col("doc_id") == F.col("component_id")) & F.coalesce(F.col("node") == F.col("first_node"), F.lit(True))
    decided = found.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), first.alias("kept"), F.col("node").alias("text_key")
    )
    return keep_rows(docs, decided, _with_node)
