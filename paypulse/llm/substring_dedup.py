"""Removal of passages that repeat across documents, found by fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks of ``BLOCK`` words. A window of ``WINDOW`` = 2 *
``BLOCK`` - 1 words holds exactly one whole block of its document, so where a window repeats, a rolling run of the other
document equals that block. Three steps, each dealing what the last one left:

1. Probe: the hashes of all rolling runs, packed in a few bytes each and dealt by hash, meet the indexed blocks. A block
   that a run of another document equals is a hit of its document.
2. Extend: the windows that hold a hit are candidates for exact repeats. Dealt by the hash of all their words, they meet
   the smallest document that starts with the same.
3. Remove: the words that a document's windows cover which a smaller document has too: the maximal exact repeats.

The rows of a frequent passage are reduced where they meet and never paired with each other. The texts are dealt once, by
document, for the last two steps.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paypulse.llm.shared import groups, mix, rolling, shuffle_partitions, word_pieces

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: A task packs lists of about so many hashes at a time.
LIST_HASHES = 1 << 20
#: A shard gets about so many hashes at most, and a row of a task's own findings holds so many.
SHARD_HASHES, LOCAL_HASHES = 1 << 20, 1 << 16
#: In the first step a block may by chance equal a run that has other words, one in 2 to this power; the second is exact.
SPARE_BITS = 9
#: Bytes of a window's hash that find it in its own document again.
OWN_BYTES = 6
#: The id of rows without one: no document's is larger.
NO_ID = 2**63 - 1

_LISTS = "shard int, hashes binary"


def _encode(ids: np.ndarray, docs: np.ndarray, hashes: np.ndarray, flags: np.ndarray, skip: int, width: int) -> bytes:
    """A list: ids by runs of equal ones, ``width`` bytes of each hash after its first ``skip`` bits, and flags."""
    runs = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    keys = (hashes << np.uint64(skip)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join((
        struct.pack("<II", len(docs), len(runs)),
        ids[docs[runs]].astype("<i8").tobytes(),
        np.diff(np.append(runs, len(docs))).astype("<u4").tobytes(),
        keys.tobytes(),
        np.packbits(flags).tobytes(),
    ))


def _decode(shard: int, data: bytes, shard_bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, hashes (their lost bits 0) and flags of a list; a shard below 0 stands for none."""
    if shard < 0:
        shard, shard_bits, width = 0, 0, 8
    n, runs = struct.unpack_from("<II", data)
    ids = np.frombuffer(data, "<i8", runs, 8)
    counts = np.frombuffer(data, "<u4", runs, 8 + 8 * runs)
    at = 8 + 12 * runs
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    hashes = keys.reshape(-1).view(">u8").astype(np.uint64) >> np.uint64(shard_bits)
    flags = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + n * width), count=n).astype(bool)
    lead = np.uint64(shard << (64 - shard_bits)) if shard_bits else np.uint64(0)
    return np.repeat(ids, counts), hashes | lead, flags


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def _extremes(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest and the largest id that has its hash."""
    order = np.argsort(hashes, kind="stable")
    starts = _starts(hashes[order])
    sizes = np.diff(np.append(starts, len(order)))
    least, most = np.empty_like(ids), np.empty_like(ids)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), sizes) if len(ids) else ids
    most[order] = np.repeat(np.maximum.reduceat(ids[order], starts), sizes) if len(ids) else ids
    return least, most


class _Rule(NamedTuple):
    """Which entries are found, and which of a task's entries tell the other tasks all they need; both from ids, flags and
    the smallest and largest ids that have the hash."""

    found: Callable[..., np.ndarray]
    sent: Callable[..., np.ndarray]


#: A block is a hit where another document has it; a task sends the first and the last document of a hash.
HITS = _Rule(
    lambda ids, flags, least, most: flags & (least != most),
    lambda ids, flags, least, most: (ids == least) | (ids == most),
)
#: A window goes where a smaller document has it; a task sends the smallest one.
REPEATS = _Rule(lambda ids, flags, least, most: ids > least, lambda ids, flags, least, most: ids == least)


def _lists(held: list[tuple], rule: _Rule, shard_bits: int, width: int) -> pa.RecordBatch:
    """What a task knows of its documents: (shard, hashes) for the entries to be sent, dealt by the first bits of the hash,
    and with shards below 0 what it has found by itself. So a hash that very many documents share stays small."""
    ids, docs, hashes, flags = zip(*held, strict=True)
    offsets = np.cumsum([0, *map(len, ids)])
    docs = np.concatenate([d + o for d, o in zip(docs, offsets, strict=False)])
    ids, hashes, flags = np.concatenate(ids), np.concatenate(hashes), np.concatenate(flags)
    known = (ids[docs], flags, *_extremes(ids[docs], hashes))
    rows: list[tuple[int, bytes]] = []
    local = np.flatnonzero(rule.found(*known))
    for k, part in enumerate(np.array_split(local, -(-len(local) // LOCAL_HASHES)) if len(local) else ()):
        rows.append((-1 - (int(ids[docs[part[0]]]) + k) % (1 << shard_bits), _encode(ids, docs[part], hashes[part], flags[part], 0, 8)))
    sent = rule.sent(*known)
    docs, hashes, flags = docs[sent], hashes[sent], flags[sent]
    shards = (hashes >> np.uint64(64 - shard_bits)).astype(np.uint16 if shard_bits <= 16 else np.int64)
    order = np.argsort(shards, kind="stable")
    starts = _starts(shards[order])
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        own = order[a:b]
        rows.append((int(shards[own[0]]), _encode(ids, docs[own], hashes[own], flags[own], shard_bits, width)))
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "hashes"]
    )


def _by_shard(lists: DataFrame, partitions: int, shard_bits: int, width: int, rule: _Rule) -> DataFrame:
    """Deals lists by shard and gives back (doc_id, hashes): a row for each document that has any, with its found hashes
    cut to ``OWN_BYTES``. On the way back they are dealt in lists, too, by the documents' buckets."""

    def for_buckets(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        buckets = (mix(ids.astype(np.uint64)) >> np.uint64(64 - shard_bits)).astype(np.int64)
        order = np.lexsort((ids, buckets))
        ids, hashes, buckets = ids[order], hashes[order], buckets[order]
        starts, rows = _starts(buckets), []
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            own, places = np.unique(ids[a:b], return_inverse=True)
            rows.append(_encode(own, places, hashes[a:b], np.zeros(b - a, bool), 0, OWN_BYTES))
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts].astype(np.int32)), pa.array(rows, pa.binary())], ["shard", "hashes"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            ids, hashes, flags = (np.concatenate(x) for x in zip(*held, strict=True))
            chosen = rule.found(ids, flags, *_extremes(ids, hashes))
            return for_buckets(ids[chosen], hashes[chosen])

        shard, held = None, []
        for batch in batches:
            for next_shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries = _decode(next_shard, data.as_py(), shard_bits, width)
                if next_shard < 0:
                    yield for_buckets(*entries[:2])
                    continue
                if next_shard != shard and held:
                    yield result()
                    held = []
                shard = next_shard
                held.append(entries)
        if held:
            yield result()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 1):
            ids, hashes, _ = (np.concatenate(x) for x in zip(*(_decode(0, data, 0, OWN_BYTES) for (data,) in rows), strict=True))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            starts = _starts(ids)
            own = hashes[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :OWN_BYTES]
            found = [own[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(found, pa.binary())], ["doc_id", "hashes"])

    dealt = lists.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(find, _LISTS)
    back = dealt.repartition(partitions, "shard").sortWithinPartitions("shard")
    return back.mapInArrow(gather, "doc_id long, hashes binary")


def _own_hashes(found: pa.Scalar) -> np.ndarray:
    """The sorted distinct hashes, cut to ``OWN_BYTES``, of a document."""
    data = found.as_py() or b""
    keys = np.zeros((len(data) // OWN_BYTES, 8), np.uint8)
    keys[:, :OWN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, OWN_BYTES)
    return np.unique(keys.reshape(-1).view(">u8").astype(np.uint64))


def _cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    keep = max(0, 64 - min(bits, 8 * OWN_BYTES))
    return (hashes >> np.uint64(keep)) << np.uint64(keep)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a word goes if a window of ``WINDOW`` words covers it whose words also
    stand in a document with a smaller id. All windows are judged on the input. kept_text joins the kept words by one
    space. Windows are compared by 64-bit hashes of their words. Rows with the same id never take words from each other;
    rows without id lose to every other and are one document. Null and empty texts, and texts shorter than a window, lose
    nothing. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    words_about = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 5 + 2
    shard_bits = max(1, (max(partitions, words_about // SHARD_HASHES) - 1).bit_length())
    width = min(8, max(2, math.ceil((math.log2(words_about) + SPARE_BITS - shard_bits) / 8)))
    probe_bits = shard_bits + 8 * width

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, words in word_pieces(batch.column(1)):
                runs = rolling(words.hashes, BLOCK)
                counts = np.diff(words.first)
                doc = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
                place = np.arange(len(runs)) - words.first[doc]
                whole = place + BLOCK <= counts[doc]
                held.append((ids[row : row + len(counts)], doc[whole], runs[whole], (place % BLOCK == 0)[whole]))
                size += len(runs)
                if size >= LIST_HASHES:
                    yield _lists(held, HITS, shard_bits, width)
                    held, size = [], 0
        if held:
            yield _lists(held, HITS, shard_bits, width)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for row, words in word_pieces(batch.column(1)):
                runs, windows = rolling(words.hashes, BLOCK), rolling(words.hashes, WINDOW)
                for k in range(len(words.first) - 1):
                    a, b = words.first[k : k + 2]
                    if b - a < WINDOW:
                        continue
                    blocks = np.arange(a, b - BLOCK + 1, BLOCK)
                    hit = np.isin(_cut(runs[blocks], probe_bits), _cut(_own_hashes(lists[row + k]), probe_bits))
                    starts = (blocks[hit][:, None] - np.arange(BLOCK)).ravel()
                    starts = starts[(starts >= a) & (starts + WINDOW <= b)]
                    found = np.unique(windows[starts])
                    held.append((ids[row + k : row + k + 1], np.zeros(len(found), np.int64), found, np.zeros(len(found), bool)))
                    size += len(found)
                if size >= LIST_HASHES:
                    yield _lists(held, REPEATS, shard_bits, 8)
                    held, size = [], 0
        if held:
            yield _lists(held, REPEATS, shard_bits, 8)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, lists = batch.column(1), batch.column(2)
            n_words, n_removed, kept_texts, digests = [], [], [], []
            for row, words in word_pieces(texts_):
                windows = rolling(words.hashes, WINDOW)
                for k in range(len(words.first) - 1):
                    own = texts_[row + k].as_py().encode().split()
                    kept = own
                    if lists[row + k].is_valid and len(own) >= WINDOW:
                        a, b = words.first[k : k + 2]
                        hit = np.isin(_cut(windows[a : b - WINDOW + 1], 64), _own_hashes(lists[row + k]))
                        change = np.zeros(len(own) + 1, np.int64)
                        change[: len(hit)] += hit
                        change[WINDOW : WINDOW + len(hit)] -= hit
                        kept = [w for w, covered in zip(own, np.cumsum(change[:-1]).tolist(), strict=True) if not covered]
                    data = b" ".join(kept)
                    n_words.append(len(own))
                    n_removed.append(len(own) - len(kept))
                    kept_texts.append(data.decode())
                    digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    by_id = texts.repartition(partitions, "doc_id")
    hits = _by_shard(texts.mapInArrow(probe, _LISTS), partitions, shard_bits, width, HITS)
    around = by_id.join(hits, "doc_id").select("doc_id", "text", "hashes")
    repeats = _by_shard(around.mapInArrow(extend, _LISTS), partitions, shard_bits, 8, REPEATS)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = by_id.join(repeats, "doc_id", "left").select("doc_id", "text", "hashes").mapInArrow(remove, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
