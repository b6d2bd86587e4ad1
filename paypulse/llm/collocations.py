"""Phrases whose words go together, for each language, from exact counts of all frequent word sequences.

1. The texts are written once, dealt into chunks of bounded size.
2. Summaries: each chunk's word sequences of 1 to ``LONGEST`` words are hashed and counted, and its packed counts go to the
   hash partition (shard) of the sequence. There they are merged into one Misra-Gries summary, whose capacity exceeds the
   shard's mass divided by the threshold, so that every frequent sequence survives. Each chunk is told which of its sequences do.
3. Second pass: each chunk counts the surviving sequences exactly, by their words; the sums decide what is frequent.
4. Frequent phrases are scored by their weakest cut, and those that nearly always stand in a longer one are dropped.

Hashes only choose what is counted: a clash costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from paypulse.llm.shared import cut, join_sized, mix, ship_package, shuffle_partitions
from paypulse.session import shared_dir

LONGEST = 4
THRESHOLD = 30
TOP = 2000
#: A phrase goes where a longer one around it has so many hundredths of its occurrences or more.
INSIDE = 80
SCALE = 2_000_000
NO_LANG = "und"
#: Bytes of text in a chunk, which is what a task holds at a time; and sequences of a shard, estimated from the bytes.
CHUNK_BYTES, SHARD_SEQUENCES, WORD_BYTES = 4 << 20, 4 << 20, 6

_BLANK, _BREAK, _LETTER = 0, 1, 2
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR = np.uint64(0xD1342543DE82EF95)


# --- words of a chunk ----------------------------------------------------------

class Segment(NamedTuple):
    """The words of some bytes of text: number of each word's language and its own, pieces, and the names behind the numbers."""

    langs: np.ndarray
    words: np.ndarray
    pieces: np.ndarray
    lang_names: list[str]
    word_names: pa.Array


def _utf8(column: pa.Array, null: str) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), null)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(langs: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Segment]:
    """The words of whole texts, A-Z in lower case, in segments of about ``limit`` bytes that end where a piece ends."""
    data, offsets = _utf8(texts, "")
    coded = pc.fill_null(langs, NO_LANG).dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    begin = 0
    while begin < len(data):
        end = _cut_point(data, offsets, begin, begin + limit)
        rows = offsets[(offsets > begin) & (offsets < end)] - begin
        kind = _KIND[data[begin:end]]
        letter = kind == _LETTER
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        first[rows] = letter[rows]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        last[rows - 1] = letter[rows - 1]
        starts, lengths = np.flatnonzero(first), np.flatnonzero(last) + 1
        lengths -= starts
        if len(starts):
            breaks = kind == _BREAK
            ends = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.py_buffer(_LOWER[data[begin:end]][letter])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), values])
            words = words.dictionary_encode()
            row = np.searchsorted(offsets, starts + begin, side="right") - 1
            yield Segment(
                codes[row].astype(np.int64), words.indices.to_numpy().astype(np.int64),
                np.cumsum(breaks, dtype=np.int32)[starts] + row, names, words.dictionary,
            )
        begin = end


def _cut_point(data: np.ndarray, offsets: np.ndarray, begin: int, wanted: int) -> int:
    """A place at which a segment from ``begin`` may end: after a break or a text, at ``wanted`` at most if there is one."""
    if wanted >= len(data):
        return len(data)
    text = int(offsets[np.searchsorted(offsets, wanted, side="right") - 1])
    if text > begin:
        return text
    found = np.flatnonzero(_KIND[data[begin:wanted]] == _BREAK)
    if len(found):
        return begin + int(found[-1]) + 1
    end = int(offsets[np.searchsorted(offsets, wanted, side="left")])
    found = np.flatnonzero(_KIND[data[wanted:end]] == _BREAK)
    return wanted + int(found[0]) + 1 if len(found) else end


def _hashed(names: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


def sequence_keys(segment: Segment, longest: int, bits: int) -> list[np.ndarray]:
    """For each length, ``bits``-bit keys of all sequences of so many words, whether inside one piece or not."""
    words = _hashed(segment.word_names.to_pylist())[segment.words]
    hashes, keys = mix(words ^ _hashed(segment.lang_names)[segment.langs]), []
    for n in range(longest):
        if n:
            hashes = mix(hashes[:-1] * _FACTOR + words[n:])
        keys.append(hashes >> np.uint64(64 - bits))
    return keys


def _inside(segment: Segment, length: int) -> np.ndarray:
    """Which sequences of so many words lie in one piece."""
    pieces = segment.pieces
    return pieces[: max(0, len(pieces) - length + 1)] == pieces[length - 1 :]


# --- Misra-Gries summaries -----------------------------------------------------

class Summary:
    """A Misra-Gries summary of uint32 keys: counters, at most ``capacity``, that are at most ``error`` below the counts."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Adds other counters; of too many, all lose what the first one beyond the capacity has."""
        keys, counts = np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            lost = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > lost], counts[counts > lost] - lost
            self.error += lost
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """The keys whose count may reach ``threshold``: all that do are among them if the capacity exceeds mass / threshold."""
        return self.keys[self.counts + self.error >= threshold]


def _pack(keys: np.ndarray) -> bytes:
    """Sorted uint32 keys as their differences, bytes of the same weight together: the high ones are nearly all equal, so that
    Spark's compression of shuffled data halves them."""
    return np.diff(keys.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel(), dtype=np.uint32)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys with counts: those that occur once, the others, and the others' counts."""
    several = counts > 1
    return _pack(keys[~several]), _pack(keys[several]), counts[several].astype("<u4").tobytes()


def _unpacked(ones: bytes, more: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    single = _unpack(ones)
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    return np.concatenate([single, _unpack(more)]), np.concatenate([np.ones(len(single), np.int64), counts])


def surviving(lists: list[tuple[bytes, bytes, bytes]], threshold: int) -> np.ndarray:
    """Sorted keys of one shard's packed lists that the merged summary leaves as possibly frequent."""
    mass = sum(len(ones) // 4 + int(np.frombuffer(counts, "<u4").sum(dtype=np.int64)) for ones, _, counts in lists)
    summary, keys, counts, held = Summary(mass // threshold + 1), [], [], 0
    for one in lists:
        k, c = _unpacked(*one)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > max(4 * summary.capacity, 1 << 16):
            summary.merge(keys, counts)
            keys, counts, held = [], [], 0
    summary.merge(keys, counts)
    return np.sort(summary.at_least(threshold))


def _contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


# --- Spark jobs ----------------------------------------------------------------

def _chunked(docs: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    """(chunk, lang, text), written to the shared folder: rows of a partition share a chunk up to ``CHUNK_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunks = (held + np.cumsum(sizes) - sizes) // CHUNK_BYTES
            held += int(sizes.sum())
            ids = pa.array((partition << 32) + chunks, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *batch.columns], ["chunk", "bytes", "lang", "text"])

    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    path = shared_dir(docs.sparkSession, "chunks")
    rows.mapInArrow(run, "chunk long, bytes long, lang string, text string").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(chunk, langs, texts) of runs of rows (chunk, lang, text) with one chunk, of about ``limit`` bytes at most."""
    chunk, langs, texts, held = None, [], [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            if texts and (ids[a] != chunk or held > limit):
                yield chunk, pa.concat_arrays(langs), pa.concat_arrays(texts)
                langs, texts, held = [], [], 0
            chunk = int(ids[a])
            langs.append(batch.column(1).slice(a, b - a))
            texts.append(batch.column(2).slice(a, b - a))
            held += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
    if texts:
        yield chunk, pa.concat_arrays(langs), pa.concat_arrays(texts)


def _survivors(chunks: DataFrame, longest: int, threshold: int, shard_bits: int) -> DataFrame:
    """(chunk, shard, keys): for each chunk its sequences that may be frequent, as packed 32-bit keys within the shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, langs, texts in _gathered(batches, CHUNK_BYTES):
            for segment in segments(langs, texts):
                keys = sequence_keys(segment, longest, 32 + shard_bits)
                keys = np.concatenate([k[_inside(segment, n)] for n, k in enumerate(keys, 1)])
                keys.sort()
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                counts, keys = np.diff(np.append(first, len(keys))), keys[first]
                shards = (keys >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
                low = keys.astype(np.uint32)
                lists = [_packed(low[a:b], counts[a:b]) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[starts]), pa.array(np.full(len(starts), chunk)),
                     *(pa.array(x, pa.binary()) for x in zip(*lists, strict=True))], ["shard", "chunk", "ones", "more", "counts"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            keep = surviving([row[1:] for row in held], threshold)
            for chunk, *packed in held:
                keys = np.sort(_unpacked(*packed)[0])
                keys = keys[_contains(keep, keys)]
                if len(keys):
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "shard": shard, "keys": _pack(keys)}], schema)

        schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])
        shard, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard and held:
                    yield from found()
                    held = []
                shard = own
                held.append(tuple(row))
        if held:
            yield from found()

    lists = chunks.select("chunk", "lang", "text").mapInArrow(
        count, "shard long, chunk long, ones binary, more binary, counts binary"
    )
    dealt = lists.repartition(shuffle_partitions(chunks.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, "chunk long, shard long, keys binary")


def _counted(segment: Segment, keep: np.ndarray, longest: int, bits: int) -> Iterator[tuple[pa.Array, pa.Array, int, np.ndarray]]:
    """(langs, phrases, words, counts) of the sequences of ``segment`` whose keys are in ``keep``, counted by their words."""
    n_words = len(segment.word_names)
    names, lang_names = segment.word_names.cast(pa.string()), pa.array(segment.lang_names, pa.string())
    ids, chosen, before = segment.langs, None, np.ones(len(segment.words), bool)
    for n, keys in enumerate(sequence_keys(segment, longest, bits), 1):
        inside = _inside(segment, n)
        chosen = inside & before[: len(inside)]
        if n > 1:
            chosen &= before[1 : len(inside) + 1]
        chosen[chosen] = _contains(keep, keys[chosen])
        at = np.flatnonzero(chosen)
        if not len(at):
            return
        own, place, inverse, counts = np.unique(
            ids[at] * n_words + segment.words[at + n - 1], return_index=True, return_inverse=True, return_counts=True
        )
        ids = np.full(len(inside), -1)
        ids[at] = inverse
        at = at[place]
        parts = [names.take(pa.array(segment.words[at + k])) for k in range(n)]
        phrases = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        yield lang_names.take(pa.array(segment.langs[at])), phrases, n, counts
        before = chosen


def sequence_counts(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, lang_column: str = "lang", text_column: str = "text"
) -> DataFrame:
    """(lang, phrase, words, n) of all sequences of at most ``longest`` words that occur ``threshold`` times or more in a
    language, exactly counted; and for each language one row with a null phrase, words = 0 and n = all its words."""
    spark = docs.sparkSession
    ship_package(spark)
    chunks = _chunked(docs, lang_column, text_column)
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    shards = max(2 * shuffle_partitions(spark), longest * size // (WORD_BYTES * SHARD_SEQUENCES))
    shard_bits = max(1, int(shards - 1).bit_length())
    found = _survivors(chunks, longest, threshold, shard_bits)
    none = F.lit(None)
    dealt = found.select("chunk", "shard", "keys", none.cast("string").alias("lang"), none.cast("string").alias("text")).unionByName(
        chunks.select("chunk", F.lit(2**31).cast("long").alias("shard"), none.cast("binary").alias("keys"), "lang", "text")
    ).repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk", "shard")
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def texts(batches: Iterator[pa.RecordBatch], keep: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The rows that hold texts; the keys of the others are collected, by chunk."""
        for batch in batches:
            has_keys = batch.column(2).is_valid()
            for row in batch.filter(has_keys).select([0, 1, 2]).to_pylist():
                keys = _unpack(row["keys"]).astype(np.uint64) | np.uint64(row["shard"] << 32)
                keep.setdefault(row["chunk"], []).append(keys)
            yield batch.filter(pc.invert(has_keys)).select([0, 3, 4])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: dict[int, list[np.ndarray]] = {}
        for chunk, langs, rows in _gathered(texts(batches, keep), CHUNK_BYTES):
            for old in [c for c in keep if c < chunk]:
                del keep[old]
            own = keep.get(chunk) or [np.empty(0, np.uint64)]
            own = np.sort(np.concatenate(own))
            keep[chunk] = [own]
            for segment in segments(langs, rows):
                totals = np.bincount(segment.langs, minlength=len(segment.lang_names))
                used = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment.lang_names[k] for k in used], pa.string()), pa.nulls(len(used), pa.string()),
                     pa.array(np.zeros(len(used), np.int32)), pa.array(totals[used].astype(np.int64))], schema=schema,
                )
                for lang, phrases, words, counts in _counted(segment, own, longest, 32 + shard_bits):
                    yield pa.RecordBatch.from_arrays(
                        [lang, phrases, pa.array(np.full(len(counts), words, np.int32)), pa.array(counts.astype(np.int64))], schema=schema
                    )

    counted = dealt.mapInArrow(count, "lang string, phrase string, words int, n long")
    counted = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counted.where((F.col("words") == 0) | (F.col("n") >= threshold))


def _cuts(phrases: DataFrame) -> DataFrame:
    """Both parts of every cut of ``phrases`` (lang, phrase, words, a): (lang, phrase, a, k, is_left, part)."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left = F.expr("substring_index(phrase, ' ', k)")
    right = F.expr("substring_index(phrase, ' ', k - words)")
    both = F.explode(F.array(*(F.struct(F.lit(x).alias("is_left"), p.alias("part")) for x, p in ((True, left), (False, right)))))
    return cuts.select("lang", "phrase", "a", "k", both.alias("side")).select("lang", "phrase", "a", "k", "side.*")


def _inner(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, most): phrases of two words and more inside longer ones, with the largest count of such a longer one."""
    places = [(s, n) for n in range(2, longest) for s in range(1, longest - n + 2)]
    words = F.split("phrase", " ")
    inner = F.array(*(
        F.when((F.col("words") > n) & (F.col("words") >= s + n - 1), F.array_join(F.slice(words, s, n), " ")) for s, n in places
    ))
    found = phrases.where("words > 2").select("lang", F.col("a").alias("most"), F.explode(inner).alias("phrase"))
    return found.where("phrase is not null").groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(
    docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD, longest: int = LONGEST, lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. A phrase
    has 2 to ``longest`` words and occurs a >= ``threshold`` times inside pieces, overlaps included. l and r are the counts of
    its parts at the cut with the lowest score, floor(``SCALE`` * a / (l + r)), the first one of equal cuts; n counts all
    words of the language. A phrase goes where a longer one that holds it has ``INSIDE`` hundredths of its occurrences or
    more. Order: score and a downwards, phrase upwards by bytes. Counts are exact, and the score is computed in decimals.

    A null lang counts as ``und``, a null text as empty; empty texts have no words, and a language without frequent phrases no
    rows. Repeated rows count each time. Other columns are not read. Very long texts are cut where a piece ends; one piece
    has to fit into memory. An empty table gives an empty result.
    """
    counted = cut(sequence_counts(docs, threshold, longest, lang_column, text_column))
    phrases = counted.where("words > 1").withColumnRenamed("n", "a")
    cuts = cut(_cuts(phrases))
    sizes = cuts.groupBy("lang", "part").agg(F.count("*").alias("size"))
    parts = cut(sizes.join(counted.where("words > 0").select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]))
    known = join_sized(cuts, parts, ["lang", "part"], "size").groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("is_left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("n"))).alias("r"),
    )
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * {wide('a')} div ({wide('l')} + {wide('r')})")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = known.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    inner = _inner(phrases, longest)
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < INSIDE * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
