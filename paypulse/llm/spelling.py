"""Spelling variants of the words of a corpus: each word's near words, the form it most likely stands for, and its root.

Words are arranged in a frequency-vector trie: a word's letters are counted by groups, and the trie branches by the count of
one group after the other. One inserted, deleted or replaced letter changes the counts by a surplus of one, a deficit of one or
both, so a search spends a budget of one each on its way down, and verifies the words of the leaves that it reaches.

Spark holds the top of the trie: words and searches go down level by level in joins until a branch has at most ``SHARD_WORDS``
words. That branch is a shard, which a task searches depth-first, all its searches together. Words with the same vector that are
too many for a shard are parted further by half of their letters. A branch that very many searches reach is copied.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paypulse.llm.shared import cut, join_sized, ship_package, shuffle_partitions

MIN_LETTERS, MIN_COUNT = 5, 3
#: A form is so many times as frequent as its variant at least.
FORM_RATIO = 2
#: The levels of the trie; all other letters make up the last one.
LEVELS = ("e", "n", "t", "a", "i", "r", "s", "o", "hl", "du", "cmg", "")
#: Levels at which the top of the trie may end.
DEPTHS = (4, 8, len(LEVELS))
#: Words of a shard, searches of each of them that go to one copy of a shard, and words counted in a task before they are sent on.
SHARD_WORDS, SHARD_SEARCHES, TASK_WORDS = 1 << 14, 8, 1 << 19
#: Searches that go down together, words of a branch that are compared without going further down, pairs compared at a time.
BLOCK, LEAF_WORDS, PAIRS = 1 << 14, 16, 1 << 18
#: One run in so many loses a letter where misspellings are planted.
CHANGED = 97

_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % MIN_LETTERS)
_LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))
_LEVEL = np.full(256, len(LEVELS) - 1)
for _k, _letters in enumerate(LEVELS):
    _LEVEL[[ord(x) for x in _letters]] = _k
#: Letters of a word, from either end, that are compared in numpy.
WIDTH = 40
_OWN, _COPY, _VISITOR = 0, 1, 2
_POWER = np.uint64(0xD1342543DE82EF95)


# --- counting words --------------------------------------------------------------

def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = False) -> DataFrame:
    """(word, n) of all words of ``MIN_LETTERS`` and more that occur ``MIN_COUNT`` times: maximal runs of A-Z, a-z and U+00C0 to
    U+00FF, A-Z in lower case. With ``plant`` some runs lose a letter first, as planted misspellings: those whose crc32 of
    ``<doc_id>:<run>`` is divisible by ``CHANGED``. A null text has no words, a null id counts as empty."""

    def flush(counts: Counter) -> pa.RecordBatch:
        rows = [x for x in counts.items() if len(x[0]) >= MIN_LETTERS]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                own = Counter(_RUN.findall(text.as_py().translate(_LOWER).decode())) if text.is_valid else {}
                if plant:
                    before = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                    for word in list(own):
                        h = zlib.crc32(word.encode(), before)
                        if not h % CHANGED:
                            at = h % len(word)
                            n = own.pop(word)
                            counts[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > TASK_WORDS:
                    yield flush(counts)
        yield flush(counts)

    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


# --- vectors, the trie and its search ----------------------------------------------

class Letters:
    """The letters of some words one after the other, with the word and the place of each; ``starts`` has an entry more."""

    def __init__(self, words: list[str]):
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(self.letters)) - self.starts[self.word]

    def vectors(self) -> np.ndarray:
        """For each word the counts of its letters by level."""
        n, levels = len(self.lengths), len(LEVELS)
        return np.bincount(self.word * levels + _LEVEL[self.letters], minlength=n * levels).reshape(n, levels).astype(np.int32)

    def halves(self) -> np.ndarray:
        """Hashes of what two near words may share: (word; as the shorter one or one of two equally long ones, as the longer one;
        first, last letters). Two near words, the shorter one of m letters, share their first or their last m // 2 letters."""
        powers = np.full(int(self.lengths.max(initial=0)) + 1, _POWER, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        value = self.letters.astype(np.uint64) + np.uint64(1)
        from_start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[self.place])])
        from_end = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[self.lengths[self.word] - 1 - self.place])])
        first, last = self.starts[:-1], self.starts[1:]
        out = np.empty((len(self.lengths), 2, 2), np.uint64)
        for k, half in enumerate((self.lengths // 2, (self.lengths - 1) // 2)):
            out[:, k, 0] = from_start[first + half] - from_start[first]
            out[:, k, 1] = from_end[last] - from_end[last - half]
        return out

    def aligned(self, from_end: bool) -> np.ndarray:
        """The first, or backwards the last, ``WIDTH`` letters of each word."""
        place = self.lengths[self.word] - 1 - self.place if from_end else self.place
        out, near_by = np.zeros((len(self.lengths), WIDTH), np.uint8), place < WIDTH
        out[self.word[near_by], place[near_by]] = self.letters[near_by]
        return out


def vectors(words: list[str]) -> np.ndarray:
    return Letters(words).vectors()


def near(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of the common prefix
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


class Words:
    """Words in the order of their vectors, with what it takes to compare them."""

    def __init__(self, words: list[str], n: list[int]):
        letters = Letters(words)
        self.vectors = letters.vectors()
        order = np.lexsort(self.vectors.T[::-1])
        self.vectors, self.halves = self.vectors[order], letters.halves()[order]
        self.left, self.right = letters.aligned(False)[order], letters.aligned(True)[order]
        self.words, self.n = [words[k] for k in order], np.array(n, np.int64)[order]
        self.lengths = letters.lengths[order]


def are_near(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """``near`` of the different words i of ``a`` and j of ``b``, whose lengths differ by one at most: common first and last
    letters make up the shorter one, but for one letter where both are equally long."""
    shorter = np.minimum(a.lengths[i], b.lengths[j])

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        other = x[i] != y[j]
        return np.minimum(np.where(other.any(1), other.argmax(1), WIDTH), shorter)

    out = common(a.left, b.left) + common(a.right, b.right) >= shorter - (a.lengths[i] == b.lengths[j])
    for k in np.flatnonzero(shorter >= WIDTH):
        out[k] = near(a.words[i[k]], b.words[j[k]])
    return out


def search(trie: Words, asked: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ``asked``, of ``trie``) whose vectors differ by a surplus of one and a deficit of one at most.

    All of ``asked`` goes down the trie together, depth-first; ``who`` holds those that reach a branch with what is left of their
    budgets. A branch is a run of the sorted vectors.
    """

    def walk(low: int, high: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        if high - low <= LEAF_WORDS or level == len(LEVELS):
            step = max(1, PAIRS // (high - low))
            for k in range(0, len(who), step):
                own = who[k : k + step]
                rest = trie.vectors[None, low:high, level:] - asked.vectors[own, None, level:]
                fits = np.maximum(rest, 0).sum(2) <= surplus[k : k + step, None]
                fits &= np.maximum(-rest, 0).sum(2) <= deficit[k : k + step, None]
                i, j = np.nonzero(fits)
                yield own[i], j + low
            return
        column = trie.vectors[low:high, level]
        starts = np.flatnonzero(np.append(True, column[1:] != column[:-1])) + low
        for a, b in zip(starts, np.append(starts[1:], high), strict=True):
            more = trie.vectors[a, level] - asked.vectors[who, level]
            on = (more <= surplus) & (-more <= deficit)
            if on.any():
                more = more[on]
                yield from walk(a, b, level + 1, who[on], surplus[on] - np.maximum(more, 0), deficit[on] - np.maximum(-more, 0))

    if len(trie.words) and len(asked.words):
        budget = np.ones(len(asked.words), np.int32)
        yield from walk(0, len(trie.words), 0, np.arange(len(asked.words)), budget, budget)


def near_pairs(trie: Words, asked: Words, same: bool, half: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The verified pairs of ``search``; each once if both are the ``same`` words.

    Where a shard holds the words with one first (``kind`` f) or last (l) ``half``, a pair that shares both is left to the first.
    """
    for i, j in search(trie, asked):
        if same:
            i, j = i[i < j], j[i < j]
        longer = (asked.lengths[i] > trie.lengths[j]).astype(int), (asked.lengths[i] < trie.lengths[j]).astype(int)
        likely = (asked.halves[i, longer[0]] == trie.halves[j, longer[1]]).any(1)
        i, j = i[likely], j[likely]
        found = are_near(asked, i, trie, j)
        if kind:
            found[found] = [
                (asked.words[a][:half] == trie.words[b][:half]) == (kind == "f") for a, b in zip(i[found], j[found], strict=True)
            ]
        yield i[found], j[found]


class _Best:
    """For each word how many near ones were found, and the most frequent of them, the first in order among equals."""

    def __init__(self, words: Words):
        self.own, self.found = words, np.zeros(len(words.words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, own: np.ndarray, other: np.ndarray, others: Words) -> None:
        np.add.at(self.found, own, 1)
        for k, x in zip(own.tolist(), other.tolist(), strict=True):
            one = (-int(others.n[x]), others.words[x])
            if k not in self.best or one < self.best[k]:
                self.best[k] = one

    def rows(self) -> pa.RecordBatch:
        keys = list(self.best)
        return pa.RecordBatch.from_arrays([
            pa.array([self.own.words[k] for k in keys], pa.string()), pa.array(self.found[keys]),
            pa.array([-self.best[k][0] for k in keys], pa.int64()), pa.array([self.best[k][1] for k in keys], pa.string()),
        ], ["word", "n_near", "best_n", "best"])


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial results of rows (shard, role, half, kind, word, n) in order: a shard's words first, then its visitors."""

    def visit() -> Iterator[pa.RecordBatch]:
        asked = Words(*zip(*visitors, strict=True))
        theirs = _Best(asked)
        for i, j in near_pairs(trie, asked, False, half, kind):
            theirs.add(i, j, trie)
            ours.add(j, i, asked)
        yield theirs.rows()

    def build() -> tuple[Words, _Best]:
        words = Words(*zip(*members, strict=True)) if members else Words([], [])
        best = _Best(words)
        if role_of_members == _OWN:
            for i, j in near_pairs(words, words, True, half, kind):
                best.add(i, j, words)
                best.add(j, i, words)
        return words, best

    shard, members, visitors, trie, ours, half, kind, role_of_members = None, [], [], None, None, 0, "", _OWN
    for batch in batches:
        for own, role, row_half, row_kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != shard:
                if shard is not None:
                    if trie is None:
                        trie, ours = build()
                    if visitors:
                        yield from visit()
                    yield ours.rows()
                shard, members, visitors, trie, half, kind, role_of_members = own, [], [], None, row_half, row_kind, role
            if role == _VISITOR:
                if trie is None:
                    trie, ours = build()
                visitors.append((word, n))
                if len(visitors) >= BLOCK:
                    yield from visit()
                    visitors = []
            else:
                members.append((word, n))
    if shard is not None:
        if trie is None:
            trie, ours = build()
        if visitors:
            yield from visit()
        yield ours.rows()


# --- the top of the trie -------------------------------------------------------------

def _keys(prefixes: np.ndarray) -> pa.Array:
    """Rows of counts as binary keys."""
    rows, width = prefixes.shape
    data = prefixes.astype(">u4").tobytes()
    offsets = np.arange(rows + 1, dtype=np.int32) * (4 * width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _deeper(depth: int, to: int):
    """A step down: searches (word, n, target) at ``depth`` go on to all targets at depth ``to`` that their budgets reach.

    Of two words the one with the smaller vector searches for the other, so targets below the own vector are left out.
    """
    steps = [d for d in product((0, 1, -1), repeat=to - depth) if d.count(1) <= 1 and d.count(-1) <= 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(batch.column(0).to_pylist())
            target = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").astype(np.int64).reshape(len(own), depth)
            spent = target - own[:, :depth]
            surplus, deficit, at_own = (spent == 1).sum(1), (spent == -1).sum(1), ~spent.any(1)
            for step in steps:
                further = own[:, depth:to] + np.array(step)
                on = (further >= 0).all(1) & (surplus + step.count(1) <= 1) & (deficit + step.count(-1) <= 1)
                on &= ~at_own | (step >= (0,) * len(step))
                rows = np.flatnonzero(on)
                if len(rows):
                    keys = _keys(np.concatenate([target[rows], further[rows]], axis=1))
                    is_own = pa.array(at_own[rows] & (not any(step)))
                    taken = batch.select([0, 1]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, keys, is_own], ["word", "n", "target", "own"])

    return run


def _shards(vocabulary: DataFrame) -> DataFrame:
    """(shard, role, half, kind, word, n): the words of each shard, and those that search it from outside."""
    columns = ("word", "n", "target", "own")
    searches, depth, parts = vocabulary.select("word", "n", F.lit(b"").alias("target")), 0, []
    for to in DEPTHS:
        searches = cut(searches.select("word", "n", "target").mapInArrow(_deeper(depth, to), "word string, n long, target binary, own boolean"))
        reached = searches.groupBy("target").agg(F.count("*").alias("searches"), F.count_if("own").alias("size")).where("size > 0")
        met = cut(join_sized(searches, cut(reached), ["target"], "searches").where("size is not null"))
        fits = met.where(F.col("size") <= SHARD_WORDS)
        copies = F.ceil(F.col("searches") / (SHARD_WORDS * SHARD_SEARCHES)).cast("int")
        copy = F.when(F.col("own"), F.sequence(F.lit(0), copies - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), copies).cast("int")))
        fits = fits.withColumn("copy", F.explode(copy))
        role = F.when(~F.col("own"), _VISITOR).when(F.col("copy") == 0, _OWN).otherwise(_COPY)
        shard = F.concat(F.col("target"), F.encode(F.col("copy").cast("string"), "UTF-8"))
        parts.append(fits.select(shard.alias("shard"), role.alias("role"), F.lit(0).alias("half"), F.lit("").alias("kind"), "word", "n"))
        searches, depth = met.where(F.col("size") > SHARD_WORDS).select(*columns), to
        if searches.isEmpty():
            break
    else:
        parts.append(_by_halves(searches))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_halves(searches: DataFrame) -> DataFrame:
    """Shards of the words of one vector with the same first (kind f) or last (l) half of their letters.

    What two near words share is half of the shorter one, so the words of a vector stand under half of their own length and
    under half of a length less by one, and a search under the one that both have.
    """
    total = sum(F.conv(F.hex(F.substring("target", 4 * k + 1, 4)), 16, 10).cast("int") for k in range(len(LEVELS)))
    size = F.length("word")
    own = F.array_distinct(F.array((size / 2).cast("int"), ((size - 1) / 2).cast("int")))
    half = F.when(F.col("own"), own).otherwise(F.array((F.least(size, total) / 2).cast("int")))
    rows = searches.withColumn("half", F.explode(half)).withColumn("kind", F.explode(F.array(F.lit("f"), F.lit("l"))))
    letters = F.when(F.col("kind") == "f", F.expr("substring(word, 1, half)")).otherwise(F.expr("right(word, half)"))
    role = F.when(~F.col("own"), _VISITOR).when(F.col("half") == (size / 2).cast("int"), _OWN).otherwise(_COPY)
    name = F.encode(F.concat_ws(":", "kind", "half", F.xxhash64(letters)), "UTF-8")
    return rows.select(F.concat("target", name).alias("shard"), role.alias("role"), "half", "kind", "word", "n")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of all words of ``vocabulary`` (word, n; words distinct) that have near ones."""
    ship_package(vocabulary.sparkSession)
    rows = _shards(vocabulary).repartition(shuffle_partitions(vocabulary.sparkSession), "shard").sortWithinPartitions("shard", "role")
    found = rows.mapInArrow(_search_shards, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("first")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of the forms that follow. Each round doubles how far is known."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        pointing = links.groupBy("root").agg(F.count("*").alias("n"))
        further = cut(links.select(F.col("word").alias("root"), F.col("root").alias("next")).join(pointing, "root"))
        if further.isEmpty():
            return links
        links = cut(join_sized(links, further, ["root"], "n").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(vocabulary: DataFrame) -> DataFrame:
    """A row for each word of ``vocabulary`` (word, n; words distinct, of letters up to U+00FF): word, form, root, n, n_near, form_n.

    Words are near that differ by exactly one inserted, deleted or replaced letter; n_near counts a word's. Its form is the near
    word of largest n, the first by code points among equals, if that n is ``FORM_RATIO`` times its own or more, else null; form_n is
    its n. The root is the last of the forms that follow one another, and the word itself without one. Words of any length are
    compared whole. An empty vocabulary gives an empty result.
    """
    vocabulary = cut(vocabulary.select("word", "n"))
    known = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    known = cut(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    roots = _roots(known.where(F.col("form").isNotNull()).select("word", "form"))
    found = known.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = False) -> DataFrame:
    """``spelling_variants`` of the words of whole texts, see ``word_counts``. Repeated rows count each time; other columns are
    not read; texts without words and empty tables have no rows."""
    ship_package(docs.sparkSession)
    return spelling_variants(word_counts(docs, id_column, text_column, plant))
