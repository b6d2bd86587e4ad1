"""Order-preserving packing of token streams into sequences.

The documents of a partition, in the order they are read, form one stream of token ids, each document followed by an end
id. A dynamic programme cuts it into windows of at most ``length`` tokens at document ends and sentence ends, or for a higher
price inside long sentences, minimising padding plus the penalties of cuts inside documents; a monotone queue finds each
step's best predecessor, so its time is linear in the number of possible cuts. Nothing is shuffled: partitions are packed by themselves.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LENGTH = 2048
END_ID = 1
#: In tokens of padding: what a cut at a sentence end costs, and one inside a sentence.
SENTENCE_PENALTY, BREAK_PENALTY = 8, 24
#: Longer sentences may be broken at every so many of their tokens.
BREAK_TOKENS = 32
#: Documents are cut together until they hold so many tokens; only a partition's last window may need much padding.
BLOCK_TOKENS = 1 << 21
#: Ids are kept for so many words of a worker; beyond that the memory is cleared and filled anew.
CACHED_WORDS = 1 << 19

_PLAIN = re.compile(rb"([a-z]+)([.,]?)")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, padded long"
)


class WordIds(dict):
    """Ids of white-space separated words as little-endian 32-bit bytes; words never share a token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_sentence[[i for t, i in vocabulary.items() if re.search(r"[.!?](</w>)?$", t)]] = True

    def ids(self, word: bytes) -> list[int]:
        if plain := _PLAIN.fullmatch(word):
            # A run of plain letters is one piece for the model, a full stop or comma the next.
            out = [t.id for t in self.model.tokenize(plain[1].decode())]
            return out + [t.id for t in self.model.tokenize(plain[2].decode())] if plain[2] else out
        return self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids

    def __missing__(self, word: bytes) -> bytes:
        out = array("I", self.ids(word)).tobytes()
        if len(word) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" not in data:  # names of special tokens keep their case
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_windows(cuts: np.ndarray, penalties: np.ndarray, length: int) -> np.ndarray:
    """The chosen ones of the increasing positions ``cuts`` (0 first, the end last), gaps at most ``length``.

    Minimises, over all choices with windows of at most ``length``, the sum of padding and of the penalties of the
    chosen cuts: best(j) = penalty(j) + length - cut(j) + min(best(i) + cut(i)) over the i in reach.
    """
    places, costs = cuts.tolist(), penalties.tolist()
    previous = [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, places[0], 0)])  # best(i) + cut(i), cut(i), i; increasing
    for j in range(1, len(places)):
        place = places[j]
        while queue[0][1] < place - length:
            queue.popleft()
        least, _, previous[j] = queue[0]
        value = costs[j] + length + least
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place, j))
    chosen = [len(places) - 1]
    while chosen[-1]:
        chosen.append(previous[chosen[-1]])
    return cuts[np.array(chosen[::-1])]


def possible_cuts(
    ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``ids`` may be cut, with penalties: document ends, sentence ends, breaks in longer sentences."""
    kinds = np.full(len(ids) + 1, -1, np.int8)
    kinds[0] = 0
    kinds[1:][ends_sentence[ids]] = SENTENCE_PENALTY
    kinds[ends] = 0
    cuts = np.flatnonzero(kinds >= 0)
    step = min(BREAK_TOKENS, length)
    more = (np.diff(cuts) - 1) // step
    place = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    kinds[np.repeat(cuts[:-1], more) + place * step] = BREAK_PENALTY
    cuts = np.flatnonzero(kinds >= 0)
    return cuts, kinds[cuts].astype(np.int64)


def _tail(start: int, end: int, length: int) -> list[int]:
    """Cuts of a last, short window into lengths that are powers of two, where that costs less than its padding."""
    rest = end - start
    if length - rest <= (rest.bit_count() - 1) * BREAK_PENALTY:
        return []
    out = []
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            start += 1 << k
            out.append(start)
    return out[:-1]


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each piece of a document: its place in the document and in its sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and padded, the padded length of its
    sequence (its own length where that is a power of two, else ``length``). Documents are packed in the order they are
    read, each partition by itself, and a sequence id holds the partition's number. A null or empty text is the end id
    alone. Repeated rows are packed as often as they come; a null id is carried. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        end = array("I", [END_ID]).tobytes()
        sequence = TaskContext.get().partitionId() << 33

        def flush(last: bool) -> pa.RecordBatch | None:
            """Packs what is held; but for the last time, the last window's documents are held on where they begin in it."""
            nonlocal sequence, held, carried
            sizes = np.array([len(data) // 4 for _, data, _ in held], np.int64)
            ends = np.cumsum(sizes)
            buffer = b"".join(data for _, data, _ in held)
            ids = np.frombuffer(buffer, "<u4")
            cuts, penalties = possible_cuts(ids, ends, words.ends_sentence, length)
            chosen = cut_windows(cuts, penalties, length)
            if last and chosen[-1] - chosen[-2] < length:
                chosen = np.concatenate((chosen[:-1], _tail(int(chosen[-2]), int(chosen[-1]), length), chosen[-1:]))
            chosen = chosen.astype(np.int64)
            stop = chosen[-1] if last else chosen[-2]
            if not last:
                chosen = chosen[:-1]
            marks = np.unique(np.concatenate((chosen, ends[ends < stop])))
            a, b = marks[:-1], marks[1:]
            doc = np.searchsorted(ends, a, side="right")
            window = np.searchsorted(chosen, a, side="right") - 1
            sizes_of = np.diff(chosen)[window]
            origin = np.concatenate(([0], ends[:-1])) - np.array([done for _, _, done in held])
            view = memoryview(buffer)
            full = np.array([done + len(data) // 4 for _, data, done in held], np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc], pa.int64()),
                    pa.array(a - origin[doc]),
                    pa.array(b - a),
                    pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                    pa.array(full[doc]),
                    pa.array(sequence + window),
                    pa.array(a - chosen[window]),
                    pa.array(np.where(sizes_of & (sizes_of - 1) == 0, sizes_of, length)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"],
            )
            sequence += len(chosen) - 1
            # The rest of the stream begins inside the document that the last kept cut lies in.
            first = int(np.searchsorted(ends, stop, side="right"))
            rest = held[first:]
            if rest:
                key, data, done = rest[0]
                skip = int(stop - (ends[first] - sizes[first]))
                rest[0] = (key, data[4 * skip :], done + skip)
            held, carried = rest, int(ends[-1] - stop)
            return out

        held: list[tuple[int | None, bytes, int]] = []  # doc_id, ids, ids of the document already packed
        carried = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = words.encode(text.as_py() or "") + end
                held.append((key, data, 0))
                carried += len(data) // 4
                if carried >= BLOCK_TOKENS:
                    yield flush(last=False)
        if held:
            yield flush(last=True)

    columns = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    return columns.mapInArrow(run, SCHEMA)
