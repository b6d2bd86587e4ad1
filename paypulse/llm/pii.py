"""Personal data: fixed formats, and candidates that boosted trees select.

High-recall generators propose overlapping spans, trimmed ones too; gradient-boosted trees, trained here in numpy, score
their format and context; a threshold for each generator, calibrated on candidates that were not trained on, selects spans.
A candidate is labelled as personal data where it is a match of a fixed format, or where it passes a check that these do not
have: addresses with (at), hardware and IPv6 addresses, numbers with the checksum of an IBAN or of a card in its usual groups,
telephone numbers with 00 or after a cue. Matches rewritten in all these forms are learnt from too. Thresholds look at what no
fixed format touches in the texts as they are, as only that can be selected; a generator that finds too little of it there is
calibrated on rewritten matches as well.

All candidates of all texts are learnt from. Features are small integers, so equal candidates are counted as one, and the table of
them stays with the executors: each level of a tree takes one pass over it that returns sums by node, feature and bin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paypulse.llm.shared import cut
from paypulse.llm.spans import Span, find_spans, in_order

BASE_KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("contact", "dotted", "digits", "mixed")
KINDS = (*BASE_KINDS, *GENERATORS)
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Sums are of multiples of 1 / ``UNIT``, exact in any order; margins are rounded to 1 / ``STEP``, so that only so many scores exist.
UNIT, STEP = 1 << 24, 1024
#: One in so many candidates is held back from training, for the thresholds.
HELD = 4
#: Rows of a block of the table that trees are fitted to.
BLOCK_ROWS = 65_536
#: A threshold is the lowest score from which on at least this share of the calibration candidates, none of which touches a
#: fixed format, is personal data; it takes so many of these to set one.
PRECISION, FEWEST = 0.98, 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# Atomic repeats and look-behinds only keep long runs from being tried again and again; the matches are the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Some text that any pattern or generator can be found in; RE2.
_LIKELY = (
    r"@|[\[(]at[\])]|\+[0-9]|[0-9]\.[0-9]|[.:][0-9A-Fa-f]{1,4}[.:][0-9A-Fa-f]{1,4}[.:][0-9A-Fa-f]"
    r"|[0-9]([^0-9A-Za-z]{0,3}[0-9]){6}|[A-Z]{2}[0-9]{2}"
)

_CANDIDATES = {
    "contact": re.compile(r"(?<![^\s<>(),;\[])[^\s@<>(),;\[]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>(),;]{1,253}"),
    "dotted": re.compile(r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]{0,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z])"),
    "digits": re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])"),
    "mixed": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![0-9A-Za-z])"),
}
_CUES = re.compile(r"(phone|tel|call|fax|mobile)|(card|visa|credit|account|iban)|(mail|contact|write)|(ip|host|server|address)|(id|order|ref|version|no|page|item)", re.I)

_AT = re.compile(r"\x20?[\[(]at[\])]\x20?")
_ADDRESS = re.compile(r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_COLONS = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}")
_CALL = re.compile(r"\b(?:tele)?(?:phone|tel|call|fax|mobile|cell)\b[^0-9A-Za-z]{0,4}(?:[A-Za-z]{1,8}[^0-9A-Za-z]{1,3})?$", re.I)
_CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
_EDGES = " \t\n.,;:!?'\"`*_-/\\[]{}<>()|="


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap within a kind; those that fail a check are dropped and not tried again."""
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[Span]:
    """Matches of the generators, and of each one the part between punctuation, after a prefix as in mailto:, and without
    its first or its last group."""
    out = {}
    for kind, pattern in _CANDIDATES.items():
        for m in pattern.finditer(text):
            start, end = m.span()
            spans = [(start, end)]
            if kind == "contact":
                while start < end and text[start] in _EDGES:
                    start += 1
                while start < end and text[end - 1] in _EDGES:
                    end -= 1
                local = _AT.split(text[start:end], maxsplit=1)[0].split("@", 1)[0]
                prefix = max(local.rfind(c) for c in ":=\"'/") + 1
                spans += [(start, end), (start + prefix, end)]
            elif kind != "dotted":
                groups = [g.span() for g in re.finditer("[0-9A-Za-z]+", m[0])]
                if len(groups) > 1:
                    spans += [(start, start + groups[-2][1]), (start + groups[1][0], end)]
            out.update(((kind, a, b), None) for a, b in spans if a < b)
    return list(out)


def iban(own: str) -> bool:
    own = own.replace(" ", "")
    return 15 <= len(own) <= 34 and own.isascii() and own.isalnum() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def checks(text: str, span: Span) -> list[bool]:
    """What labels a candidate as personal data that no fixed format matches: address, colon address, IBAN, grouped card,
    telephone number with 00, and after a cue."""
    kind, start, end = span
    own = text[start:end]
    groups = tuple(len(g) for g in re.findall("[0-9]+", own))
    n, digits = sum(groups), kind == "digits"
    call = digits and 2 <= len(groups) <= 6 and groups not in _CARD_GROUPS
    return [
        kind == "contact" and _ADDRESS.fullmatch(_AT.sub("@", own)) is not None,
        kind == "dotted" and _COLONS.fullmatch(own) is not None,
        kind == "mixed" and iban(own),
        digits and groups in _CARD_GROUPS and luhn(re.sub("[^0-9]", "", own)),
        call and own.startswith("00") and 11 <= n <= 17,
        call and 7 <= n <= 15 and _CALL.search(text[max(0, start - 24) : start]) is not None,
    ]


def _account(digits: str) -> str:
    """An IBAN with the digits of a card, in groups of four."""
    own = f"{digits:0<18}"[:18]
    own = f"DE{98 - int(own + '131400') % 97:02}{own}"
    return " ".join(own[k : k + 4] for k in range(0, len(own), 4))


def rewritten(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with its addresses, telephone and card numbers in forms that are not fixed formats, and their new places."""
    pieces, spans, done, at = [], [], 0, 0
    for kind, start, end in sorted(base, key=lambda s: (s[1], -s[2])):
        if start < done:
            continue
        own = text[start:end]
        digits = re.sub("[^0-9]", "", own)
        if kind == "email":
            own = own.replace("@", (" (at) ", "[at]", "(at)")[len(own) % 3])
        elif kind == "phone":
            own = "00" + own[1:]
        elif kind == "ip":
            octets = [int(part) for part in own.split(".")]
            own = ":".join(f"{v:02x}" for v in (*octets, sum(octets) % 256, octets[0] ^ octets[3]))
        elif sum(map(int, digits)) % 2 == 0:
            own = _account(digits)
        else:
            own = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
        pieces += [text[done:start], own]
        at += start - done
        spans.append((kind, at, at + len(own)))
        at, done = at + len(own), end
    return "".join(pieces) + text[done:], spans


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and its context: counts, groups, bounds of its numbers, neighbours, a cue before it."""
    kind, start, end = span
    own = text[start:end]
    digits = re.sub("[^0-9]", "", own)
    groups = [len(g) for g in re.findall("[0-9]+", own)]
    values = [min(int(g), 9999) for g in re.findall("[0-9]{1,6}", own)] or [0]
    cue = _CUES.search(text, max(0, start - 24), start)
    before, after = text[start - 1 : start], text[end : end + 1]
    last = re.split(r"[.@]", own)[-1]
    return [
        GENERATORS.index(kind), len(own), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        max(values), own.count("."), own.count(":"), own.count("-"), own.count(" "), own.count("("), own.count("@"),
        own.startswith("+"), sum(c.isalpha() for c in own), sum(c.isupper() for c in own),
        13 <= len(digits) <= 19 and luhn(digits), len(last), last.isalpha(), cue.lastindex if cue else 0,
        before.isspace() or not before, before.isalnum(), after.isspace() or not after, after.isalnum(),
        own[:1].isalnum() or own[:1] in "+(", own[-1:].isalnum(), _AT.search(own) is not None, *checks(text, span),
    ]


def is_positive(span: Span, base: list[Span]) -> bool:
    """Whether a span of a fixed format and the candidate share at least 0.8 of what they cover together."""
    _, a, b = span
    return any(min(b, y) - max(a, x) >= 0.8 * (max(b, y) - min(a, x)) for _, x, y in base)


def touches(span: Span, spans: list[Span]) -> bool:
    return any(a < span[2] and span[1] < b for _, a, b in spans)


def examples(text: str) -> Iterator[tuple[list[float], int, int]]:
    """Features, label and sort of the candidates of a text and of its rewritten matches: -1 where a fixed format touches it,
    0 for a free one of the text as it is, 1 for a rewritten one."""
    base = base_spans(text)
    for span in candidates(text):
        free = not touches(span, base)
        yield [float(v) for v in features(text, span)], int(any(checks(text, span)) or is_positive(span, base)), int(free) - 1
    if base:
        text, spans = rewritten(text, base)
        base = base_spans(text)
        for span in candidates(text):
            if touches(span, spans) and not touches(span, base):
                yield [float(v) for v in features(text, span)], int(any(checks(text, span))), 1


class Trees(NamedTuple):
    """Depth-wise trees: node k of a level tests feature[k] > cut[k] and leads to 2k or 2k + 1; leaves hold values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            place = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                node = (1 << level) - 1 + place
                place = 2 * place + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[place]
        return 1 / (1 + np.exp(-np.clip(np.rint(out * STEP) / STEP, -30, 30)))


class Block(NamedTuple):
    """Bins of candidates, a row for each feature; their labels, and how many candidates each one stands for."""

    bins: np.ndarray
    y: np.ndarray
    n: np.ndarray


#: Sums of gradients and of weights by node of the level, feature and bin, given the trees so far and the levels above.
Sums = Callable[[Trees, int, int], np.ndarray]


def _place(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of a level that each candidate is led to; cuts are bins here."""
    place = np.zeros(bins.shape[1], np.int64)
    for level in range(levels):
        node, right = (1 << level) - 1, np.zeros(bins.shape[1], bool)
        for k in range(1 << level):
            right |= (place == k) & (bins[feature[node + k]] > cut[node + k])
        place = 2 * place + right
    return place


def level_sums(block: Block, trees: Trees, tree: int, level: int) -> np.ndarray:
    """(2, nodes, features, ``BINS``) in units of 1 / ``UNIT``: gradients and weights of logistic loss."""
    out = np.full(len(block.y), trees.prior)
    for t in range(tree):
        out += trees.value[t][_place(block.bins, trees.feature[t], trees.cut[t], DEPTH)]
    p = 1 / (1 + np.exp(-out))
    parts = [np.rint(v * UNIT) * block.n for v in (block.y - p, p * (1 - p) + 1e-6)]
    place, width = _place(block.bins, trees.feature[tree], trees.cut[tree], level) * BINS, 1 << level
    sums = [[np.bincount(place + bins, part, width * BINS) for bins in block.bins] for part in parts]
    return np.array(sums).astype(np.int64).reshape(2, len(block.bins), width, BINS).swapaxes(1, 2)


def _boost(cuts: list[np.ndarray], share: float, sums: Sums) -> Trees:
    """Gradient boosting of logistic loss with histograms; the trees' cuts are values again."""
    share, nodes = np.clip(share, 1e-3, 1 - 1e-3), (1 << DEPTH) - 1
    feature, value = np.zeros((TREES, nodes), np.int64), np.zeros((TREES, nodes + 1))
    trees = Trees(feature, np.full((TREES, nodes), BINS), value, float(np.log(share / (1 - share))))
    for tree in range(TREES):
        for level in range(DEPTH):
            width, node = 1 << level, (1 << level) - 1
            g, h = (v.cumsum(axis=2) for v in sums(trees, tree, level) / UNIT)
            best, leaves = np.zeros(width), np.stack([g[:, 0, -1], h[:, 0, -1], np.zeros(width), np.zeros(width)], axis=1)
            for k, edges in enumerate(cuts):
                if not len(edges):
                    continue
                left = g[:, k, :-1] ** 2 / (h[:, k, :-1] + 1)
                right = (g[:, k, -1:] - g[:, k, :-1]) ** 2 / (h[:, k, -1:] - h[:, k, :-1] + 1)
                gain = (left + right - g[:, k, -1:] ** 2 / (h[:, k, -1:] + 1))[:, : len(edges)]
                at, rows = gain.argmax(axis=1), np.arange(width)
                better = gain[rows, at] > best + 1e-9
                best[better] = gain[rows, at][better]
                feature[tree, node : node + width][better], trees.cut[tree, node : node + width][better] = k, at[better]
                own = np.stack([g[rows, k, at], h[rows, k, at], g[:, k, -1] - g[rows, k, at], h[:, k, -1] - h[rows, k, at]], axis=1)
                leaves[better] = own[better]
        leaves = leaves.reshape(-1, 2)
        value[tree] = RATE * leaves[:, 0] / (leaves[:, 1] + 1)
    edges = [np.append(c, np.full(BINS + 1 - len(c), np.inf)) for c in cuts]
    return trees._replace(cut=np.stack(edges)[feature, trees.cut])


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]).astype(np.uint8)


def _cuts(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bounds of bins: quantiles, as of ``numpy.quantile``, of sorted values that stand for ``n`` each."""
    upto = np.cumsum(n)
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(at), side="right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting with quantile bins, of rows in memory."""
    cuts = [_cuts(*np.unique(x[:, k], return_counts=True)) for k in range(x.shape[1])]
    block = Block(_bins(x, cuts), y, np.ones(len(y)))
    return _boost(cuts, y.mean(), lambda trees, tree, level: level_sums(block, trees, tree, level))


def _lowest_precise(scores: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """The lowest score above which at least ``PRECISION`` are positive, ``FEWEST`` of them or more; None if there is none."""
    order = np.argsort(-scores, kind="stable")
    ranked, hits, seen = scores[order], np.cumsum((y * n)[order]), np.cumsum(n[order])
    last_of_tie = np.append(ranked[1:] != ranked[:-1], True) if len(ranked) else np.empty(0, bool)
    good = np.flatnonzero(last_of_tie & (hits >= PRECISION * seen) & (hits >= FEWEST))
    return float(ranked[good[-1]]) if len(good) else None


def calibrate(
    scores: np.ndarray, y: np.ndarray, kinds: np.ndarray, free: np.ndarray | None = None, n: np.ndarray | None = None
) -> np.ndarray:
    """A threshold for each generator: ``_lowest_precise`` of its ``free`` candidates, or where these are too few of all its
    candidates, or of those of all generators; failing that, whatever scores above every negative one. None is below 0.5.
    Each row stands for ``n`` candidates, by default one."""
    free, n = np.ones(len(y), bool) if free is None else free, np.ones(len(y), np.int64) if n is None else n
    above = np.nextafter(scores[y == 0].max(initial=0.5), 2.0)
    out = []
    for kind in range(len(GENERATORS)):
        own = kinds == kind
        found = (_lowest_precise(scores[rows], y[rows], n[rows]) for rows in (own & free, own, np.ones(len(y), bool)))
        out.append(max(0.5, next((t for t in found if t is not None), above)))
    return np.array(out)


class Selector(NamedTuple):
    trees: Trees
    thresholds: np.ndarray
    #: How many candidates it was trained on and calibrated with.
    candidates: int = 0

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates that the trees select, and that don't touch a span of a fixed format or a better candidate."""
        found = [s for s in candidates(text) if not touches(s, base)]
        if not found:
            return []
        x = np.array([features(text, s) for s in found], float)
        scores = self.trees.scores(x)
        out: list[Span] = []
        lengths = np.array([end - start for _, start, end in found])
        for k in np.lexsort((-lengths, -scores)):
            if scores[k] >= self.thresholds[GENERATORS.index(found[k][0])] and not touches(found[k], out):
                out.append(found[k])
        return out


def counted_candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """x, y, free, train, held: the different ``examples`` of all texts, features as 16-bit integers, and how many of each there
    are to train on and to calibrate with. One in ``HELD`` is held back; where that leaves a rest, the hash deals it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = pc.fill_null(pc.match_substring_regex(batch.column(0), _LIKELY), False)
            found = Counter(
                (np.array(own, "<i2").tobytes(), label, outside)
                for text in batch.column(0).filter(likely).to_pylist() for own, label, outside in examples(text)
            )
            x, y, free = ([key[k] for key in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.binary()), *(pa.array(v, pa.int64()) for v in (y, free, list(found.values())))], ["x", "y", "free", "n"]
            )

    found = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "x binary, y long, free long, n long")
    counted = found.groupBy("x", "y", "free").agg(F.sum("n").alias("n"))
    held = F.floor((F.col("n") + F.pmod(F.xxhash64("x", "y", "free"), F.lit(HELD))) / HELD)
    return counted.select("x", "y", "free", (F.col("n") - held).alias("train"), F.when(F.col("free") >= 0, held).otherwise(0).alias("held"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Features of a batch, a row for each candidate."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(len(column), -1)


def _values(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each feature its values, sorted, and how many candidates to train on have them. Both are bounded by what features can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, n = _matrix(batch.column(0)), batch.column(1).to_numpy()
                for k in range(x.shape[1]):
                    values, place = np.unique(x[:, k], return_inverse=True)
                    columns = (np.full(len(values), k), values.astype(np.int64), np.bincount(place, n).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "value", "n"])

    found = rows.where("train > 0").select("x", "train").mapInArrow(run, "feature long, value long, n long")
    found = np.array(sorted(found.groupBy("feature", "value").agg(F.sum("n")).collect()))
    return [(own[:, 1], own[:, 2]) for own in (found[found[:, 0] == k] for k in range(int(found[-1, 0]) + 1))]


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The candidates to train on as rows that hold a ``Block`` each, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                parts = _bins(_matrix(own.column(0)), cuts), *(own.column(k).to_numpy().astype(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["bins", "y", "n"])

    return cut(rows.where("train > 0").select("x", "y", "train").mapInArrow(run, "bins binary, y binary, n binary"))


def _sums(blocks: DataFrame, features: int) -> Sums:
    """Sums of ``level_sums`` over all blocks: each task returns its own, which are as many as nodes, features and bins."""

    def sums(trees: Trees, tree: int, level: int) -> np.ndarray:
        shape = 2, 1 << level, features, BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                for bins, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    y, n = np.frombuffer(y, np.int64), np.frombuffer(n, np.int64)
                    total += level_sums(Block(np.frombuffer(bins, np.uint8).reshape(features, -1), y, n), trees, tree, level)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = blocks.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r.sums, np.int64) for r in found).reshape(shape)

    return sums


def _held_scores(rows: DataFrame, trees: Trees) -> np.ndarray:
    """(score, label, generator, free, number) of the candidates held back; as many rows as scores, labels and generators there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                columns = [pa.array(trees.scores(x)), batch.column(1), pa.array(x[:, 0].astype(np.int64)), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["score", "y", "kind", "free", "n"])

    found = rows.where("held > 0").select("x", "y", "free", "held")
    found = found.mapInArrow(run, "score double, y long, kind long, free long, n long")
    found = found.groupBy("score", "y", "kind", "free").agg(F.sum("n").alias("n")).collect()
    return np.array(found, float).reshape(-1, 5)


def train_selector(docs: DataFrame, text_column: str = "text") -> Selector | None:
    """Trees and thresholds from all candidates of ``docs``; None without candidates of both labels.

    Nothing is left out: every level of a tree is a pass over all candidates, counted by their features, and the thresholds
    look at all that were held back. As sums are exact, neither the order of rows nor their partitions change the result.
    """
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    rows = cut(counted_candidates(docs, text_column).coalesce(tasks))
    n, positive, held = (v or 0 for v in rows.agg(F.sum("train"), F.sum(F.col("train") * F.col("y")), F.sum("held")).first())
    if positive in (0, n):
        return None
    values = _values(rows)
    cuts = [_cuts(*own) for own in values]
    trees = _boost(cuts, positive / n, _sums(_blocks(rows, cuts), len(cuts)))
    score, y, kinds, free, number = _held_scores(rows, trees).T
    return Selector(trees, calibrate(score, y, kinds, free == 0, number), n + held)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) of all rows: kinds ``KINDS`` by start, then kind; places in code points, end exclusive.

    The base kinds are always there; selected candidates never overlap them or each other. Null and empty texts have no
    spans; repeated rows get equal ones, null ids are carried, an empty table gives an empty result. Other columns are
    not read. Without candidates to learn from only the base kinds are found.
    """
    selector = docs.sparkSession.sparkContext.broadcast(train_selector(docs, text_column))

    def make_finder():
        own = selector.value

        def find(text: str) -> list[Span]:
            base = base_spans(text)
            return in_order(base + (own.select(text, base) if own else []), KINDS)

        return find

    return find_spans(docs, _LIKELY, make_finder, id_column, text_column)
