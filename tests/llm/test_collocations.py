"""Collocations against brute force, and the guarantee of the merged summaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paypulse.llm import collocations as c
from paypulse.llm import shared


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_force(rows, threshold, top=2000, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und" if lang != "" else ""] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    counts[lang or "und" if lang != "" else ""][tuple(words[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in frequent.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            around = [b for q, b in frequent.items() if len(q) > len(p) and any(q[s : s + len(p)] == p for s in range(len(q)))]
            if not any(100 * b >= 80 * a for b in around):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def make_docs(spark, rows):
    extra = ", ".join(f"`{x}` string" for x in ("chunk", "shard", "phrase", "n", "a", "words"))
    return spark.createDataFrame([(k, *r, *"xxxxxx") for k, r in enumerate(rows)], f"doc_id long, lang string, text string, {extra}")


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "ÄRGER", "ärger", "a", "b", "c", "new", "日本", "x" * 300]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", " "]
    return [
        (rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))))
        for _ in range(n)
    ]


EDGES = [("en", None), (None, None), ("xx", ""), ("yy", " .,;"), ("long", "p q r s " * 30_000), ("long", "one piece " * 20_000 + "."), ("en", "new york city")]


@pytest.mark.parametrize(("seed", "top", "small"), [(1, 2000, False), (2, 3, True)])
def test_against_brute_force(spark, monkeypatch, seed, top, small):
    rows = texts(seed, 400) + EDGES + [("hot", "A b, a B c d e")] * 150
    if small:  # many chunks, shards and heavy keys; chunks that end inside texts
        for name, value in (("CHUNK_BYTES", 1 << 15), ("SHARD_SEQUENCES", 2000)):
            monkeypatch.setattr(c, name, value)
        monkeypatch.setattr(c.segments, "__defaults__", (1 << 14,))
        monkeypatch.setattr(shared, "HEAVY_KEYS", 20)
    got = c.collocations(make_docs(spark, rows).repartition(5), top=top, threshold=30)
    assert [f"{n} {t}" for n, t in got.dtypes] == "lang string,rank bigint,phrase string,a bigint,l bigint,r bigint,n bigint,score bigint".split(",")
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 30, top)


def test_clashing_hashes_change_nothing(spark, monkeypatch):
    rows = texts(3, 300)
    monkeypatch.setattr(c, "_FACTOR", np.uint64(0))  # all sequences with the same last word share a key
    assert sorted(map(tuple, c.collocations(make_docs(spark, rows), threshold=20).collect())) == brute_force(rows, 20)


def test_no_rows_and_no_words(spark):
    assert c.collocations(make_docs(spark, [])).collect() == []
    assert c.collocations(make_docs(spark, [("en", None), (None, ", ."), ("en", "only once")])).collect() == []


def test_given_texts(spark, sample_texts):
    rows = [(None, t) for _, t in sample_texts]
    assert sorted(map(tuple, c.collocations(make_docs(spark, rows), threshold=10).collect())) == brute_force(rows, 10)


@pytest.mark.parametrize("seed", range(4))
def test_frequent_keys_survive_merging(seed):
    rng = np.random.default_rng(seed)
    lists, truth = [], Counter()
    for _ in range(60):
        keys = np.unique(np.concatenate([rng.integers(0, 2**32, 400, dtype=np.uint64), rng.zipf(1.4, 300).astype(np.uint64) % 2**32]))
        counts = rng.integers(1, 4, len(keys))
        truth.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        lists.append(c._packed(keys.astype(np.uint32), counts))
    for threshold in (20, 45):
        kept = set(c.surviving(lists, threshold).tolist())
        frequent = {k for k, n in truth.items() if n >= threshold}
        assert frequent <= kept and len(kept) <= sum(truth.values()) // threshold + 1
    summary = c.Summary(50)
    for one in lists:
        keys, counts = c._unpacked(*one)
        summary.merge([keys], [counts])
        assert len(summary.keys) <= 50
    assert summary.error <= sum(truth.values()) / 51
    assert all(truth[k] - summary.error <= n <= truth[k] for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


@pytest.mark.parametrize("limit", [1, 7, 50, 10**6])
def test_segments_end_between_pieces(limit):
    rows = ["a b. c d", None, "", "eé f,,g h\ti", "x" * 60, "k l", " ", "m.n"]
    seen = []
    for s in c.segments(pa.array(["p", "q", None, "p", "p", "p", "p", "z"]), pa.array(rows), limit):
        names = s.word_names.cast(pa.string()).to_pylist()
        last = None
        for lang, word, piece in zip(s.langs, s.words, s.pieces, strict=True):
            same = piece == last
            seen.append((s.lang_names[lang], names[word], same))
            last = piece
    assert seen == [
        ("p", "a", False), ("p", "b", True), ("p", "c", False), ("p", "d", True), ("p", "eé", False), ("p", "f", True), ("p", "g", False),
        ("p", "h", True), ("p", "i", True), ("p", "x" * 60, False), ("p", "k", False), ("p", "l", True), ("z", "m", False), ("z", "n", False),
    ]
