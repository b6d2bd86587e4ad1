"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from paypulse.llm import shared, spelling as s
from paypulse.llm.queries import op11_spelling

SF_DIR = "/root/testdata/sf0.001"


def words_of(rows, plant=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if plant and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(counts):
    """(word, form, root, n, n_near, form_n), near words found by the words with one letter left out."""
    holes = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            holes[w[:k] + w[k + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)


def random_words(seed, n):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        word = "".join(rng.choice("eeenth" if seed % 2 else "eanthloßüz") for _ in range(rng.randrange(5, 9)))
        words.add(word)
        if rng.random() < 0.5:
            k = rng.randrange(len(word) + 1)
            words.add(word[:k] + rng.choice("etz") + word[k + rng.randrange(2) :])
    return {w: rng.choice([3, 3, 4, 7, 8, 20, 100, 10**6]) for w in words if len(w) >= 5}


@pytest.mark.parametrize(("seed", "n", "shard", "searches"), [(1, 700, 4096, 16), (2, 900, 30, 2), (3, 600, 3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, n, shard, searches):
    for name, value in (("SHARD_WORDS", shard), ("SHARD_SEARCHES", searches), ("BLOCK", 64 if seed > 1 else 4096)):
        monkeypatch.setattr(s, name, value)
    monkeypatch.setattr(shared, "HEAVY_KEYS", 10 if seed > 1 else 1000)
    counts = random_words(seed, n)
    got = s.spelling_variants(vocabulary(spark, counts)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_force(counts)


def test_words_of_one_vector(spark, monkeypatch):
    """More words with the same letters than a shard takes, next to longer and shorter ones."""
    for name, value in (("SHARD_WORDS", 20), ("SHARD_SEARCHES", 1)):
        monkeypatch.setattr(s, name, value)
    rng = random.Random(5)
    counts = {}
    for base in ("ehleht", "lhehteh", "hlhehe", "hhlleh"):
        for _ in range(150):
            word = "".join(rng.sample(base, len(base)))
            counts[word] = rng.randrange(3, 50)
            counts[word.replace("l", "h", 1)] = rng.randrange(3, 50)
    got = s.spelling_variants(vocabulary(spark, counts)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_force(counts)


def test_chains_and_long_words(spark):
    counts = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 40)} | {"z" * 60_000: 3, "z" * 60_001: 6, "z" * 30_000 + "y" + "z" * 30_000: 12}
    got = {r.word: r for r in s.spelling_variants(vocabulary(spark, counts)).collect()}
    assert got["a" * 5].root == "a" * 39 and got["a" * 5].form == "a" * 6 and got["a" * 39].form is None
    assert got["z" * 60_000].root == "z" * 30_000 + "y" + "z" * 30_000 and got["z" * 60_001].n_near == 2


def test_whole_texts(spark, make_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows] + [(50 + k, "Straße STRASSE strasse Ärger ärger aerger don't naïve × ÷abcde wörter12wort") for k in range(300)]
    rows += [(None, "nameless words"), (None, "nameless words"), (None, "nameless words"), (7, None)]
    got = s.group_spellings(make_docs(rows), plant=True)
    assert [f"{n} {t}" for n, t in got.dtypes] == "word string,form string,root string,n bigint,n_near bigint,form_n bigint".split(",")
    assert sorted(map(tuple, got.collect())) == brute_force(words_of(rows))
    assert sorted(map(tuple, s.word_counts(make_docs(rows)).collect())) == sorted(words_of(rows, plant=False).items())
    assert s.group_spellings(make_docs([])).collect() == []
    assert s.group_spellings(make_docs([(1, None), (2, "a b c")])).collect() == []


def test_registered_query(spark, sample_texts):
    assert sorted(map(tuple, op11_spelling(spark, SF_DIR).collect())) == brute_force(words_of(sample_texts))


def test_near():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        assert s.near(a, b) == is_near(a, b)
