import random

import numpy as np
import pytest

from paypulse.llm import near_dedup
from paypulse.llm.near_dedup import drop_near_duplicates, likely, near_duplicates, registers


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                label[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), float("inf")), ids[k])
    known = lambda x: None if x == float("inf") else x
    return sorted(
        ((known(ids[k]), len(sets[k]), known(least[root(k)]), ids[k] == least[root(k)]) for k in range(len(rows))), key=repr
    )


def star(n):
    """A text, and variants that are near it and not near each other."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = [" ".join(base)]
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), rng.choice((1, 2, 3))):
            words[at] = f"new{k}x{at}"
        out.append(" ".join(words))
    return out


def test_edges_sample_and_star(make_docs, edge_rows, sample_texts):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_texts] + [(9000 - k, t) for k, t in enumerate(star(60))]
    assert sorted(map(tuple, near_duplicates(make_docs(rows)).collect()), key=repr) == expected(rows)


def test_small_blocks_find_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    rows = [(k, t) for k, t in enumerate(star(40) + star(25))]
    assert sorted(map(tuple, near_duplicates(make_docs(rows)).collect()), key=repr) == expected(rows)


def test_empty_table_and_columns(make_docs):
    assert near_duplicates(make_docs([])).collect() == []
    docs = make_docs([(2, "a b c d e f g"), (1, "A b c d e f g"), (3, "other words")])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("shared", [0.95, 0.85, 0.6])
def test_registers_agree_as_often_as_sets_are_similar(shared):
    rng = np.random.default_rng(3)
    n = 4000
    common = int(2 * n * shared / (1 + shared))
    pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
    a, b = pool[:n], np.concatenate((pool[n - common : n], pool[n : 2 * n - common]))
    x, y = registers(np.unique(a)), registers(np.unique(b))
    assert abs((x == y).mean() - shared) < 0.12
    assert likely(x[None], y[None], np.array([n]), np.array([n]))[0] == (shared > 0.7)


def test_merged_registers_are_those_of_the_union():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()


def linked_components(rows, threshold):
    """(doc_id, smallest doc_id of its component) of (doc_id, text), by brute force."""
    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    return [(i, rows[k][0]) for (i, _), k in zip(rows, least, strict=True)]


def pairs_between(low, high, n):
    """Pairs of texts whose similarity in hundredths is from ``low`` to below ``high``."""
    rng, out = random.Random(low), []
    while len(out) < 2 * n:
        words = [f"p{low}x{len(out)}x{k}" for k in range(rng.randrange(60, 160))]
        changed = words[: -rng.randrange(1, 30)] + [f"q{low}x{len(out)}x{k}" for k in range(rng.randrange(1, 30))]
        a, b = shingles(" ".join(words)), shingles(" ".join(changed))
        if low * len(a | b) <= 100 * len(a & b) < high * len(a | b):
            out += [" ".join(words), " ".join(changed)]
    return out


def test_threshold_of_80_against_brute_force(make_docs):
    texts = pairs_between(80, 82, 150) + pairs_between(77, 80, 60) + pairs_between(85, 100, 20) + star(30)
    rows = list(enumerate(texts))
    for threshold in (80, 85):
        want = linked_components(rows, threshold)
        got = near_duplicates(make_docs(rows), threshold=threshold).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == want
    assert sum(i != c for i, c in linked_components(rows, 80)) >= 150 + sum(i != c for i, c in want)


def test_pipeline_stage_takes_80(spark, make_docs):
    import corpus_pipeline

    docs = make_docs(list(enumerate(pairs_between(80, 85, 10) + pairs_between(75, 80, 10))))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 20, 2), *range(20, 40)]


def test_bands_miss_as_few_pairs_at_any_threshold():
    assert near_dedup.band_shape(85) == (20, 6) and near_dedup.band_shape(80) == (24, 5)
    for threshold in range(50, 100):
        bands, width = near_dedup.band_shape(threshold)
        assert bands * width <= near_dedup.REGISTERS
        assert (1 - (threshold / 100) ** width) ** bands <= near_dedup.MISSED
    with pytest.raises(ValueError):
        near_dedup.band_shape(100)
