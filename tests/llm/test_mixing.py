import zlib
from collections import Counter, defaultdict

import pytest

from paypulse.llm.mixing import mix_sources, source_targets, take_mix


def shares(sizes, weights):
    """Targets by resharing the excess until no source is above three times its size."""
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        whole = sum(w for s, w in weights.items() if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else rest * weights[s] / whole for s in sizes}
        above = {s for s in sizes if out[s] > 3 * sizes[s]} - capped
        if not above:
            return out
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1, "c": 1000, "d": 5}, {"a": 0, "b": 7}, {"z": 3, "Z": 100, "é": 2, "": 1, "b": 0},
    {f"s{k:02}": 3**(k % 9) for k in range(20)},
])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: [ord(c) for c in s]))}
    want = shares(sizes, weights)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def texts(n, source, words):
    return [(zlib.crc32(f"{source}{k}".encode()), " ".join(["w"] * (1 + k % words)), source) for k in range(n)]


def test_a_mix_comes_near_its_targets(make_docs):
    rows = texts(900, "hot", 40) + texts(60, "b", 30) + texts(40, "c", 20) + texts(30, None, 10) + [(10**10, None, "b"), (10**10 + 1, " ", "e")]
    got = mix_sources(make_docs(rows)).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(r.size for r in got)
    assert total - 40 < sum(taken.values()) <= total
    assert all(abs(taken[s] - target[s]) <= 45 for s in target)
    again = mix_sources(make_docs(rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_repeated_rows_nulls_and_empty_tables(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(edge_rows)
    assert {r.taken for r in got if r.size == 0} == {0}
    assert mix_sources(make_docs([])).collect() == []
    assert mix_sources(make_docs([(1, None), (2, "")])).select("taken").distinct().collect()[0].taken == 0


def test_the_mix_in_its_order(make_docs):
    rows = texts(200, "a", 20) + texts(50, "b", 20) + [(7, None, "a")]
    docs = make_docs(rows)
    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    taken = take_mix(docs)
    assert taken.columns == docs.columns
    got = taken.collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    spread = defaultdict(list)
    for k, r in enumerate(got):
        spread[r.source].append(k / len(got))
    assert all(0.35 < sum(v) / len(v) < 0.65 for v in spread.values())
