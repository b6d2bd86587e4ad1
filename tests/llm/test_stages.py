"""The pipeline's stages decide by row: null, reused and repeated ids, repeated rows."""

import re
from collections import Counter, defaultdict

import pytest

from paypulse.llm import near_dedup
from paypulse.llm.exact_dedup import drop_exact_duplicates
from paypulse.llm.mixing import mix_sources, take_mix
from paypulse.llm.near_dedup import drop_near_duplicates, near_duplicates

A = " ".join(f"w{k}" for k in range(60))
A1 = A + " more"
B = " ".join(f"v{k}" for k in range(60))


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("rows", "want"), [
    ([(1, A), (None, A1), (None, B)], [(1, A), (None, B)]),
    ([(1, A), (2, A1), (2, B)], [(1, A), (2, B)]),
    ([(1, A), (1, A)], [(1, A)]),
    ([(None, A), (None, A1), (None, A)], None),
    ([(3, A), (3, A1), (4, B), (4, B), (5, B)], None),
    ([(1, A), (2, ""), (2, ""), (None, None), (None, " ")], [(1, A), (2, ""), (2, ""), (None, None), (None, " ")]),
])
def test_near_copies(make_docs, rows, want):
    got = kept(drop_near_duplicates(make_docs(rows), 80))
    if want is not None:
        assert got == sorted(want, key=repr)
    else:
        kinds = [t in (A, A1) for _, t in got]
        assert sorted(kinds) == sorted({t in (A, A1) for _, t in rows})
        assert all((i, t) in rows for i, t in got) and {i for i, _ in got} == {min((i for i, t in rows if (t in (A, A1)) == k), key=lambda i: (i is None, i or 0)) for k in kinds}


@pytest.mark.parametrize(("rows", "want"), [
    ([(1, "a b"), (2, "a  b"), (2, "c")], [(1, "a b"), (2, "c")]),
    ([(1, "a"), (None, "a"), (None, "b")], [(1, "a"), (None, "b")]),
    ([(1, "a"), (1, "a")], [(1, "a")]),
    ([(None, "a"), (None, "a"), (None, "c"), (7, "d"), (7, "e")], [(7, "d"), (7, "e"), (None, "a"), (None, "c")]),
    ([(2, None), (1, "")], [(1, "")]),
])
def test_exact_copies(make_docs, rows, want):
    docs = make_docs(rows)
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns and kept(got) == sorted(want, key=repr)


def test_many_rows_without_an_id(spark, make_docs, monkeypatch):
    """Each text of a set is read once more at most: rows that share an id are not paired with each other's sets."""
    read = spark.sparkContext.accumulator(0)
    real = near_dedup._texts_of

    def counted(*args):
        frame = real(*args)
        read.add(frame.count())
        return frame

    monkeypatch.setattr(near_dedup, "_texts_of", counted)
    rows = [(None, f"{A} {k % 150} {'x ' * (k % 3)}") for k in range(600)] + [(k, f"{B} {k}") for k in range(20)]
    got = near_duplicates(make_docs(rows)).collect()
    sets = {re.sub(r"\s+", " ", t).strip() for _, t in rows}
    assert len(got) == len(rows) and 0 < read.value <= len(sets)
    assert len(drop_near_duplicates(make_docs(rows)).collect()) == 2


@pytest.mark.parametrize("rows", [
    [(1, "w w w", "a")] * 200 + [(100 + k, "w " * (k + 1), "b") for k in range(20)],
    [(None, "w w", "a")] * 90 + [(None, "w w w", None)] * 40 + [(5, "x y", "a"), (5, "y x", "a"), (5, None, "a"), (6, "", "b"), (7, "w", "b")],
])
def test_the_mix_keeps_its_budget(make_docs, rows):
    docs = make_docs(rows).repartition(7)
    mix = mix_sources(docs).collect()
    want = Counter()
    for r in mix:
        want[r.doc_id, r.source, r.size] += r.copies
    taken = take_mix(docs)
    assert taken.columns == docs.columns
    got = taken.collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == Counter({k: n for k, n in want.items() if n})
    assert sum(size(r.text) for r in got) == sum(r.taken for r in mix) <= sum(size(r[1]) for r in rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.doc_id, r.text].add(r.source)
    assert len(got) <= 3 * len(rows)
