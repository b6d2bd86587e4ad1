import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from paypulse.llm.exact_dedup import decode_filter, drop_exact_duplicates, encode_filter, exact_duplicates, merge_entries


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def test_edges_and_sample(make_docs, edge_rows, sample_texts):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_texts] + [(5000 + k, "copy of one") for k in range(200)]
    got = exact_duplicates(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([])).collect() == []


def test_drop_keeps_columns(make_docs):
    docs = make_docs([(1, "a b"), (2, "a  b"), (3, "c")])
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize(("n", "skip"), [(1, 1), (2, 8), (1000, 4), (5000, 16)])
def test_filters_merge_losslessly(n, skip):
    rng = np.random.default_rng(n)
    lead = np.uint64(int(rng.integers(0, 1 << skip)) << (64 - skip))
    parts = []
    for _ in range(3):
        values = rng.integers(0, 2 ** (64 - skip), n, dtype=np.uint64)
        values[: n // 2] = values[: n // 2] % np.uint64(50)
        parts.append(np.unique(values | lead, return_counts=True))
    decoded = [decode_filter(encode_filter(p, c.astype(np.uint64), skip)) for p, c in parts]
    for (p, c), (q, d) in zip(parts, decoded, strict=True):
        assert (p == q).all() and (c == d).all()
    prints, counts = merge_entries(*zip(*decoded, strict=True))
    everything = np.concatenate([np.repeat(p, c) for p, c in parts])
    want = np.unique(everything, return_counts=True)
    assert (prints == want[0]).all() and (counts == want[1]).all()
