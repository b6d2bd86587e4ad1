import hashlib

import numpy as np

from paypulse.llm.substring_dedup import HITS, REPEATS, _decode, _lists, remove_repeats


def expected(rows):
    words = [((float("inf") if r[0] is None else r[0]), (r[1] or "").encode().split()) for r in rows]
    first = {}
    for doc, w in words:
        for k in range(len(w) - 12):
            window = tuple(w[k : k + 13])
            first[window] = min(first.get(window, doc), doc)
    out = []
    for doc, w in words:
        covered = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < doc:
                covered[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((None if doc == float("inf") else doc, len(w), sum(covered), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_edges_and_sample(make_docs, edge_rows, sample_texts):
    line = " ".join(f"common{k}" for k in range(40))
    hot = [(3000 + k, f"own{k} " * (k % 9) + line + f" tail{k}") for k in range(300)]
    shifted = [(4000 - k, " ".join(f"p{j}" for j in range(k, k + 13 + k))) for k in range(30)]
    rows = edge_rows + [(1000 + i, t) for i, t in sample_texts] + hot + shifted + [(50, "same " * 40), (51, "same " * 30)]
    assert sorted(map(tuple, remove_repeats(make_docs(rows)).collect()), key=repr) == expected(rows)


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).collect() == []


def test_a_hash_that_many_documents_share_is_sent_once_or_twice():
    n = 500
    hashes = np.full(n, 123 << 40, np.uint64)
    held = [(np.arange(n) + 7, np.arange(n), hashes, np.ones(n, bool))]
    for rule, sent, found in ((HITS, 2, n), (REPEATS, 1, n - 1)):
        lists = _lists(held, rule, 4, 8).to_pylist()
        sizes = {True: 0, False: 0}
        for row in lists:
            ids, back, _ = _decode(row["shard"], row["hashes"], 4, 8)
            assert (back == hashes[0]).all()
            sizes[row["shard"] < 0] += len(ids)
        assert sizes == {True: found, False: sent}
