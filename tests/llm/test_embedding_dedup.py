import numpy as np

from paypulse.llm import embedding_dedup
from paypulse.llm.embedding_dedup import near_duplicate_vectors, tables_for

SCHEMA = "vec_id long, embedding array<float>, label int, node long, unit string, copies int, a long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "u", 2, 3) for i, v in rows], SCHEMA)


def vectors(groups, size=32, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for n in groups:
        centre = rng.normal(size=size)
        out += [(centre + rng.normal(size=size) * 0.15).astype(np.float32) for _ in range(n)]
    return out


def expected(rows):
    valid = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in valid:
        for b in valid:
            x, y = (np.array(rows[k][1], float) for k in (a, b))
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out, key=repr)


def test_groups_and_edges(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors([40, 3, 2] + [1] * 120))]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (901, [2 * x for x in rows[5][1]]), (902, [0.0] * 32), (903, None)]
    rows += [(904, []), (905, [float("nan")] * 32), (906, [None] * 32), (907, [1.0, 2.0]), (908, [2.0, 4.0]), (None, rows[1][1])]
    rows += [(909, [float("inf")] * 32), (910, [-0.0, 1.0]), (911, [0.0, 1.0])]
    assert sorted(map(tuple, near_duplicate_vectors(frame(spark, rows)).collect()), key=repr) == expected(rows)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors([50] + [1] * 30, seed=2))]
    assert sorted(map(tuple, near_duplicate_vectors(frame(spark, rows)).collect()), key=repr) == expected(rows)


def test_empty_table(spark):
    assert near_duplicate_vectors(frame(spark, [])).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine of 0.95 to 0.955 only: the hardest links."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cosine = rng.uniform(0.9501, 0.955)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (cosine * x + np.sqrt(1 - cosine**2) * y).tolist())]
    got = near_duplicate_vectors(frame(spark, rows)).collect()
    assert sum(r.n_links for r in got) / 2 >= 0.99 * 400


def test_tables_grow_slowly():
    assert tables_for(10) == (0, tables_for(1)[1])
    assert tables_for(10**9)[1] < 40 * tables_for(10**3)[1]
