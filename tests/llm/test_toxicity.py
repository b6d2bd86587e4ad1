import random

import numpy as np
from pyspark.sql import functions as F

from paypulse.llm.toxicity import drop_toxic, held_out, score_toxicity, train

SYLLABLES = "an er in on the re sh th wh st ou ly ing ed ti or es at he".split()


def corpus(n, seed, bad):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.3)
        words = ["".join(rng.choices(SYLLABLES, k=rng.choice((1, 2, 3)))) for _ in range(rng.choice((8, 60, 400)))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), toxic))
    return rows


BAD = ["moronic", "worthless", "disgusting", "pathetic"]


def test_held_out_rows_and_misspellings():
    rows = corpus(900, 1, BAD)
    model = train([t for _, t, _ in rows[:600]], [y for *_, y in rows[:600]])

    def accuracy(sample):
        from paypulse.llm.toxicity import _WordScores

        scores = _WordScores(model.weights)
        z = np.array([model.slope * scores.worst(t) + model.offset for _, t, _ in sample])
        return ((z >= 0) == np.array([y for *_, y in sample])).mean()

    assert accuracy(rows[600:]) > 0.97
    assert accuracy(corpus(300, 2, ["moronicc", "worthles", "disgustingg", "pathetick"])) > 0.9


def test_scores_edges_and_filter(spark, make_docs, edge_rows):
    rows = corpus(400, 3, BAD)
    docs = make_docs([(100 + k, t) for k, t, _ in rows] + edge_rows)
    labels = spark.createDataFrame(
        [(100 + k, y, "x", 1.0) for k, _, y in rows] + [(None, 1, "x", 1.0), (1, None, "x", 1.0), (100, rows[0][2], "x", 0.0)],
        "doc_id long, toxic int, text string, score double",
    )
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {100 + k: y for k, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 40 < len(held) < 130 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    empty = {r.predicted for r in got if r.doc_id in (3, 4, 5, None)}
    assert empty == {0}
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_words_on_both_sides_of_a_cut_count_together():
    from paypulse.llm.toxicity import BUCKETS, _WordScores

    scores = _WordScores(np.zeros(BUCKETS, np.float32))
    scores.update({w.encode(): 1.0 for w in BAD})
    plain = [f"w{k}" for k in range(96)]
    whole = 4 / (32 + 24)
    for at in (0, 30, 46, 62, 92):
        text = " ".join(plain[:at] + BAD + plain[at:92])
        assert abs(scores.worst(text) - whole) < 1e-9
    assert scores.worst("") == 0.0 and abs(scores.worst("moronic moronic") - 1 / 25) < 1e-9
    repeated = " ".join(["w"] * 16 + ["moronic"] + ["w"] * 15)
    assert abs(scores.worst(repeated) - 1 / (2 + 24)) < 1e-9


def test_texts_beyond_the_sample_are_left_out(spark, make_docs, monkeypatch):
    import zlib

    from paypulse.llm import toxicity

    rows = corpus(120, 4, BAD)
    usable = [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5][:20]
    first = spark.createDataFrame([(k,) for k, *_ in usable], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]
    texts = [(k, "long " * 20_000 if k == first else t) for k, t, _ in usable]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 90_000)
    labels = spark.createDataFrame([(k, y) for k, _, y in usable], "doc_id long, toxic int")
    assert toxicity.train_on(make_docs(texts), labels).rows == len(usable) - 1


def test_very_long_words_are_scored_in_parts(monkeypatch):
    """A text without blanks: the same score whatever is held at a time, and no list of all its n-grams."""
    import tracemalloc

    import numpy as np

    from paypulse.llm import toxicity

    weights = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    word = ("abcdefgh你好" * 9000)[:60_000]
    whole = float(weights[toxicity.buckets(word.encode())].mean())
    monkeypatch.setattr(toxicity, "GRAM_BLOCK", 1000)
    assert list(toxicity.buckets(b"abc" * 700)) == [b for block in toxicity.bucket_blocks(b"abc" * 700) for b in block]
    assert abs(toxicity._WordScores(weights)[word.encode()] - whole) < 1e-4
    monkeypatch.undo()
    tracemalloc.start()
    toxicity._WordScores(weights)[b"x7" * 1_000_000]
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
