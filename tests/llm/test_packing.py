import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paypulse.llm.packing import SENTENCE_PENALTY, _tail, cut_windows, pack, possible_cuts

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, most_padding):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {}
    for doc_id, text, *_ in docs:
        own = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        ids.setdefault(doc_id, []).append(np.array(own, "<u4"))
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own[:-1])]
        size = sum(r.length for r in own)
        assert size <= 2048 and own[0].padded == (size if size & (size - 1) == 0 else 2048)
    for doc_id, texts in ids.items():
        if len(texts) > 1:
            assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
            continue
        own, at = sorted(pieces[doc_id], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(texts[0])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(texts[0][r.start : at].tobytes())
        assert at == len(texts[0])
    assert set(pieces) == set(ids)
    tokens = sum(r.length for r in rows)
    padded = sum(own[0].padded for own in sequences.values())
    assert padded <= tokens * (1 + most_padding), (padded, tokens)


def test_edges_and_special_tokens(make_docs, edge_rows):
    docs = edge_rows + [(70, "a <|endoftext|> b <|ENDOFTEXT|> İstanbul ΣΑΣ it's 12 ½ ᲀ\x1c\x85\xa0x"), (71, "No. Yes! " * 3000)]
    check(pack(make_docs(docs), PATH).collect(), docs, 0.1)


def test_sample_has_little_padding(make_docs, sample_texts):
    check(pack(make_docs(sample_texts).coalesce(1), PATH).collect(), sample_texts, 0.02)


def test_empty_table(make_docs):
    assert pack(make_docs([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    cuts = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 11))))
    costs = rng.choice([0, SENTENCE_PENALTY], len(cuts))
    costs[-1] = 0

    def cost(chosen):
        sizes = np.diff(cuts[list(chosen)])
        return np.inf if sizes.max() > 10 else (10 - sizes).sum() + sum(costs[c] for c in chosen[1:])

    every = [(0, *c, len(cuts) - 1) for n in range(len(cuts) - 1) for c in itertools.combinations(range(1, len(cuts) - 1), n)]
    chosen = cut_windows(cuts, costs, 10)
    assert cost([int(np.flatnonzero(cuts == c)[0]) for c in chosen]) == min(map(cost, every))


def test_possible_cuts_reach_everywhere():
    ids, ends = np.zeros(10_000, np.int64), np.array([9000, 10_000])
    ids[[100, 4000]] = 1
    cuts, costs = possible_cuts(ids, ends, np.array([False, True]), 2048)
    assert np.diff(cuts).max() <= 2048 and cuts[-1] == 10_000 and costs[-1] == 0 and 101 in cuts


def test_tails_are_cut_where_padding_costs_more():
    assert _tail(0, 2000, 2048) == [] and _tail(0, 1024, 2048) == []
    assert _tail(5, 5 + 1024 + 16, 2048) == [5 + 1024]
