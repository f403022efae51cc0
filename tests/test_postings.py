"""The postings index against the scan, with small blocks and odd pages."""

import random

import numpy as np
import pytest

from pagemill.operators import postings, retrieve
from pagemill.sources.scratch import scratch_path


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.choice([1, 1, 2, 3]) if rng.random() < 0.7 else f"w{int(rng.paretovariate(0.6)) % 400}"
    pages = [(d, p, " ".join(word() for _ in range(rng.choice([0, 1, 8, 40])))) for d in range(60) for p in range(1, rng.choice([2, 4, 7]))]
    pages += [(100, 1, None), (100, 2, ""), (101, 1, "a"), (101, 2, "a"), (-5, 1, "zz top")]
    asks = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 20])))) for i in range(30)] + [(50, None), (51, "unheard of"), (52, "a a a"), (53, "zz zz unheard")]
    return pages, asks


@pytest.mark.parametrize("k", [1, 5, 500])
def test_index_gives_the_scan(spark, k):
    pages, asks = corpus(k)
    docs, queries = spark.createDataFrame(pages, "doc_id long, page_num long, text string"), spark.createDataFrame(asks, "qid long, text string")
    index = postings.build_index(docs, scratch_path(spark), block_bytes=1500)
    assert index.n_blocks > 3
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.page_num, round(r.score, 7)) for r in df.collect())
    assert rows(postings.search(index, queries, k)) == rows(retrieve.bm25_topk(docs, queries, k))
    read, there = postings.postings_read(index, queries, k)
    assert 0 < read <= there and (k > 1 or read < 0.8 * there)


def test_best_against_every_score():
    """One block, weights of any sign, bounds that are exact."""
    rng = np.random.default_rng(5)
    pruned = 0
    for _ in range(200):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 12))
        length = rng.integers(1, 60, n)
        block = postings.Block(np.concatenate([np.arange(n), np.ones(n, np.int64), length]).astype(np.int64).tobytes(), 20.0)
        want, weights = np.zeros(n), []
        for t in range(int(rng.integers(1, 9))):
            own = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.2, 0.9])).astype(np.int32)
            if not len(own):
                continue
            tf = rng.integers(1, 5, len(own)).astype(np.int32)
            value = postings.impact(tf, length[own], 20.0)
            block.add(str(t), value.max(), own.tobytes(), tf.tobytes())
            weights.append((str(t), float(rng.choice([5.0, 1.0, 0.1, 0.0, -0.3]))))
            want[own] += weights[-1][1] * value
        found, score = block.best([*weights, ("absent", 3.0)], k)
        order = np.lexsort((np.arange(n), -np.round(want, 9)))[:k]
        assert sorted(found.tolist()) == sorted(order.tolist()) and np.allclose(np.sort(score), np.sort(want[order]), atol=1e-8)
        pruned += block.read < block.there
    assert pruned > 20


def test_index_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, page_num long, text string")
    index = postings.build_index(docs, scratch_path(spark))
    assert postings.search(index, spark.createDataFrame([(1, "a")], "qid long, text string"), 3).collect() == []
