import math

import numpy as np
import pytest
from panelspark.llm import topk as T


def brute(ids, w, k, queries):
    out = []
    for i in queries:
        s = sorted(((-int(np.dot(w[i], w[j])), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]))[:k]
        out += [(ids[i], r + 1, v, -x) for r, (x, v) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 512])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rnd = np.random.default_rng(block)
    x = rnd.normal(size=(300, 24)) * rnd.uniform(0.1, 3, 24)
    x[50:60] = x[40:50]
    x[100:140] = np.round(x[100])
    ids = list(range(300))
    rows = [(i, [float(c) for c in v], 3, 1) for i, v in zip(ids, x)]
    rows += [(1000, None, 3, 1), (1050, [math.nan] * 24, 3, 1), (1100, [None] + [1.0] * 23, 3, 1), (1150, [math.inf] * 24, 3, 1), (None, [1.0] * 24, 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score int")
    q = T.quantized(df)
    got = sorted(map(tuple, T.search(q, q.filter("vec_id % 10 = 0"), 5, shard_rows=70, query_rows=7).collect()))
    w = np.floor(256 * x).astype(int)
    assert got == brute(ids, w, 5, range(0, 300, 10))


def test_few_rows_and_huge_weights(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**30, -1.0]), (2, [1.0])]
    q = T.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1)
    got = sorted(map(tuple, T.search(q, q.filter("vec_id = 0"), 5).collect()))
    assert got == [(0, 1, 1, 2**60 - 1), (0, 2, 2, 2**30)]
    assert T.search(q.limit(0), q.limit(0), 5).collect() == []


def test_pruning_leaves_postings_unread():
    rnd = np.random.default_rng(1)
    w = np.rint(rnd.normal(size=(4096, 16)) * (1000 / 2.0 ** np.arange(16))).astype(np.int64)
    s = T.Shard(np.arange(4096), w, True)
    ids, scores = s.search(-1, w[7].astype(float), 5)
    want = np.lexsort((np.arange(4096), -(w @ w[7])))[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == (w @ w[7])[want].tolist()
