import math

import numpy as np
from panelspark.llm import embedding_dedup as E


def brute(ids, labels, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=i)) for i in range(len(ids))])
        if (new == root).all():
            return {ids[i]: (int(link[i].sum()), ids[root[i]]) for i in range(len(ids))}
        root = new


def test_clusters_copies_and_odd_vectors(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 32))
    labels = rnd.integers(0, 3, 900)
    for start, n, noise in ((0, 60, 0.02), (100, 30, 0.15), (200, 200, 0.05)):  # saturated lists
        x[start : start + n] = x[start] + noise * rnd.normal(size=(n, 32))
        labels[start : start + n] = 1
    for i in range(400, 500, 2):
        x[i + 1] = x[i] + 0.2 * rnd.normal(size=32)
        labels[i + 1] = labels[i]
    x[600:620] = x[600]
    labels[600:620] = 2
    x[620] = 3 * x[600]
    labels[620] = 2
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    odd = [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [math.nan] * 32, 1), (2003, rows[0][1], None), (2004, [None] * 32, 1), (2005, [], 1), (2006, rows[0][1][:5], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows + odd + [(None, rows[0][1], 1)]], "vec_id long, embedding array<double>, label int, size int")
    got = {r.vec_id: r for r in E.groups(df).collect()}
    assert len(got) == len(rows) + len(odd) + 1
    want = brute(list(range(900)), labels, x)
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(got[i].n_links for i in want) >= 0.95 * links
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.98 * len(want)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd)
    assert all(got[i].n_links == 20 for i in range(600, 621))
    assert got[None].component_id is None and not got[None].kept


def test_blocks_count_like_one(spark):
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=16)
    rows = [(1, i, [float(c) for c in base + 0.25 * rnd.normal(size=16)], 1 + i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "grp long, node long, vec array<double>, size long")
    a, b = ({r.node: r.linked for r in E.block_counts(df, n).collect()} for n in (7, 1000))
    assert a == b


def test_no_rows(spark):
    assert E.groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []
