"""Dense groups whose lists are full of their own members, and audits that never pass."""

import numpy as np
import pytest
from panelspark.llm import embedding_dedup as E

from .test_embedding_dedup import brute


@pytest.mark.parametrize("recall", [E.RECALL, 2.0])
def test_two_tight_groups_of_fifty(spark, monkeypatch, recall):
    monkeypatch.setattr(E, "TRIES", 1)
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(160, 32))
    for start, c in ((0, 1.0), (50, 0.955)):
        noise = rnd.normal(size=(50, 32))
        noise[:, :2] = 0
        x[start : start + 50] = 0.1005 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
        x[start : start + 50, :2] += (c, np.sqrt(1 - c * c))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cross = u[:50] @ u[50:100].T
    assert 0.93 < cross.min() and 0.94 < cross.mean() < 0.95
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.groups(df, recall=recall).collect()}
    assert got == brute(list(range(160)), np.ones(160, int), x)
    assert {got[i] for i in range(100)} == {(99, 0)}


@pytest.mark.parametrize("most,whole", [(160, set()), (40, {60, 90})])
def test_lists_grow_until_they_hold_all_links(spark, monkeypatch, most, whole):
    """Groups larger than a list: only those that no list may hold are compared with all of their label."""
    monkeypatch.setattr(E, "LIST_MOST", most)
    rnd = np.random.default_rng(4)
    x, group = rnd.normal(size=(400, 24)), np.full(400, -1)
    at = 0
    for n in (12, 25, 30, 60, 90):
        x[at : at + n] = x[at] + 0.03 * rnd.normal(size=(n, 24))
        group[at : at + n] = n
        at += n
    asked = []
    real = E.bridges
    monkeypatch.setattr(E, "bridges", lambda points, full, *a: asked.append({r.node for r in full.collect()}) or real(points, full, *a))
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.groups(df).collect()}
    assert got == brute(list(range(400)), np.ones(400, int), x)
    assert len(asked) == 1 and {int(group[i]) for i in asked[0]} == whole
