"""The grid of ridge regressions against plain fits of each fold."""

import datetime

import numpy as np
import pytest
from panelspark.operators import ridge as R

DAY = datetime.date(1990, 1, 5)
FIRST, EVERY, PURGE = 10, 4, 2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(33):
        for c in range(6):
            x = rng.normal(size=3)
            y = float(x @ [0.5, -1, 0.1] + rng.normal())
            out.append((DAY + datetime.timedelta(weeks=i), c, *map(float, x), None if rng.random() < 0.1 else y))
    out[40] = (*out[40][:3], None, *out[40][4:])
    return out


def test_every_fold_and_penalty(spark, rows):
    df = spark.createDataFrame(rows, "bar date, code int, a double, b double, c double, y double")
    xs = ["a", "b", "c"]
    placed = R.folds(df, FIRST, EVERY, PURGE)
    summed = R.products(df.dropna().join(placed.select("bar", "trains"), "bar"), xs, "y")
    fitted = R.fits(summed, placed.filter("fold is not null"), (0.01, 3.0), least=20)
    got = {(r.fold, r.alpha): r for r in fitted.collect()}
    preds = {(r.bar, r.code, r.alpha): r.pred for r in R.forecasts(df, placed, fitted, xs).collect()}
    bars = sorted({r[0] for r in rows})
    whole = [r for r in rows if None not in r]
    start, fold, want = FIRST + PURGE, 0, {}
    while start < len(bars):
        x = np.array([r[2:5] for r in whole if r[0] <= bars[start - PURGE - 1]])
        y = np.array([r[5] for r in whole if r[0] <= bars[start - PURGE - 1]])
        for a in (0.01, 3.0):
            beta = np.linalg.solve(x.T @ x + a * np.eye(3), x.T @ y)
            np.testing.assert_allclose(got[fold, a].beta, beta, rtol=1e-9)
            assert got[fold, a].n == len(y)
            want |= {(r[0], r[1], a): float(np.dot(r[2:5], beta)) for r in rows if r[0] in bars[start : start + EVERY] and None not in r[2:5]}
        start, fold = start + EVERY, fold + 1
    assert len(got) == 2 * fold and preds.keys() == want.keys()
    np.testing.assert_allclose([preds[k] for k in want], list(want.values()), rtol=1e-9)


def test_least_rows_and_none(spark, rows):
    df = spark.createDataFrame(rows, "bar date, code int, a double, b double, c double, y double")
    placed = R.folds(df, FIRST, EVERY, PURGE)
    summed = R.products(df.dropna().join(placed.select("bar", "trains"), "bar"), ["a"], "y")
    n = {r.fold: r.n for r in R.fits(summed, placed.filter("fold is not null"), (1.0,), least=100).collect()}
    assert min(n.values()) >= 100 and min(n) > 0
    none = R.products(df.limit(0).withColumn("trains", df.code), ["a"], "y")
    assert R.fits(none, placed, (1.0,)).collect() == []


def test_stability(spark):
    rows = [(f, 1.0, 9, [float(b), 0.0]) for f, b in enumerate([-5, 1, 2, 3, -1, 4])]
    got = {r.factor: r for r in R.stability(spark.createDataFrame(rows, "fold int, alpha double, n long, beta array<double>"), ["a", "b"]).collect()}
    assert (got["a"].median, got["a"].sign, got["a"].matches, got["a"].of) == (2.0, 1, 4, 5)
    assert (got["b"].sign, got["b"].matches) == (0, 0)


def test_walk_forward_with_levels(spark, rows):
    """Least squares on what is left over a name's mean before the date, refitted as time goes on."""
    from panelspark.operators import vol

    df = spark.createDataFrame(rows, "bar date, code int, a double, b double, c double, y double")
    got = {(r.bar, r.code): r.pred for r in vol.walk_forward(df, ["a", "b"], "y", first=10, every=4, purge=1, demean_by="code").collect()}
    assert len(got) == len(rows)
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    past, left = {}, []
    for r in sorted(rows):
        before = past.setdefault(r[1], ([], [], []))
        level = [mean(x) for x in before]
        left.append((r[0], r[1], *(None if v is None else v - m for v, m in zip((r[2], r[3], r[5]), level)), level[2]))
        for x, v in zip(before, (r[2], r[3], r[5])):
            if v is not None:
                x.append(v)
    bars = sorted({r[0] for r in left if None not in r})
    beta, checked = None, 0
    for i, bar in enumerate(bars):
        if i >= 10 and (i - 10) % 4 == 0:
            train = [r for r in left if None not in r and r[0] in bars[: i - 1]]
            beta = np.linalg.lstsq(np.array([r[2:4] for r in train]), np.array([r[4] for r in train]), rcond=None)[0]
        for r in left:
            if r[0] == bar:
                if beta is None or r[2] is None or r[3] is None:
                    assert got[r[0], r[1]] is None
                else:
                    assert got[r[0], r[1]] == pytest.approx(float(np.dot(r[2:4], beta)) + r[5])
                    checked += 1
    assert checked > 80
