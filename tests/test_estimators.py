"""Volatility estimators, leverage levels and factor dedup against plain versions."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from panelspark.operators import ic, leverage, vol
from pyspark.sql import functions as F


def series(spark, n, seed=1, nulls=()):
    x = np.random.default_rng(seed).normal(0, 0.02, n)
    day = datetime.date(1990, 1, 5)
    rows = [(1, day + datetime.timedelta(weeks=i), None if i in nulls else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "code long, bar date, x double"), pd.Series([r[2] for r in rows], dtype=float)


@pytest.mark.parametrize("halflife", [0.5, 2.0, 26.0])
def test_ewma_over_many_stretches(spark, halflife):
    df, x = series(spark, 700, nulls={5, 200})
    got = [r.ewma for r in vol.ewma(df, "x", halflife=halflife).orderBy("bar").collect()]
    want = np.sqrt((x**2).ewm(halflife=halflife, min_periods=13).mean() * 52)
    np.testing.assert_allclose(np.array(got, dtype=float), want, rtol=1e-9)


def test_newey_west(spark):
    df, x = series(spark, 120)
    got = np.array([r.nw for r in vol.newey_west(df, "x").orderBy("bar").collect()], dtype=float)

    def plain(v):
        d, n = v - v.mean(), len(v)
        return max(d @ d / n + 2 * sum((1 - k / 5) * (d[k:] @ d[:-k]) / (n - k) for k in range(1, 5)), 0.0)

    want = [np.sqrt(plain(x.to_numpy()[max(0, i - 51) : i + 1]) * 52) if i >= 25 else np.nan for i in range(len(x))]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_level_is_one_while_the_estimate_is_missing(spark):
    df = spark.createDataFrame([(0, None), (1, 0.0), (2, 0.02), (3, 0.06), (4, 0.5)], "i int, s double")
    got = [r.l for r in df.select("i", leverage.level(F.col("s"), 0.08, 2.0).alias("l")).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 0.08 / 0.06, 1.0])


def test_dedup_keeps_the_first_and_names_the_first_conflict(spark):
    ranked = spark.createDataFrame([("x", f, i) for i, f in enumerate("dcba")] + [("y", "a", 0), ("y", "b", 1)], "g string, factor string, pos int")
    rho = spark.createDataFrame([("x", "c", "d", -0.9), ("x", "b", "c", 0.9), ("x", "a", "d", 0.6), ("x", "a", "b", 0.7), ("y", "a", "b", 0.5)], "g string, f1 string, f2 string, rho double")
    got = {(r.g, r.factor): (r.stands_for, r.kept) for r in ic.dedup(ranked, rho, 0.5, ["g"]).collect()}
    assert got == {("x", "d"): ("d", True), ("x", "c"): ("d", False), ("x", "b"): ("b", True), ("x", "a"): ("d", False), ("y", "a"): ("a", True), ("y", "b"): ("b", True)}


@pytest.mark.parametrize("balanced", [True, False])
def test_pooled_forecast_equals_dummies(spark, balanced):
    rng = np.random.default_rng(4)
    day = datetime.date(1990, 1, 5)
    out = []
    for code in range(7):
        for i in range(9 * code, 60):
            if rng.random() < 0.9:
                x = rng.normal(size=2)
                out.append((code % 2, code, day + datetime.timedelta(weeks=i), float(x[0]), float(x[1]), float(x @ [0.5, -0.2] + code + rng.normal() * 0.1) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(out, "block int, code int, bar date, a double, b double, y double")
    got = {(r.code, r.bar): r.pred for r in vol.pooled_forecast(df, ["a", "b"], "y", first=12, every=3, balanced=balanced).collect()}
    want = {}
    full = pd.DataFrame(out, columns=["block", "code", "bar", "a", "b", "y"]).dropna()
    for _, p in full.groupby("block"):
        bars, codes, coef, fitted = sorted(set(p.bar)), sorted(set(p.code)), None, None
        for i, bar in enumerate(bars):
            past, now = p[p.bar < bar], p[p.bar == bar]
            design = lambda q: np.column_stack([(q.code.to_numpy()[:, None] == codes).astype(float), q[["a", "b"]]])
            if i >= 12 and (coef is None or i - fitted >= 3) and len(past) >= len(codes) + 12:
                w = np.sqrt(1 / past.groupby("code").y.transform("size").to_numpy()) if balanced else np.ones(len(past))
                coef, fitted = np.linalg.lstsq(design(past) * w[:, None], past.y * w, rcond=None)[0], i
            if coef is not None:
                want |= dict(zip(zip(now.code, now.bar), design(now) @ coef))
    assert got.keys() == want.keys() and len(got) > 100
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-8)


def test_ranked_back(spark):
    past = np.random.default_rng(2).normal(size=52).tolist()
    df = spark.createDataFrame([(float(g), past) for g in (-9, -1, 0, 0.3, 9)], "g double, past array<double>")
    for r in df.withColumn("s", vol.ranked_back(F.col("g"), F.col("past"))).collect():
        u = min(max(0.5 * (1 + math.erf(r.g / math.sqrt(2))), 1 / 53), 52 / 53)
        assert r.s == pytest.approx(float(np.exp(np.quantile(past, u))), rel=1e-5)
