"""Frames of the last rows as ordered streams: against plain windows, with streams cut into batches of three rows."""

import datetime
import statistics

import numpy as np
import pytest
from panelspark.functions.scalars import probit
from panelspark.functions.stats import trailing
from panelspark.operators import universe, vol
from panelspark.queries import models
from pyspark.sql import functions as F


@pytest.fixture
def batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def series(seed, lengths=(1, 40, 3, 0, 17), nulls=0.2):
    rng = np.random.default_rng(seed)
    day = datetime.date(1996, 1, 5)
    rows = [(day + datetime.timedelta(7 * i), f"c{c}", None if rng.random() < nulls else int(rng.integers(1, 9))) for c, n in enumerate(lengths) for i in range(n)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("lo", "hi"), [(-6, 0), (-6, -1), (0, 0), (-1, -1)])
def test_trailing_frames(spark, batches, lo, hi):
    rows = series(1)
    df = spark.createDataFrame(rows, "bar date, code string, v long")
    got = {(r.bar, r.code): (r.s, r.k) for r in trailing(trailing(df, "v", "code", "bar", lo, hi, "s", lambda w, there, own: np.where(there, w, 0).sum(axis=1)), "v", "code", "bar", lo, hi, "k", lambda w, there, own: there.sum(axis=1) * 1.0).collect()}
    for bar, code, _ in rows:
        own = [v for b, c, v in sorted(rows, key=lambda r: r[0]) if c == code]
        i = [b for b, c, _ in sorted(rows, key=lambda r: r[0]) if c == code].index(bar)
        want = [v for v in own[max(0, i + lo) : i + hi + 1] if v is not None]
        assert got[bar, code] == (sum(want), len(want))


def test_trailing_median(spark, batches):
    rows = series(2)
    df = spark.createDataFrame(rows, "date date, code string, amount long")
    out = universe.trailing_median(df, days=7, least=3)
    # no exact percentile is built anew for each row
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {(r.date, r.code): r.adv for r in out.collect()}
    for date, code, _ in rows:
        last = [v for d, c, v in sorted(rows, key=lambda r: r[0]) if c == code and d <= date][-7:]
        there = [v for v in last if v is not None]
        assert got[date, code] == (statistics.median(there) if len(there) >= 3 else None)


def test_causal_rank_carries_no_lists(spark, batches):
    rows = series(3, nulls=0.0)
    df = spark.createDataFrame([(b, c, float(v)) for b, c, v in rows], "bar date, code string, rv double")
    out = vol.causal_rank(df, window=5)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for r in out.withColumn("same", probit("u")).collect():
        past = [float(v) for b, c, v in sorted(rows, key=lambda x: x[0]) if c == r.code and b < r.bar][-5:]
        want = (sum(p < r.rv for p in past) + 0.5 * sum(p == r.rv for p in past) + 0.5) / 6 if len(past) == 5 else None
        assert r.u == want and r.g == r.same


def test_unranked_is_ranked_back(spark, batches):
    rows = series(4, nulls=0.0)
    df = spark.createDataFrame([(b, c, float(v), None if i % 3 == 0 else (i % 7 - 3) * 0.9) for i, (b, c, v) in enumerate(rows)], "bar date, code string, lv double, pred double")
    w = "collect_list(lv) OVER (PARTITION BY code ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    want = df.withColumn("past", F.expr(w)).filter("pred is not null").withColumn("sigma", vol.ranked_back(F.col("pred"), F.col("past")))
    got = vol.unranked(df, "pred", window=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.drop("past").collect()))


def test_gate_by_places_is_gate_by_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [(d, c, float(rng.integers(1, 30)) if rng.random() > 0.1 else None, bool(rng.random() > 0.2)) for d in range(12) for c in range(int(rng.integers(1, 25)))]
    df = spark.createDataFrame(rows, "date int, code int, adv double, floor_ok boolean")
    got = {(r.date, r.code): r.pctl_ok for r in universe.percentile_gate(df).collect()}
    on = {}
    for d in range(12):
        pool = [v for x, _, v, ok in rows if x == d and ok and v is not None]
        for _, c, v, ok in (r for r in rows if r[0] == d):
            small = len(pool) < 5
            if ok and (small or v is not None and v >= np.quantile(pool, 0.2)):
                on[c] = True
            elif not ok or v is None or not small and v < np.quantile(pool, 0.15):
                on[c] = False
            assert got[d, c] == on.get(c, False)


def test_pooled_query_carries_no_history(spark):
    assert "history" not in models.har_pooled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
