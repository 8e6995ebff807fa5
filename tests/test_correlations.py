"""Correlations of factors from sums made in tasks, and ranks with ties, against numpy and plain versions."""

import datetime
import math
import random

import numpy as np
import pytest
from panelspark.functions import stats
from panelspark.operators import ic

DAY = datetime.date(1990, 1, 5)


@pytest.mark.parametrize("by", [[], ["block"], ["block", "kind"]])
def test_pairs_equal_numpy(spark, by):
    rng = np.random.default_rng(4)
    rows, cells = [], {}
    for i in range(300):
        bar, code, block, kind = DAY + datetime.timedelta(weeks=i % 30), i // 30, [0, 1, None][i % 3], "xy"[i % 2]
        base = rng.normal()
        for f, v in (("a", base), ("b", base + rng.normal()), ("c", 1.5), ("d", rng.normal() * 1e6), ("e", None if i % 5 else float(i)), ("f", math.nan if i % 7 == 0 else -base)):
            if rng.random() < 0.9:
                rows.append((bar, code, block, kind, f, None if v is None else float(v)))
                if v is not None and math.isfinite(v):
                    cells.setdefault(tuple({"block": block, "kind": kind}[c] for c in by), {}).setdefault((bar, code), {})[f] = v
    df = spark.createDataFrame(rows, "bar date, code int, block int, kind string, factor string, value double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # many batches, whose factors come in any order
    try:
        got = {(*(r[c] for c in by), r.f1, r.f2): (r.rho, r.n) for r in ic.correlations(df, 5, by=by).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, some in cells.items():
        for f1 in "abcdef":
            for f2 in "abcdef"[ord(f1) - 96 :]:
                pairs = np.array([(m[f1], m[f2]) for m in some.values() if f1 in m and f2 in m])
                if len(pairs):
                    flat = len(pairs) < 5 or min(np.ptp(pairs[:, 0]), np.ptp(pairs[:, 1])) == 0
                    want[(*g, f1, f2)] = (0.0 if flat else np.corrcoef(pairs.T)[0, 1], len(pairs))
    assert got.keys() == want.keys()
    for k, (rho, n) in want.items():
        assert got[k] == (pytest.approx(rho, abs=1e-9), n)


def test_no_pairs(spark):
    df = spark.createDataFrame([(DAY, 1, "a", 1.0), (DAY, 2, "b", 1.0), (DAY, 3, "c", None)], "bar date, code int, factor string, value double")
    assert ic.correlations(df).collect() == [] and ic.correlations(df.limit(0)).collect() == []


def test_ranks_share_their_mean(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, -0.0, 0.0, 1.5, -2.0, 7.0])) for g in range(4) for i in range(25)]
    got = {(r.g, r.i): r.k for r in stats.average_rank(spark.createDataFrame(rows, "g int, i int, x double"), "x", ["g"], "k").collect()}
    for g, i, x in rows:
        some = [y for h, _, y in rows if h == g and y is not None]
        assert got[g, i] == (None if x is None else sum(y < x for y in some) + (sum(y == x for y in some) + 1) / 2)
