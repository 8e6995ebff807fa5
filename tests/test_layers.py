"""Batched risk budgets by their first-order conditions and another solver; the two-layer sweep replayed; books day by day."""

import datetime
import math
from collections import defaultdict

import numpy as np
import pytest
from panelspark.operators import book, cluster, daily, leverage, risk
from panelspark.plans import panel as P
from panelspark.queries import layers

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def covariance(rng, n):
    a = rng.normal(size=(3 * n, n))
    return a.T @ a / len(a)


def test_batched_budgets_share_risk_as_told():
    rng = np.random.default_rng(1)
    for n in (2, 4, 7):
        cov = covariance(rng, n) * np.outer(s := rng.uniform(0.01, 3, n), s)
        p = rng.dirichlet(np.ones(n), 40)
        p[3, 0], p[4, 1] = 0.0, 0.0
        p /= p.sum(axis=1, keepdims=True)
        w = risk.risk_budgets(cov, p)
        part = w * (w @ cov)
        np.testing.assert_allclose(part / part.sum(axis=1, keepdims=True), p, atol=1e-9)
        np.testing.assert_allclose(w, [risk.risk_budget(cov, x) for x in p], atol=1e-9)
        np.testing.assert_allclose(risk.naive_budgets(cov, p), [risk.naive_budget(cov, x) for x in p])


def test_share_grid():
    g = risk.share_grid({"a": 0.55, "b": 0.2, "c": 0.1, "d": 0.15})
    assert len(g) == 80 and all(abs(sum(p.values()) - 1) < 1e-12 and min(p.values()) >= 0 for p in g.values())


def descent(cov, p):
    """Risk budgets by cyclical coordinates: another way to the same minimum."""
    w = np.sqrt(p) / np.sqrt(np.diag(cov))
    for _ in range(3000):
        for i in range(len(w)):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] * p[i])) / (2 * cov[i, i])
    return w / w.sum()


def test_two_layer_cell_is_a_replay(spark):
    cell = layers._cell(0.2, 0.3)
    panel = P.panel(spark, SMALL)
    names = layers.group_books(spark, SMALL, [layers.ALL, cell])
    r = layers.group_returns(names, panel)
    got = defaultdict(dict)
    for x in risk.budget_grid(r, {"base": layers.BASE, "equal": layers.EQUAL}, ("erc", "naive"), group="grp", by=["cell"]).collect():
        got[x.cell, x.bar, x.policy, x.method][x.grp] = x.w
    series = defaultdict(dict)
    for x in r.collect():
        series[x.cell, x.bar][x.grp] = x.ret
    order, checked = sorted(layers.BASE), 0
    for c in ("base", cell[0]):
        bars = sorted(b for k, b in series if k == c)
        for i in range(60, len(bars), 37):
            x = np.array([[series[c, b].get(g, math.nan) for g in order] for b in bars[i - 52 : i]], dtype=float)
            if not np.isfinite(x).all():
                continue
            cov = risk.shrunk_covariance(x)
            for policy, shares in (("base", layers.BASE), ("equal", layers.EQUAL)):
                p = np.array([shares[g] for g in order])
                w = got[c, bars[i], policy, "erc"]
                np.testing.assert_allclose([w[g] for g in order], descent(cov, p), atol=1e-7)
                checked += 1
    assert checked >= 6
    # the books of the sweep, by hand
    swept = {x.cell: x for x in layers.swept(spark, SMALL).collect()}
    fwd = {(x.bar, x.code): x.fwd or 0.0 for x in panel.select("bar", "code", "fwd").collect()}
    every = sorted({b for b, _ in fwd})
    weights = defaultdict(dict)
    for x in names.collect():
        if x.cell == cell[0]:
            weights[x.bar][x.code] = x.w * got[cell[0], x.bar, "base", "erc"][x.grp]
    net, turn, before = [], [], {}
    for bar in every:
        w = {c: v for c, v in weights[bar].items() if v}
        t = sum(abs(w.get(c, 0) - before.get(c, 0)) for c in w.keys() | before.keys()) if bar != every[0] else 0.0
        net.append((bar, sum(v * fwd[bar, c] for c, v in w.items()) - 0.001 * t, bool(w)))
        turn.append(t)
        before = w
    first = next(i for i, (_, _, held) in enumerate(net) if held)
    some = [(v, t) for (b, v, _), t in list(zip(net, turn))[first:] if str(b) <= P.IS_END]
    v = np.array([x for x, _ in some])
    row = swept[cell[0]]
    assert row.n_bars == len(v)
    assert row.sharpe_net == pytest.approx(v.mean() / v.std(ddof=1) * math.sqrt(52), rel=1e-6)
    assert row.turnover == pytest.approx(np.mean([t for _, t in some]), rel=1e-6)
    assert row.d_sharpe == pytest.approx(row.sharpe_net - swept["base"].sharpe_net) and swept["base"].d_turnover == 0


def test_exits_and_gaps(spark):
    day = datetime.date(1990, 1, 5)
    bars = [day + datetime.timedelta(weeks=i) for i in range(5)]
    rows = [(0, "a", 0.5), (1, "a", 0.25), (3, "a", 1.0), (4, "a", 1.0), (2, "b", 0.5), (0, "c", 0.5)]
    w = spark.createDataFrame([(bars[i], c, x) for i, c, x in rows], "bar date, code string, w double")
    cal = book.calendar(spark.createDataFrame([(b,) for b in bars], "bar date"))
    got = {(bars.index(r.bar), r.code): (r.w, r.prev) for r in book.changes(w, cal, first="paid").collect()}
    assert got == {(0, "a"): (0.5, 0), (0, "c"): (0.5, 0), (1, "a"): (0.25, 0.5), (1, "c"): (0, 0.5), (2, "a"): (0, 0.25), (2, "b"): (0.5, 0), (3, "a"): (1, 0), (3, "b"): (0, 0.5), (4, "a"): (1, 1)}


def test_days_meet_the_bar_before(spark):
    d = lambda k: datetime.date(1990, 1, 5) + datetime.timedelta(days=k)
    bars = spark.createDataFrame([(d(0),), (d(7),)], "bar date")
    w = spark.createDataFrame([(d(0), "a", 0.5), (d(0), "b", 0.25), (d(7), "a", 1.0)], "bar date, code string, w double")
    px = [(-3, "a", 10.0), (-2, "b", 4.0), (0, "a", 20.0), (1, "a", 22.0), (3, "b", 5.0), (7, "a", 11.0), (8, "a", 22.0), (9, "b", 1.0)]
    got = {r.date: r for r in daily.book_returns(w, spark.createDataFrame([(d(k), c, x) for k, c, x in px], "date date, code string, close double"), bars).collect()}
    assert sorted(got) == [d(1), d(3), d(7), d(8), d(9)]
    assert [got[d(k)].ret for k in (1, 3, 7, 8, 9)] == pytest.approx([0.05, 0.0625, -0.25, 1.0, 0.0])
    # worth 1.05, then 1.1125 of what it was at the bar
    assert [got[d(k)].drifted for k in (1, 3, 7, 8, 9)] == pytest.approx([0.05, 0.0625 / 1.05, 0.5 * (11 - 22) / 20 / 1.1125, 1.0, 0.0])
    assert [got[d(k)].n for k in (1, 9)] == [1, 0]


def test_bivariate_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 80))
    y = 0.3 * x - 0.7 * z + 0.01 + rng.normal(size=80) * 0.2
    rows = [("g", float(a), float(b), float(c)) for a, b, c in zip(y, x, z)] + [("few", 1.0, 2.0, 3.0)] * 3 + [("line", float(i), float(i), 2.0 * i) for i in range(9)] + [("g", None, 1.0, 1.0)]
    got = {r.g: r for r in leverage.bivariate(spark.createDataFrame(rows, "g string, y double, x double, z double"), "y", "x", "z", ["g"]).collect()}
    design = np.column_stack([np.ones(80), x, z])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    r, left = got["g"], y - coef[1] * x - coef[2] * z
    assert (r.alpha, r.beta_x, r.beta_z) == pytest.approx(tuple(coef)) and r.n == 80
    assert r.r2 == pytest.approx(1 - ((y - design @ coef) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r.hedged_sharpe == pytest.approx(left.mean() / left.std(ddof=1) * math.sqrt(52))
    assert got["few"].beta_x is None and got["line"].beta_x is None


def test_built_books_are_a_replay(spark):
    names, w = layers.built(spark, MEDIUM)
    facts = {r.code: (r.block, r.idx) for r in P.instruments(spark, MEDIUM).collect()}
    held = defaultdict(dict)
    for r in names.collect():
        held[r.source, r.bar][r.code] = r.w
    years = defaultdict(dict)
    for r in cluster.refresh(layers.cluster_rows(spark, MEDIUM), ratio=0.2).collect():
        years[r.year][r.code] = r.rep
    moved = 0
    for (source, bar), whole in held.items():
        if source == "whole":
            year = max((y for y in years if y <= bar.year), default=min(years))
            want = defaultdict(float)
            for c, x in whole.items():
                rep = c if facts[c][0] in layers.SCORED else years[year].get(c)
                if rep in whole:
                    want[rep] += x
                    moved += rep != c
            assert held["reps", bar] == pytest.approx(dict(want))
    assert moved
    fwd = {(r.bar, r.code): r.fwd or 0.0 for r in P.panel(spark, MEDIUM).select("bar", "code", "fwd").collect()}
    books = defaultdict(lambda: defaultdict(dict))
    for r in w.collect():
        books[r.cell][r.bar][r.code] = r.w
    assert set(books) == {f"{p}|{s}" for p in ("base", "equal") for s in ("whole", "reps")}
    got = {(f"{r.policy}|{r.source}", r.bar): r for r in layers.built_books(spark, MEDIUM).collect()}
    for cell, bars in books.items():
        before = {}
        for bar in sorted({b for b, _ in fwd}):
            now = bars.get(bar, {})
            turn = [0.0, 0.0]
            for c in now.keys() | before.keys():
                turn[facts[c][0] in layers.BONDS] += abs(now.get(c, 0) - before.get(c, 0))
            before = now
            if (cell, bar) not in got:
                assert not now and not any(turn)
                continue
            r, gross = got[cell, bar], sum(x * fwd[bar, c] for c, x in now.items())
            cost = (turn[1] * 2 + turn[0] * 10) / 1e4
            exposure = sum(x * (1 + facts[c][1] % 7) for c, x in now.items() if facts[c][0] in layers.BONDS)
            assert (r.before_cost, r.turn_bond, r.turn_other, r.after_cost, r.exposure) == pytest.approx((gross, turn[1], turn[0], gross - cost, exposure), abs=2e-6)
            assert r.cash == pytest.approx(max(0, 1 - sum(now.values())), abs=2e-6)
