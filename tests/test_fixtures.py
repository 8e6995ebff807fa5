"""Small published cases: sizing, percentiles, ramps, blends, accrual, leverage, universe rules."""

import datetime
import math

import numpy as np
import pytest
from panelspark.functions.scalars import ramp, step
from panelspark.functions.stats import rows
from panelspark.operators import book, hysteresis, leverage, metrics, universe, vol
from pyspark.sql import functions as F

DAY = datetime.date(1990, 1, 5)


def bar(i):
    return DAY + datetime.timedelta(weeks=i)


def sizes(spark, alphas, sizing, **kw):
    """Weights by code of names held at one bar."""
    df = spark.createDataFrame([(bar(0), i, a, 0.1) for i, a in enumerate(alphas)], "bar date, code int, alpha double, sigma double")
    held = df.withColumn("side", F.lit(1))
    return [r.w for r in book.sized(held, sizing, ["bar", "side"], **kw).orderBy("code").collect()]


def test_rank_and_alpha_sizing(spark):
    assert sizes(spark, [1.5, 0.7, -0.1, -1.2], "rank_prop") == pytest.approx([0.4, 0.3, 0.2, 0.1])
    assert sizes(spark, [4.0, 2.0, 1.0, 0.0], "alpha_prop") == pytest.approx([5 / 11, 3 / 11, 2 / 11, 1 / 11])
    assert sizes(spark, [1.5, 0.3, -0.4, -1.2], "alpha_prop") == pytest.approx([x / 7.7 for x in (3.375, 2.175, 1.475, 0.675)])
    assert sizes(spark, [0.5, 0.5, 0.5], "alpha_prop") == pytest.approx([1 / 3] * 3)
    assert sizes(spark, [3.0, 2.0, 1.0], "rank_prop", total=0.5) == pytest.approx([0.25, 1 / 6, 1 / 12])


def percentiles(spark, values, weeks):
    df = spark.createDataFrame([(1, bar(i), v) for i, v in enumerate(values)], "code int, bar date, sigma double")
    return [r.p for r in df.withColumn("p", book.trailing_percentile("sigma", weeks)).orderBy("bar").collect()]


def test_trailing_percentile(spark):
    assert percentiles(spark, [0.01, 0.02, 0.03, 0.04, 0.02], 3) == pytest.approx([None, None, 1, 1, 1 / 3])
    assert percentiles(spark, [None, None, 0.01, 0.02, 0.03], 3) == pytest.approx([None, None, None, None, 1])


def test_size_by_volatility_and_its_percentile(spark):
    values = [0.03] * 26 + [0.02]
    df = spark.createDataFrame([(1, bar(i), v) for i, v in enumerate(values)], "code int, bar date, sigma double")
    from panelspark.functions.scalars import kernel

    raw = [r.r for r in df.withColumn("pctl", book.trailing_percentile("sigma")).withColumn("r", kernel("inv_vol_pctl") * F.col("sigma")).orderBy("bar").collect()]
    assert raw[25] == pytest.approx(1 / math.sqrt(2)) and raw[26] == pytest.approx(2 ** (0.5 - 1 / 26))


def test_shares_of_the_aggressive_book(spark):
    p = [0, 0.29, 0.3, 0.45, 0.6, 0.75, 0.9, 0.91, 1, None, 0.9001]
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(p)], "i int, p double")
    got = df.select("i", ramp("p").alias("r"), ramp("p", invert=True).alias("v"), step("p").alias("s")).orderBy("i").collect()
    assert [r.r for r in got[:10]] == pytest.approx([1, 1, 1, 0.75, 0.5, 0.25, 0, 0, 0, 0.5])
    assert [r.v for r in got[:9]] == pytest.approx([1 - r.r for r in got[:9]]) and got[9].v == 0.5
    assert (got[6].s, got[10].s, got[9].s) == (1.0, 0.0, 0.5)


def test_held_through_gaps(spark):
    x = [None, None, 0.4, 0.6, None, None, 0.7, None]
    df = spark.createDataFrame([(1, bar(i), v) for i, v in enumerate(x)], "code int, bar date, x double")
    got = [r.y for r in df.withColumn("y", F.last("x", ignorenulls=True).over(rows("code", "bar", None))).orderBy("bar").collect()]
    assert got == [None, None, 0.4, 0.6, 0.6, 0.6, 0.7, 0.7]


def test_blend_is_a_convex_combination(spark):
    a, b = (spark.createDataFrame([(bar(i), c, 1.0) for i in range(3)], "bar date, code string, w double") for c in "ab")
    share = spark.createDataFrame([(bar(i), s) for i, s in enumerate((1.0, 0.25, 0.0))], "bar date, share double")
    got = {(r.bar, r.code): r.w for r in book.blend(a, b, share).collect()}
    assert [(got[bar(i), "a"], got[bar(i), "b"]) for i in range(3)] == [(1, 0), (0.25, 0.75), (0, 1)]


def test_excess_sharpe_does_not_depend_on_leverage(spark):
    r = np.random.default_rng(0).normal(0.001, 0.02, 200)
    rf = 0.02 / 52
    data = [(f"L{k}", bar(i), float(k * x - (k - 1) * rf), rf) for k in (1, 1.35, 1.5, 2) for i, x in enumerate(r)]
    got = [x.excess for x in metrics.excess_sharpe(spark.createDataFrame(data, "cell string, bar date, net double, rf double"), ["cell"]).collect()]
    assert got == pytest.approx([(r - rf).mean() / r.std(ddof=1) * math.sqrt(52)] * 4, abs=1e-10)


def test_weekly_accrual(spark):
    bars = spark.createDataFrame([(bar(i),) for i in range(12)], "bar date")
    rate = spark.createDataFrame([(DAY + datetime.timedelta(days=d), 0.02) for d in range(90)], "date date, rate double")
    got = [r.accrual for r in leverage.accrual(bars, rate).orderBy("bar").collect()]
    assert got == pytest.approx([0.0] + [0.02 * 7 / 365] * 11)


def test_causal_rank_does_not_look_ahead(spark):
    x = np.random.default_rng(1).lognormal(size=80)

    def ranks(last):
        v = [*x[:-1].tolist(), float(x[-1] + last)]
        df = spark.createDataFrame([(1, bar(i), y) for i, y in enumerate(v)], "code int, bar date, rv double")
        return [r.g for r in vol.causal_rank(df).orderBy("bar").collect()]

    a, b = ranks(0.0), ranks(100.0)
    assert a[:-1] == pytest.approx(b[:-1], abs=1e-10) and a[-1] != b[-1]


def test_forward_scores_skip_nulls(spark):
    from pyspark.sql import Window

    v = [1.0, None, 3.0, 4.0, None, 6.0]
    df = spark.createDataFrame([(1, bar(i), x) for i, x in enumerate(v)], "code int, bar date, rv double")
    w = Window.partitionBy("code").orderBy("bar")
    got = df.select("bar", F.lead("rv").over(w).alias("one"), F.avg("rv").over(w.rowsBetween(1, 4)).alias("four")).orderBy("bar").collect()
    assert [r.one for r in got] == [None, 3.0, 4.0, None, 6.0, None]
    assert [r.four for r in got] == pytest.approx([3.5, 13 / 3, 5, 6, 6, None])


def test_without_a_band_memory_is_the_static_book(spark):
    rng = np.random.default_rng(5)
    data = [(bar(i), c, float(rng.normal()), float(rng.uniform(0.01, 0.05))) for i in range(20) for c in range(12) if rng.random() < 0.7]
    df = spark.createDataFrame(data, "bar date, code long, alpha double, sigma double")
    static = {(r.bar, r.code): r.w for r in book.static_weights(df, 0.3).collect()}
    held = hysteresis.replace_book(df, df.select("bar"), 0.3, 0.0, trim="worst_rank").join(df, ["bar", "code"])
    memory = {(r.bar, r.code): r.w for r in book.sized(held, "inv_vol", ["bar"]).collect()}
    buffered = {(r.bar, r.code) for r in hysteresis.buffer_book(df.drop("sigma"), 0.3, 0.0, df.select("bar")).collect()}
    assert memory.keys() == static.keys() == buffered
    assert all(memory[k] == pytest.approx(static[k], abs=1e-10) for k in static)


# --- universe --------------------------------------------------------------------------------------------------------


def days(n, start=datetime.date(2018, 6, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += datetime.timedelta(days=1)
    return out


def test_floor_with_memory(spark):
    """One always liquid, one never, one that falls between the two floors and stays, one that falls below both."""
    d = days(300)
    amounts = {"A": lambda i: 1e9, "B": lambda i: 1e6, "H": lambda i: 1e8 if i < 150 else 1.5e7, "O": lambda i: 1e8 if i < 150 else 5e6}
    df = spark.createDataFrame([(c, x, float(f(i))) for c, f in amounts.items() for i, x in enumerate(d)], "code string, date date, amount double")
    got = universe.hysteresis_floor(universe.trailing_median(df), "adv", 2e7, 1e7).collect()
    by = {(r.code, r.date): r.floor_ok for r in got}
    assert all(by["A", x] == (i >= 29) for i, x in enumerate(d)) and not any(by["B", x] for x in d)
    assert all(by["H", x] for x in d[29:]) and by["O", d[160]] and not by["O", d[-1]]


def test_challenger_needs_a_quarter_more(spark):
    def held(volumes):
        data = [(bar(i), 1, c, float(v)) for i, row in enumerate(volumes) for c, v in row.items()]
        df = spark.createDataFrame(data, "bar date, idx int, code int, adv double")
        return [r.code for r in universe.representatives(df).orderBy("bar").collect()]

    # 8 % more doesn't take over, 40 % does, and then it stays
    assert held([{1: 1.0, 2: 0.8}, {1: 1.0, 2: 1.08}, {1: 1.0, 2: 1.4}, {1: 1.2, 2: 1.0}]) == [1, 1, 2, 2]
    # an incumbent that is not eligible any more leaves
    assert held([{1: 1.0, 2: 0.8}, {2: 0.8}, {1: 0.9, 2: 0.8}]) == [1, 2, 2]


def test_no_member_after_delisting(spark):
    cat = spark.createDataFrame([("D", datetime.date(2018, 1, 5), datetime.date(2020, 6, 15)), ("L", datetime.date(2018, 1, 5), None)], "code string, list_date date, delist_date date")
    df = spark.createDataFrame([(c, x) for c in "DL" for x in days(700)], "code string, bar date")
    got = {(r.code, r.bar) for r in universe.seasoned(df, cat).collect()}
    last = max(b for c, b in got if c == "D")
    first = min(b for c, b in got if c == "L")
    assert last < datetime.date(2020, 6, 15) and first >= datetime.date(2018, 7, 6) and max(b for c, b in got if c == "L") == days(700)[-1]
