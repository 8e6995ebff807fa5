"""Books day by day: what the weights of a bar earn on the trading days up to the next bar, and how well volatility estimators agree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WEEKS, div
from ..functions.stats import full, rows
from . import universe, vol

DAYS = 252


def bars_of_days(days: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, bar) of days(date): the last bar before the day, whose weights earn its return; days up to the first bar have none. One row a day."""
    marks = days.select("date", F.lit(None).cast("date").alias("bar")).union(bars.select(F.date_add("bar", 1), "bar"))
    w = Window.partitionBy(F.lit(0)).orderBy("date", F.col("bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.select("date", F.col("bar").isNull().alias("_day"), F.last("bar", ignorenulls=True).over(w).alias("bar"))
    return found.filter(F.col("_day") & F.col("bar").isNotNull()).select("date", "bar")


def book_returns(w: DataFrame, daily: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, bar, ret, drifted, n) of every trading day after the book's first bar.

    w(bar, code, w), daily(date, code, close), bars(bar). ret: weights stay what they were at the bar; drifted: they move with the prices inside
    it, as a share of what the book is worth at the day before, cash included. A name that doesn't trade on a day earns nothing on it; n counts those that do.
    Days meet their bar by a sorted union of the two calendars, names meet their weights by (bar, code): no range join.
    """
    first = w.agg(F.min("bar").alias("_first"))
    days = bars_of_days(daily.select("date").distinct(), bars.select("bar").distinct()).crossJoin(F.broadcast(first)).filter("bar >= _first").drop("_first")
    order = Window.partitionBy("code").orderBy("date")
    moves = daily.withColumn("prev", F.lag("close").over(order)).filter("prev is not null").join(F.broadcast(days), "date")
    moves = moves.withColumn("base", F.first("prev").over(rows(["code", "bar"], "date", None, 0)))
    held = moves.join(w.select("bar", "code", "w"), ["bar", "code"])
    earned = held.groupBy("date").agg(F.sum(F.col("w") * (F.col("close") / F.col("prev") - 1)).alias("ret"), F.sum(F.col("w") * (F.col("close") - F.col("prev")) / F.col("base")).alias("_pnl"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    every = days.join(earned, "date", "left").select("date", "bar", F.coalesce("ret", zero).alias("ret"), F.coalesce("_pnl", zero).alias("_pnl"), F.coalesce("n", F.lit(0)).alias("n"))
    so_far = F.coalesce(F.sum("_pnl").over(rows("bar", "date", None, -1)), zero)
    return every.withColumn("drifted", div(F.col("_pnl"), 1 + so_far)).select("date", "bar", "ret", "drifted", "n")


def rolling_std(df: DataFrame, value: str, name: str, window: int, least: int, scale: float) -> DataFrame:
    """df with `name`: annualised deviation of the last `window` rows, null with fewer than `least` values."""
    return df.withColumn(name, full(F.stddev_samp(value), value, rows("one", "bar", -(window - 1)), least) * F.sqrt(F.lit(scale)))


def estimates(weekly: DataFrame, days: DataFrame) -> DataFrame:
    """(bar, estimator, est, ret, fwd4, fwd13): four estimators of a book's volatility on the axis of its bars, and what its returns did over the next bars.

    weekly(bar, ret), days(date, ret): the same book's series. Those of days are taken as of the bar. One series each, a row a bar or day.
    """
    one = F.lit(0).alias("one")
    w = weekly.select("bar", "ret", one)
    w = vol.ewma(w, "ret", "weekly_ewma", by="one")
    w = w.join(vol.newey_west(weekly.select("bar", "ret", one), "ret", "weekly_newey_west", by="one").select("bar", "weekly_newey_west"), "bar", "left")
    for h in (4, 13):
        ahead = Window.partitionBy("one").orderBy("bar").rowsBetween(1, h)
        w = w.withColumn(f"fwd{h}", F.when(F.count("ret").over(ahead) == h, F.stddev_samp("ret").over(ahead)) * F.sqrt(F.lit(float(WEEKS))))
    d = days.select(F.col("date").alias("bar"), "ret", one)
    d = vol.ewma(d, "ret", "daily_ewma", halflife=30.0, least=30, by="one", scale=float(DAYS))
    d = rolling_std(d, "ret", "daily_60d", 60, 30, float(DAYS))
    for name in ("daily_ewma", "daily_60d"):
        w = universe.as_of(w, d.select("one", F.col("bar").alias("date"), name), name, by="one")
    return w.unpivot(["bar", "ret", "fwd4", "fwd13"], ["weekly_ewma", "weekly_newey_west", "daily_ewma", "daily_60d"], "estimator", "est")


def calibration(est: DataFrame, by: list[str], band: float = 0.1, near: float = 0.25) -> DataFrame:
    """(by, n, est, realised, ratio, bias, hit, and mean, median and 95th percentile of est over what came in 4 and 13 bars, qualifies).

    ratio: mean estimate over the deviation of the same bars' returns, needing 8 of both; it qualifies within `band` of one. bias: mean of est less what came; hit: share of
    bars whose estimate is within `near` of it.
    """
    e, year = F.col("est"), F.sqrt(F.lit(float(WEEKS)))
    enough = (F.count("est") >= 8) & (F.count("ret") >= 8)
    mean, real = F.when(enough, F.avg("est")), F.when(enough, F.stddev_samp("ret") * year)
    ratio = div(mean, real)

    def shape(h: int) -> list[Column]:
        r = div(e, F.col(f"fwd{h}"))
        some = F.count(r) >= 4
        return [F.when(some, c).alias(f"fwd{h}_{n}") for n, c in (("mean", F.avg(r)), ("p50", F.percentile(r, F.lit(0.5))), ("p95", F.percentile(r, F.lit(0.95))))]

    gap = F.abs(div(e, F.col("fwd13")) - 1)
    return est.groupBy(*by).agg(
        F.count("est").alias("n"),
        mean.alias("est"),
        real.alias("realised"),
        ratio.alias("ratio"),
        F.avg(e - F.col("fwd13")).alias("bias"),
        F.avg(F.when(gap.isNotNull(), (gap <= near).cast("double"))).alias("hit"),
        *shape(4),
        *shape(13),
        F.coalesce(ratio.between(1 - band, 1 + band), F.lit(False)).alias("qualifies"),
    )
