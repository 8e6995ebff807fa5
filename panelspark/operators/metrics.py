"""Performance of return series over windows and years. Net asset value is of constant notional, 1 + the sum of returns, unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WEEKS, div
from ..functions.stats import rows


def with_drawdown(df: DataFrame, by: list[str], value: str = "net", compounded: bool = False, relative: bool = True) -> DataFrame:
    """df with nav, peak and dd within `by`, ordered by bar."""
    w = rows(by, "bar", None, 0)
    nav = F.exp(F.sum(F.ln(1 + F.col(value))).over(w)) if compounded else 1 + F.sum(value).over(w)
    out = df.withColumn("nav", nav).withColumn("peak", F.max("nav").over(w))
    gap = F.col("nav") - F.col("peak")
    return out.withColumn("dd", div(gap, F.col("peak")) if relative else gap)


def stats(value: str = "net") -> list[Column]:
    """Aggregates over rows that have `value` and dd: fewer than two bars give zeros."""
    n = F.count(value)
    enough = n >= 2
    vol = F.stddev_samp(value) * F.sqrt(F.lit(float(WEEKS)))
    ret = F.avg(value) * WEEKS
    total = F.sum(value)
    cagr = F.pow(F.greatest(1 + total, F.lit(1e-9)), 1 / F.greatest(n / float(WEEKS), F.lit(1e-3))) - 1

    def some(c: Column) -> Column:
        return F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    return [n.alias("n_bars"), some(ret).alias("ann_ret"), some(vol).alias("ann_vol"), some(div(ret, vol)).alias("sharpe"), some(total).alias("cum_ret"), some(cagr).alias("cagr"), some(F.min("dd")).alias("max_dd")]


def window_stats(df: DataFrame, by: list[str], value: str = "net") -> DataFrame:
    """df(by, bar, value), by with the window's name: performance in each; drawdowns start anew in each window."""
    return with_drawdown(df, by, value).groupBy(*by).agg(*stats(value))


def excess_sharpe(df: DataFrame, by: list[str], value: str = "net", rate: str = "rf") -> DataFrame:
    """(by, raw, excess): mean over deviation, and mean less the rate over the same deviation."""
    both = df.filter(F.col(value).isNotNull() & F.col(rate).isNotNull())
    sd, root = F.stddev_samp(value), F.sqrt(F.lit(float(WEEKS)))
    return both.groupBy(*by).agg((div(F.avg(value), sd) * root).alias("raw"), (div(F.avg(F.col(value) - F.col(rate)), sd) * root).alias("excess"))


def yearly_on_continuous_nav(df: DataFrame, value: str = "net", by: list[str] | None = None) -> DataFrame:
    """(by, year, dd, trough, peak_bar, recovery_weeks): each year's deepest drawdown from the highest value ever before, where that was, and how long until it is reached again."""
    by = by or []
    part = by or [F.lit(0)]
    nav = with_drawdown(df, by, value) if by else with_drawdown(df.withColumn("_one", F.lit(0)), ["_one"], value)
    w = Window.partitionBy(*part).orderBy("bar")
    at_peak = F.last(F.when(F.col("nav") >= F.col("peak"), F.col("bar")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(F.when(F.col("nav") >= F.col("peak"), F.col("bar")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = nav.withColumn("peak_bar", at_peak).withColumn("back", back).withColumn("year", F.year("bar"))
    g = marked.groupBy(*by, "year").agg(F.min_by(F.struct("dd", "bar", "peak_bar", "back"), F.struct("dd", "bar")).alias("t"))
    return g.select(*by, "year", F.col("t.dd").alias("dd"), F.col("t.bar").alias("trough"), F.col("t.peak_bar").alias("peak_bar"), F.when(F.col("t.dd") < 0, (F.datediff("t.back", "t.bar") / 7).cast("int")).alias("recovery_weeks"))


def episodes(df: DataFrame, value: str = "net", depth: float = -0.02, by: str | None = None) -> DataFrame:
    """(start, trough, end, depth) of maximal stretches below the running peak that reach `depth`."""
    key = [by] if by else ["_one"]
    base = df if by else df.withColumn("_one", F.lit(0))
    nav = with_drawdown(base, key, value)
    w = rows(key, "bar", None, 0)
    runs = nav.withColumn("run", F.sum((F.col("dd") >= 0).cast("int")).over(w)).filter("dd < 0")
    g = runs.groupBy(*key, "run").agg(F.min("bar").alias("start"), F.min_by("bar", F.struct("dd", "bar")).alias("trough"), F.max("bar").alias("end"), F.min("dd").alias("depth"))
    return g.filter(F.col("depth") <= depth).drop("run", *([] if by else ["_one"]))


def runs(df: DataFrame, state: str, by: list[str]) -> DataFrame:
    """(by, run, state, start, end, length): maximal stretches of one state in the order of bars."""
    w = Window.partitionBy(*by).orderBy("bar")
    changed = F.coalesce(~F.col(state).eqNullSafe(F.lag(state).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = df.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w))
    return marked.groupBy(*by, "run", state).agg(F.min("bar").alias("start"), F.max("bar").alias("end"), F.count("*").alias("length"))


def without(df: DataFrame, strips: list[tuple[str, str, str]]) -> DataFrame:
    """df with `strip`: once as it is (`none`), once without each of (name, from, to), once without all of them (`all`). The ranges are a short list."""
    inside = {n: F.col("bar").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))) for n, a, b in strips}
    every = reduce(or_, inside.values())
    kept = F.array(F.lit("none"), *[F.when(~c, n) for n, c in inside.items()], F.when(~every, "all"))
    return df.withColumn("strip", F.explode(F.array_compact(kept)))


def cost_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """A row for each of `by`: gross and net performance, what trading costs in basis points a year, and which part of turnover is resizing. df: see book.attributed, of at least two bars each."""
    root, year = F.sqrt(F.lit(float(WEEKS))), float(WEEKS) * 1e4
    n = F.count("*")
    out = [n.alias("n_bars")]
    for side in ("gross", "net"):
        mean, total = F.avg(side), F.sum(side)
        cagr = F.pow(F.greatest(1 + total, F.lit(1e-9)), 1 / F.greatest(n / float(WEEKS), F.lit(1e-3))) - 1
        out += [F.coalesce(div(mean, F.stddev_samp(side)) * root, F.lit(0.0)).alias(f"{side}_sharpe"), (mean * WEEKS).alias(f"{side}_ann_ret"), cagr.alias(f"{side}_cagr")]
    means = {"turnover": "turnover", "selection": "selection", "sizing": "sizing", "held": "n_held", "held_change": "d_held"}
    out += [(F.avg("cost") * year).alias("cost_bp"), *[F.avg(c).alias(a) for a, c in means.items()]]
    dear = F.when(F.avg("gross") > 0, F.avg("cost") / F.avg("gross"))
    return df.groupBy(*by).agg(*out, F.coalesce(div(F.avg("sizing"), F.avg("turnover")), F.lit(0.0)).alias("sizing_share"), dear.alias("cost_of_gross")).filter("n_bars >= 2")
