"""Volatility: realised panels, causal ranks, regressions refitted as time goes on, forecast quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, friday, normcdf, probit, qlike
from ..functions.stats import full, pearson, rows, slope, trailing
from ..plans import store
from . import ridge


def realised(daily: DataFrame, least: int = 3) -> DataFrame:
    """(bar, code, rv): root mean square of the week's daily log returns, annualised; weeks with fewer than `least` of them are missing."""
    r = F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("code").orderBy("date")))
    g = daily.withColumn("r", r).filter("r is not null").groupBy(friday("date").alias("bar"), "code").agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= least).select("bar", "code", F.sqrt(F.col("s") / F.col("n") * 252.0).alias("rv"))


def coverage(rv: DataFrame, least: int = 52) -> DataFrame:
    return rv.groupBy("code").agg(F.count("rv").alias("n"), F.min("bar").alias("first"), F.max("bar").alias("last"), (F.count("rv") >= least).alias("eligible"))


def causal_rank(rv: DataFrame, window: int = 52) -> DataFrame:
    """rv with `g`: normal score of the mid-rank of log volatility among the `window` observations strictly before."""
    x = rv.withColumn("lv", F.round(F.ln(F.greatest("rv", F.lit(1e-6))), 12))

    def share(past: np.ndarray, there: np.ndarray, own: np.ndarray) -> np.ndarray:
        less, same = (past < own[:, None]).sum(axis=1), (past == own[:, None]).sum(axis=1)
        return np.where(there.all(axis=1), (less + 0.5 * same + 0.5) / (window + 1.0), np.nan)

    return trailing(x, "lv", "code", "bar", -window, -1, "u", share).withColumn("g", probit("u"))


def unranked(df: DataFrame, pred: str, value: str = "lv", window: int = 52, name: str = "sigma") -> DataFrame:
    """df's rows with a forecast and `name`: `ranked_back` among the last `window` values up to the row, without a list for each row."""

    def quantile(past: np.ndarray, there: np.ndarray, own: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.full(len(own), np.nan)
        asked = np.flatnonzero(~np.isnan(p))
        past, there = past[asked], there[asked]
        n = there.sum(axis=1)
        s = np.sort(np.where(there, past, np.inf), axis=1)
        u = np.maximum(np.minimum(p[asked], n / (n + 1.0)), 1 / (n + 1.0))
        at, row = u * (n - 1.0), np.arange(len(asked))
        lo, hi = (np.maximum(f(at), 0).astype(np.int64) for f in (np.floor, np.ceil))
        out[asked] = np.where(n > 0, s[row, lo] + (at - lo) * (s[row, hi] - s[row, lo]), np.nan)
        return out

    found = trailing(df.withColumn("_p", normcdf(pred)), value, "code", "bar", -(window - 1), 0, "_q", quantile, "_p")
    return found.filter(F.col(pred).isNotNull()).withColumn(name, F.exp("_q")).drop("_p", "_q")


def har_features(g: DataFrame, value: str = "g") -> DataFrame:
    """g's observed rows with lag1, mean4, mean13 (observed rows only) and the next observation as target."""
    seen = g.filter(F.col(value).isNotNull())
    w = Window.partitionBy("code").orderBy("bar")
    out = seen.withColumn("lag1", F.col(value)).withColumn("mean4", full(F.avg(value), value, rows("code", "bar", -3), 4)).withColumn("mean13", full(F.avg(value), value, rows("code", "bar", -12), 13))
    return out.withColumn("target", F.lead(value).over(w)).withColumn("target_bar", F.lead("bar").over(w))


def unpacked(m, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = m
    return out + np.triu(out, 1).T


def walk_forward(panel: DataFrame, xs: list[str], y: str, first: int = 52, every: int = 4, penalty: float = 0.0, least: int = 0, purge: int = 0, demean_by: str | None = None) -> DataFrame:
    """panel with `pred`: linear forecasts whose coefficients are refitted every `every` dates on all dates before (less `purge`), from `first` dates on.

    Tasks sum the products of features up by the fit that they first enter; each fit adds up the sums that came before it and is solved in a task (`ridge`). Fits
    go back as a short table and meet the rows by date. With `demean_by` rows are taken relative to that key's mean over the rows before the date, a fixed effect that doesn't look ahead.
    """
    names, target = xs, y
    if demean_by:
        before = Window.partitionBy(demean_by).orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
        panel = panel.withColumn("_level", F.coalesce(F.avg(y).over(before), F.lit(0.0)))
        panel = panel.withColumn("_y", F.col(y) - F.col("_level"))
        for x in xs:
            panel = panel.withColumn(f"_{x}", F.col(x) - F.coalesce(F.avg(x).over(before), F.lit(0.0)))
        names, target = [f"_{x}" for x in xs], "_y"
    # read for the dates, the products and the forecasts
    panel = store.cut(panel, "walked")
    whole = panel.dropna(subset=[*names, target])
    placed = store.cut(ridge.folds(whole, first - purge, every, purge), "folds")
    summed = ridge.products(whole.join(F.broadcast(placed.select("bar", "trains")), "bar"), names, target)
    # a row for each fit
    table = F.broadcast(placed.select("bar", "fold").join(ridge.fits(summed, placed.filter("fold is not null"), (penalty,), least).select("fold", "beta"), "fold").drop("fold"))
    forecast = sum((F.col("beta")[i] * F.col(x) for i, x in enumerate(names)), F.lit(0.0))
    if demean_by:
        forecast = forecast + F.col("_level")
    return panel.join(table, "bar", "left").withColumn("pred", forecast).drop("beta", "_level", "_y", *[f"_{x}" for x in xs])


def pooled_forecast(panel: DataFrame, xs: list[str], y: str, group: str = "block", by: str = "code", first: int = 52, every: int = 4, balanced: bool = True, spare: int = 10) -> DataFrame:
    """panel's complete rows with `pred`: least squares of y on xs with a fixed effect of each `by`, pooled in each `group`, refitted as time goes on.

    A group's first fit is at its first date from number `first` on that has more than one row for each coefficient before it (`spare` more), then one
    every `every` dates, each on all earlier dates. `balanced` gives each `by` the same total weight. The effects are swept out: each
    `by`'s running sums of products, taken at the fits, are centred and added up, so that a fit solves for as many numbers
    as there are xs, and the effect is the mean that is left over. A `by` without earlier rows has the effect zero.
    The sums are a row for each `by` and fit, about the panel's rows over `every`.
    """
    some = store.cut(panel.dropna(subset=[*xs, y]), "complete")
    dates = some.groupBy(group, "bar").agg(F.count("*").alias("_n")).join(some.groupBy(group).agg(F.countDistinct(by).alias("_m")), group)
    dates = dates.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy("bar")) - 1).withColumn("_past", F.coalesce(F.sum("_n").over(rows(group, "bar", None, -1)), F.lit(0)))
    start = F.min(F.when((F.col("_i") >= first) & (F.col("_past") >= F.col("_m") + len(xs) + spare), F.col("_i"))).over(Window.partitionBy(group))
    dates = dates.withColumn("_s", start)
    refit = F.when((F.col("_i") >= F.col("_s")) & ((F.col("_i") - F.col("_s")) % every == 0), F.col("bar"))
    later = Window.partitionBy(group).orderBy(F.col("bar").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dates = dates.withColumn("_refit", refit).withColumn("_fit", F.last("_refit", ignorenulls=True).over(rows(group, "bar", None, 0))).withColumn("_enters", F.last("_refit", ignorenulls=True).over(later))
    # a row for each group and date
    dates = store.cut(dates, "dates")
    placed = some.join(F.broadcast(dates.select(group, "bar", "_fit", "_enters")), [group, "bar"])

    names = [*xs, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    parts = {"_c": F.count("*").cast("double")} | {f"_s{i}": F.sum(v) for i, v in enumerate(names)} | {f"_p{i}_{j}": F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs}
    step = placed.filter("_enters is not null").groupBy(group, by, F.col("_enters").alias("_at")).agg(*[v.alias(k) for k, v in parts.items()])
    fits = dates.filter("_refit is not null").select(group, F.col("_refit").alias("_at"))
    step = store.cut(step, "steps")
    every_fit = step.groupBy(group, by).agg(F.min("_at").alias("_lo")).join(F.broadcast(fits), group).filter("_at >= _lo").drop("_lo")
    upto = rows([group, by], "_at", None, 0)
    sums = every_fit.join(step, [group, by, "_at"], "left").select(group, by, "_at", *[F.sum(k).over(upto).alias(k) for k in parts])
    sums = store.cut(sums, "sums")

    weight = 1 / F.col("_c") if balanced else F.lit(1.0)
    centred = [F.sum(weight * (F.col(f"_p{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_c"))) for i, j in pairs]

    @F.pandas_udf("array<double>")
    def solved(m: pd.Series) -> pd.Series:
        def one(v):
            a = unpacked(v, len(names))
            return np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=None)[0].tolist()

        return m.map(one)

    betas = sums.groupBy(group, "_at").agg(F.array(*centred).alias("_m")).select(group, F.col("_at").alias("_fit"), solved("_m").alias("_beta"))
    means = sums.select(group, by, F.col("_at").alias("_fit"), *[(F.col(f"_s{i}") / F.col("_c")).alias(f"_m{i}") for i in range(len(names))])

    def dot(columns: list[str]) -> Column:
        return sum((F.get("_beta", F.lit(i)) * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))

    effect = F.coalesce(F.col(f"_m{len(xs)}") - dot([f"_m{i}" for i in range(len(xs))]), F.lit(0.0))
    out = placed.drop("_enters").join(F.broadcast(betas), [group, "_fit"]).join(means, [group, by, "_fit"], "left").withColumn("pred", effect + dot(xs))
    return out.select(*panel.columns, "pred")


def ranked_back(pred: Column, past: Column) -> Column:
    """The volatility whose normal score among `past` (log values) is pred: the share Phi(pred), kept off the ends, as a linear quantile."""
    n = F.size(past).cast("double")
    u = F.greatest(F.least(normcdf(pred), n / (n + 1)), 1 / (n + 1))
    s = F.sort_array(past)

    def quantile(at: Column) -> Column:
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.get(s, lo) + (at - lo) * (F.get(s, hi) - F.get(s, lo))

    # a lambda's argument is worked out once; written out, the share would stand in the generated code many times
    return F.exp(F.get(F.transform(F.array(u * (n - 1)), quantile), F.lit(0)))


def recalibrated(df: DataFrame, forecast: str, actual: str, first: int = 52, every: int = 4) -> DataFrame:
    """df with `recal`: a + b * forecast, a and b refitted for each code every `every` rows on all rows before."""
    before = Window.partitionBy("code").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    seen = df.filter(F.col(forecast).isNotNull() & F.col(actual).isNotNull())
    i = F.row_number().over(Window.partitionBy("code").orderBy("bar")) - 1
    fitted = seen.withColumn("_i", i).withColumn("_b", slope(actual, forecast, 2, before))
    fitted = fitted.withColumn("_a", F.avg(actual).over(before) - F.col("_b") * F.avg(forecast).over(before))
    refit = (F.col("_i") >= first) & ((F.col("_i") - first) % every == 0)
    upto = rows("code", "bar", None, 0)
    for c in ("_a", "_b"):
        fitted = fitted.withColumn(c, F.last(F.when(refit, F.col(c)), ignorenulls=True).over(upto))
    return fitted.withColumn("recal", F.col("_a") + F.col("_b") * F.col(forecast)).drop("_a", "_b", "_i")


def quality(df: DataFrame, forecast: str, actual: str, by: list[str], least: int = 10) -> DataFrame:
    """(by, n, rmse, mae, qlike, corr, mz_a, mz_b, hit): how good forecasts are; hit: share with the direction from the last actual right."""
    both = df.filter(F.col(forecast).isNotNull() & F.col(actual).isNotNull())
    prior = F.lag(actual).over(Window.partitionBy("code").orderBy("bar"))
    both = both.withColumn("_up", F.signum(F.col(forecast) - prior) * F.signum(F.col(actual) - prior))
    e = F.col(forecast) - F.col(actual)
    b = slope(actual, forecast)
    g = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(qlike(forecast, actual)).alias("qlike"),
        pearson(forecast, actual).alias("corr"),
        (F.avg(actual) - b * F.avg(forecast)).alias("mz_a"),
        b.alias("mz_b"),
        F.avg(F.when(F.col("_up") != 0, (F.col("_up") > 0).cast("double"))).alias("hit"),
    )
    return g.filter(F.col("n") >= least)


def high_recall(df: DataFrame, forecast: str, actual: str, q: float = 0.8, least: int = 20) -> DataFrame:
    """(code, recall, precision) of the highest share of volatilities by each code's own quantiles."""
    both = df.filter(F.col(forecast).isNotNull() & F.col(actual).isNotNull())
    cuts = both.groupBy("code").agg(F.percentile(forecast, F.lit(q)).alias("cf"), F.percentile(actual, F.lit(q)).alias("ca"), F.count("*").alias("n")).filter(F.col("n") >= least)
    j = both.join(cuts, "code").withColumn("f", (F.col(forecast) >= F.col("cf")).cast("int")).withColumn("a", (F.col(actual) >= F.col("ca")).cast("int"))
    return j.groupBy("code").agg(div(F.sum(F.col("f") * F.col("a")).cast("double"), F.sum("a").cast("double")).alias("recall"), div(F.sum(F.col("f") * F.col("a")).cast("double"), F.sum("f").cast("double")).alias("precision"))


def ewma(df: DataFrame, value: str, name: str = "ewma", halflife: float = 26.0, least: int = 13, by: str = "code", scale: float = 52.0) -> DataFrame:
    """df with `name`: annualised root of the exponentially weighted mean square up to and with the row; null before `least` values.

    Ratio of running sums with weights 2**(i/halflife). i starts anew every 64 half-lives, so that weights stay finite however long a
    series is: the stretch before comes in as its total, and what lies before that weighs less than a double can hold.
    """
    stretch = int(64 * halflife)
    order = Window.partitionBy(by).orderBy("bar")
    x = df.withColumn("_i", F.row_number().over(order) - 1).withColumn("_c", F.floor(F.col("_i") / stretch))
    u = F.when(F.col(value).isNotNull(), F.exp((F.col("_i") % stretch) * F.lit(math.log(2) / halflife)))
    x = x.withColumn("_u", u).withColumn("_v", F.col("_u") * F.col(value) * F.col(value)).withColumn("_n", F.count(value).over(rows(by, "bar", None)))
    inside = rows([by, "_c"], "bar", None)
    ended, before = F.col("_i") % stretch == stretch - 1, rows(by, "bar", None, -1)
    parts = []
    for c in ("_v", "_u"):
        x = x.withColumn(c, F.coalesce(F.sum(c).over(inside), F.lit(0.0)))
        parts.append(F.col(c) + F.coalesce(F.last(F.when(ended, F.col(c)), ignorenulls=True).over(before), F.lit(0.0)) * 2.0 ** (-stretch / halflife))
    return x.withColumn(name, F.when(F.col("_n") >= least, F.sqrt(div(parts[0], parts[1]) * scale))).drop("_i", "_c", "_u", "_v", "_n")


def newey_west(df: DataFrame, value: str, name: str = "nw", window: int = 52, lags: int = 4, least: int = 26, by: str = "code", scale: float = 52.0) -> DataFrame:
    """df's rows with a value and `name`: annualised volatility with Bartlett weights on `lags` autocovariances (means over the pairs there are) of the last `window` values; never negative.

    Autocovariances come from moving sums of products with the lagged value: pairs whose earlier value left the window leave the frame.
    """
    order = Window.partitionBy(by).orderBy("bar")
    x = df.filter(F.col(value).isNotNull()).withColumns({f"_l{k}": F.lag(value, k).over(order) for k in range(lags + 1)})
    w = rows(by, "bar", -(window - 1))
    n, mean = F.count(value).over(w).cast("double"), F.avg(value).over(w)
    total = F.lit(0.0)
    for k in range(lags + 1):
        inside = rows(by, "bar", -(window - 1 - k))
        late = F.when(F.col(f"_l{k}").isNotNull(), F.col(value))
        product = F.sum(F.col(value) * F.col(f"_l{k}")).over(inside) - mean * (F.sum(late).over(inside) + F.sum(f"_l{k}").over(inside)) + (n - k) * mean * mean
        total = total + (1.0 if k == 0 else 2 * (1 - k / (lags + 1))) * product / (n - k)
    return x.withColumn(name, F.when(n >= least, F.sqrt(F.greatest(total, F.lit(0.0)) * scale))).drop(*[f"_l{k}" for k in range(lags + 1)])
