"""The weekly instrument panel, long and ragged: one row for each instrument and Friday from its first trade on.

On the test tables an instrument is a supplier, its block the region and its index the nation; a close is the week's volume-weighted price. Missing values are NULL. Lags count
weeks of the dense grid, so a week without trades repeats the last close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TINY, div, friday, r
from ..functions.stats import full, rows
from .store import stored

SIGMA_WEEKS = 26
IS_END, OOS_END = "1998-12-31", "2000-06-30"
# Names and first and last day of the evaluation windows; a bar may fall in several.
WINDOWS = [("is", "1900-01-01", IS_END), ("oos", "1999-01-01", OOS_END), ("hold_out", "2000-07-01", "2999-12-31"), ("full", "1900-01-01", OOS_END), ("pooled", "1999-01-01", "2999-12-31")]
FACTORS = ["rev1", "rev4", "mom13", "lowvol", "disc", "amt"]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def windows(spark: SparkSession) -> DataFrame:
    """(window, lo, hi): five rows."""
    return spark.createDataFrame(WINDOWS, "window string, lo string, hi string").select("window", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))


def in_windows(df: DataFrame, bar: str = "bar") -> DataFrame:
    """df with `window`, once for each window its bar is in; the windows are a fixed handful."""
    w = F.broadcast(windows(df.sparkSession))
    return df.join(w, F.col(bar).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, block, idx)."""
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("code"), F.col("n_regionkey").alias("block"), F.col("s_nationkey").alias("idx"))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _vwap() -> Column:
    return div(F.sum(_cents("l_extendedprice")).cast("double"), F.sum("l_quantity")) / 100.0


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, code, close, amount, qty) of days with trades; amount in whole cents, so that sums are exact in any order. Stored, a row for each code and day."""
    return stored(spark, sf_dir, "daily", ("lineitem",), lambda: _daily(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    g = li.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("code"))
    return g.agg(_vwap().alias("close"), F.sum(_cents("l_extendedprice")).alias("amount"), F.sum("l_quantity").alias("qty"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar, code, close, amount, qty, n_rows, discount) of weeks with trades. One pass over lineitem in an application: the result, a row for each code and week, is stored."""
    return stored(spark, sf_dir, "cells", ("lineitem",), lambda: _cells(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    g = li.groupBy(friday("l_shipdate").alias("bar"), F.col("l_suppkey").alias("code"))
    return g.agg(
        _vwap().alias("close"),
        F.sum(_cents("l_extendedprice")).alias("amount"),
        F.sum("l_quantity").alias("qty"),
        F.count("*").alias("n_rows"),
        (F.avg(_cents("l_discount")) / 100.0).alias("discount"),
    )


def grid(some: DataFrame) -> DataFrame:
    """(bar, code) for every Friday from each code's first bar to the last bar of all."""
    last = some.agg(F.max("bar").alias("last"))
    first = some.groupBy("code").agg(F.min("bar").alias("first"))
    return first.crossJoin(F.broadcast(last)).select(F.explode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("bar"), "code")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar, code, block, idx, px, obs, amount, ret, lr, fwd, sigma, member, and the FACTORS).

    amount: whole cents; px: last close up to the bar; fwd: return to the next bar; sigma: 26 weekly log
    returns, all needed; member: traded in at least 4 of the last 13 weeks, and sigma known.
    One shuffle by code serves the dense grid and all windows. The result, a row for each code and week, is stored.
    """
    return stored(spark, sf_dir, "panel", ("lineitem", "supplier", "nation"), lambda: _panel(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    w = Window.partitionBy("code").orderBy("bar")
    # a week with trades and those without up to the next, which stay in the partition of their code
    last = F.broadcast(c.agg(F.max("bar").alias("_last")))
    weeks = F.sequence("bar", F.coalesce(F.date_sub(F.lead("bar").over(w), 7), "_last"), F.expr("interval 7 days"))
    each = c.crossJoin(last).withColumn("_weeks", weeks).withColumn("_bar", F.explode("_weeks"))
    traded = F.col("_bar") == F.col("bar")
    dense = each.select("code", F.col("_bar").alias("bar"), *[F.when(traded, F.col(x)).alias(x) for x in ("close", "amount", "n_rows", "discount")])
    so_far = rows("code", "bar", None, 0)
    p = dense.withColumn("px", F.last("close", ignorenulls=True).over(so_far)).withColumn("obs", F.col("n_rows").isNotNull())
    p = p.withColumn("discount", F.last("discount", ignorenulls=True).over(so_far)).withColumn("amount", F.coalesce("amount", F.lit(0).cast("long")))
    p = p.withColumn("ret", F.col("px") / F.lag("px").over(w) - 1).withColumn("lr", F.ln(F.col("px") / F.lag("px").over(w))).withColumn("fwd", F.lead("px").over(w) / F.col("px") - 1)
    trailing = rows("code", "bar", -(SIGMA_WEEKS - 1))
    p = p.withColumn("sigma", F.round(full(F.stddev_samp("lr"), "lr", trailing, SIGMA_WEEKS), 12)).withColumn("sigma", F.when(F.col("sigma") > TINY, F.col("sigma")))
    p = p.withColumn("member", (F.sum(F.col("obs").cast("int")).over(rows("code", "bar", -12)) >= 4) & F.col("sigma").isNotNull())
    p = p.withColumn("rev1", -F.col("ret") + 0.0).withColumn("rev4", -(F.col("px") / F.lag("px", 4).over(w) - 1) + 0.0).withColumn("mom13", F.col("px") / F.lag("px", 13).over(w) - 1)
    p = p.withColumn("lowvol", -F.col("sigma")).withColumn("disc", F.col("discount")).withColumn("amt", F.avg("amount").over(rows("code", "bar", -7)))
    p = p.select("bar", "code", "px", "obs", "amount", "ret", "lr", "fwd", "sigma", "member", *FACTORS)
    return p.join(instruments(spark, sf_dir), "code")


def members(p: DataFrame) -> DataFrame:
    """Rows that may be held: member, sigma and alpha known."""
    return p.filter(F.col("member") & (F.col("sigma") > 0) & F.col("rev4").isNotNull())


def long_factors(p: DataFrame) -> DataFrame:
    """(bar, code, block, factor, value, fwd, sigma) of members, one row for each factor."""
    return p.filter("member").unpivot(["bar", "code", "block", "fwd", "sigma"], FACTORS, "factor", "value")


def long_factors_by(p: DataFrame, *keys: str) -> DataFrame:
    """`long_factors` dealt by `keys`: a row of the panel is shuffled once, with all factors side by side. explode keeps what unpivot would make Spark forget, where the keys are, so windows by them and the factor shuffle nothing."""
    rest = ["bar", "code", "block", "fwd", "sigma"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in FACTORS]))
    return p.filter("member").select(*rest, *FACTORS).repartition(*keys).select(*rest, each.alias("_f")).select(*rest, "_f.factor", "_f.value")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits for comparison."""
    return df.select(*[r(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])
