"""Who is in the universe when: liquidity floors with memory, seasoning, one name for each index, change events."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import full, rows, trailing
from ..plans import store


def trailing_median(daily: DataFrame, value: str = "amount", days: int = 60, least: int = 30) -> DataFrame:
    """daily with `adv`: the median of the last `days` rows of each code, null with fewer than `least` values."""

    def median(window: np.ndarray, there: np.ndarray, own: np.ndarray) -> np.ndarray:
        n = there.sum(axis=1)
        x = np.sort(np.where(there, window, np.inf), axis=1)
        row, last = np.arange(len(x)), np.maximum(n - 1, 0)
        return np.where(n >= max(least, 1), x[row, last // 2] * 0.5 + x[row, (last + 1) // 2] * 0.5, np.nan)

    return trailing(daily, value, "code", "date", -(days - 1), 0, "adv", median)


def trailing_mean(daily: DataFrame, value: str = "amount", days: int = 63, least: int = 21) -> DataFrame:
    return daily.withColumn("adv", full(F.avg(value), value, rows("code", "date", -(days - 1)), least))


def as_of(left: DataFrame, right: DataFrame, value: str, by: str = "code", at: str = "bar", date: str = "date") -> DataFrame:
    """left(by, at) with the last non-null `value` of right(by, date) on or before `at`.

    A union sorted by day in one shuffle by key: no range join, no pairs. right's rows come first on ties.
    """
    names = left.columns
    marked = left.select(F.col(by), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*names).alias("_row"))
    facts = right.select(F.col(by), F.col(date).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = marked.unionByName(facts).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return merged.select("_row.*", value)


def carried(enter: Column, leave: Column, by: str, order: str) -> Column:
    """A gate with two thresholds: on where `enter`, off where `leave`, as before elsewhere; off at first. A null test is false."""
    event = F.when(F.coalesce(enter, F.lit(False)), True).when(F.coalesce(leave, F.lit(False)), False)
    return F.coalesce(F.last(event, ignorenulls=True).over(rows(by, order, None, 0)), F.lit(False))


def hysteresis_floor(df: DataFrame, value: str, enter: float, stay: float, by: str = "code", order: str = "date", name: str = "floor_ok") -> DataFrame:
    """In from `enter` on while at least `stay`; a missing value puts a name out."""
    v = F.col(value)
    return df.withColumn(name, carried(v >= enter, v.isNull() | (v < stay), by, order))


def percentile_gate(df: DataFrame, value: str = "adv", enter: float = 0.2, stay: float = 0.15, least: int = 5, order: str = "date") -> DataFrame:
    """df(code, date, value, floor_ok) with `pctl_ok`: above the `enter` quantile of those that pass the floor, then above `stay`; with fewer than `least` of them the floor alone decides."""
    df = store.cut(df, "floors")
    # quantiles from the places next to them in order, so that a day's values are sorted, not held
    each = Window.partitionBy(order)
    pool = df.filter(F.col("floor_ok") & F.col(value).isNotNull()).select(order, F.col(value).cast("double").alias("_v"))
    pool = pool.withColumn("_i", F.row_number().over(each.orderBy("_v")) - 1).withColumn("pool", F.count("*").over(each))

    def quantile(q: float) -> Column:
        p = F.lit(q) * (F.col("pool") - 1)
        low, high = (F.max(F.when(F.col("_i") == f(p), F.col("_v"))) for f in (F.floor, F.ceil))
        p = F.lit(q) * (F.max("pool") - 1)
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    cuts = pool.groupBy(order).agg(F.array(quantile(enter), quantile(stay)).alias("cuts"), F.max("pool").alias("pool"))
    # a row for each day
    j = df.join(F.broadcast(cuts), order, "left")
    small = F.coalesce(F.col("pool") < least, F.lit(True))
    v, ok = F.col(value), F.coalesce(F.col("floor_ok"), F.lit(False))
    event_in = ok & (small | (v >= F.col("cuts")[0]))
    event_out = ~ok | v.isNull() | (~small & (v < F.col("cuts")[1]))
    return j.withColumn("pctl_ok", carried(event_in, event_out, "code", order)).drop("cuts", "pool")


def seasoned(df: DataFrame, catalogue: DataFrame, weeks: int = 26, at: str = "bar") -> DataFrame:
    """Rows of df(code, at) whose name is old enough and not delisted: an interval join on the code. catalogue(code, list_date, delist_date)."""
    c = catalogue.select("code", F.date_add("list_date", 7 * weeks).alias("_lo"), F.col("delist_date").alias("_hi"))
    return df.join(c, "code").filter((F.col(at) >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col(at) < F.col("_hi")))).drop("_lo", "_hi")


def representatives(df: DataFrame, beat: float = 1.25, order: str = "bar", step: int = 7) -> DataFrame:
    """(bar, idx, code): one name for each index and bar. df(bar, idx, code, adv) of eligible names.

    The incumbent stays until a challenger has `beat` times its volume or it is no longer eligible; then the largest
    takes over, ties to the lower code; a bar without eligible names, seen by a gap of more than `step` (days between dates,
    or a difference of numbers), resets. Only names that are the largest at some bar can ever be chosen, and every bar's largest is among them, so all others stay out. An index is one
    ordered stream of those; what is in memory is one bar of one index.
    """
    import pandas as pd

    some = store.cut(df.select(order, "idx", "code", F.coalesce(F.col("adv").cast("double"), F.lit(0.0)).alias("adv")), "eligible")
    largest = some.groupBy("idx", order).agg(F.max_by("code", F.struct("adv", -F.col("code"))).alias("code"))
    rows = some.join(largest.select("idx", "code").distinct(), ["idx", "code"], "left_semi")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "idx").sortWithinPartitions("idx", order, "code")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = last = at = None
        volume: dict = {}

        def closed() -> tuple:
            """The bar that has been read, and the name held from it on."""
            nonlocal held, last
            idx, bar = at
            if last is not None and (last[0] != idx or getattr(bar - last[1], "days", bar - last[1]) > step):
                held = None
            last = at
            best = max(volume, key=lambda c: (volume[c], -c))
            if held not in volume or volume[best] >= beat * volume[held]:
                held = best
            return bar, idx, held

        for pdf in batches:
            out = []
            for bar, idx, code, adv in zip(pdf[order].tolist(), pdf["idx"].tolist(), pdf["code"].tolist(), pdf["adv"].tolist(), strict=True):
                if (idx, bar) != at:
                    if at is not None:
                        out.append(closed())
                    at, volume = (idx, bar), {}
                volume[code] = adv
            yield pd.DataFrame(out, columns=[order, "idx", "code"])
        if at is not None:
            yield pd.DataFrame([closed()], columns=[order, "idx", "code"])

    kinds = dict(df.dtypes)
    return ordered.select(order, "idx", "code", "adv").mapInPandas(run, f"{order} {kinds[order]}, idx {kinds['idx']}, code {kinds['code']}")


def next_bar(df: DataFrame, flag: str, by: str = "code", order: str = "bar") -> Column:
    """The flag as it was a bar earlier; false at first."""
    return F.coalesce(F.lag(flag).over(Window.partitionBy(by).orderBy(order)), F.lit(False))


def events(df: DataFrame) -> DataFrame:
    """(bar, code, event): enter, and exit with its reason, the first that holds of delisting, floor, percentile, another representative.

    df(bar, code, member, season, floor_ok, pctl_ok).
    """
    w = Window.partitionBy("code").orderBy("bar")
    was = F.coalesce(F.lag("member").over(w), F.lit(False))
    reason = F.when(~F.col("season"), "exit_delist").when(~F.col("floor_ok"), "exit_floor").when(~F.col("pctl_ok"), "exit_pctl").otherwise("repr_switch")
    event = F.when(F.col("member") & ~was, "enter").when(~F.col("member") & was, reason)
    return df.select("bar", "code", event.alias("event")).filter("event is not null")


def tagged(df: DataFrame, name: str, kind: str, rules: list[tuple[str, str | None, str]], default: str = "UNTAGGED") -> DataFrame:
    """df with `tag` and `rule`: the first of (pattern, kind or None, tag) whose pattern is found and kind agrees."""
    hit = [F.col(name).rlike(p) & (F.lit(True) if k is None else F.col(kind) == k) for p, k, _ in rules]
    first = reduce(lambda done, i: done.when(hit[i], F.lit(i)), range(1, len(rules)), F.when(hit[0], F.lit(0)))
    names = F.array(*[F.lit(t) for _, _, t in rules])
    return df.withColumn("rule", first.otherwise(F.lit(-1))).withColumn("tag", F.when(F.col("rule") < 0, default).otherwise(F.get(names, F.col("rule"))))


class Universe(NamedTuple):
    """names(code, block), and membership(bar, code) of those that are in at a bar; None where the names are fixed and always in."""

    names: DataFrame
    membership: DataFrame | None


def persist(names: DataFrame, membership: DataFrame, path: str) -> None:
    """What `load` reads: names(code, block) and the member rows (bar, code)."""
    names.select("code", "block").write.parquet(f"{path}/names")
    membership.select("bar", "code").write.parquet(f"{path}/membership")


def load(spark: SparkSession, version: str, path: str) -> Universe:
    """The universe that was persisted, in one of its versions: `static`, the list of names, or `dynamic`, the names that were ever admitted with the bars at which they are in.

    An error where nothing is persisted, the version is unknown, or a member has no block or more than one.
    """
    if version not in ("static", "dynamic"):
        raise ValueError(f"no version {version!r} of the universe: static or dynamic")
    try:
        names = spark.read.parquet(f"{path}/names").select("code", "block")
        if version == "static":
            return Universe(names, None)
        membership = spark.read.parquet(f"{path}/membership").select("bar", "code")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no {version} universe at {path}") from missing
    admitted = membership.select("code").distinct()
    tagged = admitted.join(names, "code", "left")
    wrong = tagged.groupBy("code").agg(F.count("block").alias("n")).filter("n <> 1").limit(1).collect()
    if wrong:
        raise ValueError(f"{path}: {wrong[0]['code']} has {wrong[0]['n']} blocks")
    return Universe(tagged, membership)
