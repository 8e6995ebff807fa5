"""Signals against outcomes: information coefficients, their summaries, screening, dedup, ensembles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, k_of, with_probit
from ..functions.stats import average_rank, first_rank, full, pearson, rows
from ..plans import store


def expanding_z(df: DataFrame, value: str = "value", by: list[str] | None = None, least: int = 26, name: str = "z") -> DataFrame:
    """Standard score against all of the name's own past, from `least` values on."""
    w = rows(by or ["factor", "code"], "bar", None, 0)
    score = div(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, score))


def gaussian_rank(df: DataFrame, value: str, by: list[str], least: int = 3, name: str = "g") -> DataFrame:
    """Normal score of the mean rank within `by`; null with fewer than `least` values."""
    ranked = average_rank(df, value, by, "_r")
    n = F.count(value).over(Window.partitionBy(*by))
    u = F.when(n >= least, (F.col("_r") - 0.5) / n)
    return with_probit(ranked.withColumn(f"{name}_u", u), f"{name}_u", name).drop("_r")


def rank_ic(df: DataFrame, signal: str = "value", target: str = "fwd", by: list[str] | None = None, least: int = 5) -> DataFrame:
    """(by, ic, n): Spearman's correlation in each group, from pairs that are both there."""
    by = by or ["factor", "bar"]
    both = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranked = average_rank(average_rank(both, signal, by, "_a"), target, by, "_b")
    return ranked.groupBy(*by).agg(pearson("_a", "_b", least).alias("ic"), F.count("*").alias("n"))


def ic_summary(ics: DataFrame, by: list[str], roll: int = 52) -> DataFrame:
    """mean, std, t, share positive, z over ragged bars, mean weighted by n - 1, and the range of the rolling mean. ics(by, bar, ic, n)."""
    w = rows(by, "bar", -(roll - 1))
    rolled = ics.withColumn("_roll", full(F.avg("ic"), "ic", w, (3 * roll + 3) // 4))
    ragged = F.when(F.col("n") > 1, F.col("ic") * F.sqrt(F.col("n") - 1.0))
    weight = F.when(F.col("ic").isNotNull(), F.col("n") - 1.0)
    return rolled.groupBy(*by).agg(
        F.count("ic").alias("n_bars"),
        F.avg("ic").alias("mean"),
        F.stddev_samp("ic").alias("std"),
        (div(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic").cast("double"))).alias("t"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("pct_pos"),
        (F.avg(ragged) * F.sqrt(F.count(ragged).cast("double"))).alias("z"),
        div(F.sum(F.col("ic") * weight), F.sum(weight)).alias("ic_w"),
        F.min("_roll").alias("roll_min"),
        F.max("_roll").alias("roll_max"),
    )


def precision_at(df: DataFrame, q: float | None = None, k: int | None = None, signal: str = "value", target: str = "fwd", by: list[str] | None = None, top: bool = True, least: int = 10) -> DataFrame:
    """(by, n, k, precision): how much of the best share q (or k names) of the signal is among the best of the target."""
    by = by or ["factor", "bar"]
    both = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    both = both.filter(F.col("_n") >= (least if k is not None else max(2, -(-0.5 // q))))
    size = F.lit(k) if k is not None else F.ceil(F.lit(q) * F.col("_n").cast("double"))
    hit = (first_rank(signal, by, descending=top) <= size) & (first_rank(target, by, descending=top) <= size)
    return both.select(*by, "_n", size.cast("long").alias("k"), hit.cast("int").alias("_h")).groupBy(*by).agg(F.max("_n").alias("n"), F.max("k").alias("k"), (F.sum("_h") / F.max("k")).alias("precision"))


def ic_triple(df: DataFrame, signal: str = "value", target: str = "fwd", group: str = "block", by: list[str] | None = None) -> DataFrame:
    """(by, raw, within, between, n): correlation of ranks; of ranks less their block means (blocks of two or more); of the block means, weighted by size."""
    by = by or ["factor", "bar"]
    both = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranked = average_rank(average_rank(both, signal, by, "a"), target, by, "b")
    w = Window.partitionBy(*by, group)
    ranked = ranked.withColumn("am", F.avg("a").over(w)).withColumn("bm", F.avg("b").over(w)).withColumn("size", F.count("*").over(w))
    big = F.col("size") >= 2
    inner_a, inner_b = F.when(big, F.col("a") - F.col("am")), F.when(big, F.col("b") - F.col("bm"))
    # block means once for each member: weights by size
    return ranked.groupBy(*by).agg(
        pearson("a", "b", 5).alias("raw"), pearson(inner_a, inner_b, 5).alias("within"), F.when(F.count_distinct(group) >= 2, pearson("am", "bm")).alias("between"), F.count("*").alias("n")
    )


def half_split(ics: DataFrame, by: list[str], least_z: float = 1.5) -> DataFrame:
    """(by, z1, z2, passes): z of both halves of the bars, and whether they agree in sign with all and are strong."""
    some = ics.filter("ic is not null")
    order = Window.partitionBy(*by).orderBy("bar")
    half = F.when(F.row_number().over(order) <= F.floor(F.count("*").over(Window.partitionBy(*by)) / 2), 1).otherwise(2)
    x = F.col("ic") * F.sqrt(F.col("n") - 1.0)

    def z(only: Column) -> Column:
        v = F.when(only, x)
        return F.avg(v) * F.sqrt(F.count(v).cast("double"))

    g = some.withColumn("half", half).groupBy(*by).agg(z(F.lit(True)).alias("z"), z(F.col("half") == 1).alias("z1"), z(F.col("half") == 2).alias("z2"))
    agree = (F.signum("z1") == F.signum("z")) & (F.signum("z2") == F.signum("z")) & (F.abs("z1") >= least_z) & (F.abs("z2") >= least_z)
    return g.withColumn("passes", agree)


def correlations(df: DataFrame, least: int = 100, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """(by, f1, f2, rho, n) for f1 < f2: correlation over the cells that both have, finite values only; a factor has at most one value in a cell.

    Cells meet once: the values of a cell go into one row. Tasks add up products of whole batches of cells, so a task gives a row for each pair of factors, not one for each pair and
    cell. What is in a task's memory is the square of the number of factors (hundreds) for each group of `by`, and one batch.
    """
    by = by or []
    wide = df.filter(F.col(value).isNotNull()).groupBy(*by, "bar", "code").agg(F.collect_list("factor").alias("f"), F.collect_list(value).alias("v"))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    summed = wide.select(group.alias("g"), "f", F.col("v").cast("array<double>").alias("v")).mapInArrow(_products, "g string, f1 string, f2 string, " + ", ".join(f"{c} double" for c in _SUMS))
    total = summed.groupBy("g", "f1", "f2").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("n > 0")
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    ok = (n >= least) & (vx > 1e-12 * n * F.col("sxx")) & (vy > 1e-12 * n * F.col("syy"))
    rho = F.when(ok, div(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))
    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    out = total.withColumn("_k", F.from_json("g", keys)) if by else total
    return out.select(*[F.col("_k")[c].alias(c) for c in by], "f1", "f2", F.coalesce(rho, F.lit(0.0)).alias("rho"), n.cast("long").alias("n"))


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (g, f, v), a cell each with its factors and their values, to sums of products over the cells that have both factors of a pair, for each g."""
    names: dict[str, int] = {}
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        cells, f, v = b.column(0).dictionary_encode(), b.column(1), b.column(2)
        coded = f.flatten().dictionary_encode()
        place = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
        size = len(names)
        row = np.repeat(np.arange(len(b)), np.diff(f.offsets.to_numpy()))
        x, m = np.zeros((len(b), size)), np.zeros((len(b), size))
        values = v.flatten().to_numpy()
        # products with zeros would spread what isn't finite
        fine = np.isfinite(values)
        at = row[fine], place[coded.indices.to_numpy()][fine]
        x[at], m[at] = values[fine], 1.0
        of = cells.indices.to_numpy()
        for i, g in enumerate(cells.dictionary.to_pylist()):
            xs, ms = (x, m) if len(cells.dictionary) == 1 else (x[of == i], m[of == i])
            # [i, j]: over the cells with both, the number, sum and sum of squares of i, and of products
            found = np.stack([ms.T @ ms, xs.T @ ms, (xs * xs).T @ ms, xs.T @ xs])
            old = sums.get(g)
            if old is not None:
                found[:, : old.shape[1], : old.shape[1]] += old
            sums[g] = found
    order = np.array(sorted(names, key=names.__getitem__), object)
    for g, (n, s, q, p) in sums.items():
        have = order[: len(n)]
        i, j = np.nonzero(n)
        keep = have[i] < have[j]
        i, j = i[keep], j[keep]
        parts = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(i), pa.string()), pa.array(have[i], pa.string()), pa.array(have[j], pa.string()), *[pa.array(c, pa.float64()) for c in parts]], ["g", "f1", "f2", *_SUMS])


def dedup(ranked: DataFrame, rho: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by, factor, stands_for, kept): by `pos`, a factor is kept unless it correlates over the threshold with a kept one, the first of which stands for it.

    ranked(by, factor, pos), rho(by, f1, f2, rho). Sequential by nature, so a group is a task; it holds factor names and their pairs, at most some
    hundreds squared, never rows of the panel.
    """
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", factor string, stands_for string, kept boolean"

    def walk(key, order: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        close = {(a, b) for a, b, r in zip(pairs["f1"], pairs["f2"], pairs["rho"]) if abs(r) > threshold}
        kept: list[str] = []
        out = []
        for f in order.sort_values("pos")["factor"]:
            clash = next((g for g in kept if (min(f, g), max(f, g)) in close), None)
            out.append((*key, f, clash or f, clash is None))
            if clash is None:
                kept.append(f)
        return pd.DataFrame(out, columns=[*by, "factor", "stands_for", "kept"])

    # both may come from one table: fresh columns keep the two sides apart
    ranked, rho = (df.select(*[F.col(c).alias(f"_{c}") for c in df.columns]).toDF(*df.columns) for df in (ranked, rho))
    return ranked.groupBy(*by).cogroup(rho.groupBy(*by)).applyInPandas(walk, schema)


def row_z(df: DataFrame, value: str = "value", by: list[str] | None = None) -> Column:
    """Standard score across names; null where all are alike."""
    w = Window.partitionBy(*(by or ["factor", "bar"]))
    return div(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def with_row_z(df: DataFrame, value: str = "value", by: list[str] | None = None, name: str = "z") -> DataFrame:
    """df with `name`, see `row_z`, without a shuffle of its rows: means and deviations are added up in tasks, a row for each group, and meet the rows there. df is read twice."""
    keys = by or ["factor", "bar"]
    s = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev"))
    return df.join(F.broadcast(s), keys).withColumn(name, div(F.col(value) - F.col("_mean"), F.col("_dev"))).drop("_mean", "_dev")


def ensemble(df: DataFrame, signs: DataFrame) -> DataFrame:
    """(bar, code, alpha): the mean of the signed row z of the factors in signs(factor, sign)."""
    scored = with_row_z(df.join(F.broadcast(signs), "factor")).withColumn("zs", F.col("z") * F.col("sign"))
    return scored.groupBy("bar", "code").agg(F.avg("zs").alias("alpha"))


def rank_blend(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """(bar, code, alpha): the mean of the weighted percentile ranks of two signals; one that is alone counts alone."""

    def ranked(x: DataFrame, w: float) -> DataFrame:
        y = average_rank(x.filter("alpha is not null"), "alpha", ["bar"], "_r")
        return y.select("bar", "code", (F.lit(w) * F.col("_r") / F.count("*").over(Window.partitionBy("bar"))).alias("v"))

    return ranked(a, weight).unionByName(ranked(b, 1 - weight)).groupBy("bar", "code").agg(F.avg("v").alias("alpha"))


def near_top(df: DataFrame, keys: list[str], least: Column, cells: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """df's rows that may be among the first `least` of their group by alpha, and n, the group's number of rows.

    A group's rows are counted in tasks by steps of an eighth of its deviation, and steps below the one that holds the last place wanted are left out: ranks of what is left are those of all, and only
    that is shuffled. Nothing is left out where values tell no steps apart. least: of n, `also` (columns of df alike in a group) and columns of the short table `cells`, the most of which holds. df is read three times.
    """
    size = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("alpha").alias("_m"), F.stddev_samp("alpha").alias("_s"), *[F.max(c).alias(f"_a_{c}") for c in also])
    each = size.crossJoin(F.broadcast(cells)) if cells is not None else size.withColumnsRenamed({f"_a_{c}": c for c in also})
    # a row for each group
    size = store.cut(each.withColumn("_k", least).groupBy(*keys, "n", "_m", "_s").agg(F.max("_k").alias("_k")), "sizes")
    step = F.floor(div(8 * (F.col("alpha") - F.col("_m")), F.col("_s")))
    # NULL comes last in ranks, and least and greatest pass it over
    step = F.when(step.isNull(), F.lit(-4).cast("long")).otherwise(F.greatest(F.lit(-4).cast("long"), F.least(F.lit(16).cast("long"), step)))
    counts = df.join(F.broadcast(size), keys).groupBy(*keys, "_k", step.alias("_step")).agg(F.count("*").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0))
    last = counts.withColumn("_until", until).groupBy(*keys).agg(F.max(F.when(F.col("_until") >= F.col("_k"), F.col("_step"))).alias("_last"))
    marks = store.cut(size.join(last, keys).drop("_k"), "marks")
    near = df.join(F.broadcast(marks), keys).filter(F.col("_last").isNull() | (step >= F.col("_last")))
    return near.drop("_m", "_s", "_last")


def eligible_k(df: DataFrame, q: float | Column, long_short: Column | bool = False, by: list[str] | None = None) -> DataFrame:
    """df with n, k and rank (first in code on ties) of each bar's names by alpha, within `by`."""
    keys = [*(by or []), "bar"]
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("n", n).withColumn("k", k_of("n", q, long_short)).withColumn("rk", first_rank("alpha", keys))
