"""Walk-forward ridge regressions over a grid of penalties: products of features summed up once, all penalties of a fold from one decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0)


def folds(bars: DataFrame, first: int = 78, every: int = 13, purge: int = 1) -> DataFrame:
    """(bar, fold, trains): the fold whose test window a bar is in (none before bar number first + purge), and the first fold that trains on it.

    Fold f tests on `every` bars from number first + purge + f * every on and trains on all bars before them but the last `purge`. One row a bar.
    """
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bar")) - 1
    n = bars.select("bar").distinct().withColumn("i", i)
    start = first + purge
    fold = F.when(F.col("i") >= start, F.expr(f"(i - {start}) div {every}"))
    # bar i is in the training of fold f when i < first + f * every
    trains = F.greatest(F.lit(0).cast("long"), F.expr(f"(i - {first} + {every}) div {every}"))
    return n.select("bar", fold.cast("int").alias("fold"), trains.cast("int").alias("trains"))


def products(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(trains, i, n, v): by fold that rows enter, row i of the matrix of products of (xs, y), and the number of rows. rows(trains, xs, y) complete.

    Tasks sum their rows up, so that what is shuffled doesn't grow with them: some rows for each task and fold.
    """
    names, size = [*xs, y], len(xs) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            fold = b.column(0).to_numpy()
            x = np.column_stack([b.column(j + 1).to_numpy() for j in range(size)]) if b.num_rows else np.zeros((0, size))
            for f in np.unique(fold).tolist():
                z = x[fold == f]
                s = sums.setdefault(f, [0, np.zeros((size, size))])
                s[0] += len(z)
                s[1] += z.T @ z
        for f, (n, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["trains", "i", "n", "v"])

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, int(pdf["n"].sum()), np.sum(np.stack(pdf["v"].to_list()), axis=0))], columns=["trains", "i", "n", "v"])

    kind = "trains int, i int, n long, v array<double>"
    return rows.select("trains", *[F.col(c).cast("double") for c in names]).mapInArrow(run, kind).groupBy("trains", "i").applyInPandas(added, kind)


def fits(summed: DataFrame, tests: DataFrame, alphas: tuple[float, ...] = ALPHAS, least: int = 100) -> DataFrame:
    """(fold, alpha, n, beta): coefficients of every fold and penalty. summed: see `products`; tests(fold): the folds.

    A fold gathers the summed rows of all folds it trains on, a fixed number of matrices, and solves all penalties from one decomposition of their sum. A fold
    with fewer than `least` rows has no fit.
    """
    every = tests.select("fold").distinct()
    # a short list of folds
    met = summed.join(F.broadcast(every), F.col("trains") <= F.col("fold"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.loc[pdf["i"] == 0, "n"].sum())
        if n < least:
            return pd.DataFrame(columns=["fold", "alpha", "n", "beta"])
        size = int(pdf["i"].max()) + 1
        m = np.zeros((size, size))
        for i, v in zip(pdf["i"], pdf["v"], strict=True):
            m[i] += v
        value, vector = np.linalg.eigh(m[:-1, :-1])
        turned = vector.T @ m[:-1, -1]
        # without a penalty directions that the rows don't have get nothing
        least_value = 1e-12 * max(value.max(), 0.0)
        return pd.DataFrame([(*key, a, n, (vector @ np.where(value + a > least_value, turned / np.maximum(value + a, least_value or 1.0), 0.0)).tolist()) for a in alphas], columns=["fold", "alpha", "n", "beta"])

    return met.groupBy("fold").applyInPandas(solve, "fold int, alpha double, n long, beta array<double>")


def forecasts(panel: DataFrame, placed: DataFrame, fitted: DataFrame, xs: list[str]) -> DataFrame:
    """panel's complete rows of tested bars with fold, alpha and pred, a row for each penalty. fitted: a row for each fold and penalty, broadcast."""
    some = panel.dropna(subset=xs).join(F.broadcast(placed.filter("fold is not null").select("bar", "fold")), "bar")
    both = some.join(F.broadcast(fitted.select("fold", "alpha", "beta")), "fold")
    return both.withColumn("pred", sum((F.get("beta", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))).drop("beta")


def stability(fitted: DataFrame, xs: list[str], last: int = 5) -> DataFrame:
    """(alpha, factor, median, sign, matches, of): of the last folds' coefficients the median, and how many have its sign."""
    recent = fitted.withColumn("_r", F.row_number().over(Window.partitionBy("alpha").orderBy(F.desc("fold")))).filter(F.col("_r") <= last)
    long = recent.select("alpha", F.posexplode("beta").alias("i", "b")).withColumn("factor", F.element_at(F.array(*map(F.lit, xs)), F.col("i") + 1))
    m = long.withColumn("median", F.percentile("b", F.lit(0.5)).over(Window.partitionBy("alpha", "factor")))
    same = (F.signum("median") != 0) & (F.signum("b") == F.signum("median"))
    return m.groupBy("alpha", "factor").agg(F.max("median").alias("median"), F.max(F.signum("median")).cast("int").alias("sign"), F.count_if(same).alias("matches"), F.count("*").alias("of"))
