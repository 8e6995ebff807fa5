"""Risk budgets: groups of instruments, their covariance over the past year, weights that share risk as a policy says."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..functions.stats import full, rows


def composites(df: DataFrame, sizing: str = "inv_vol", group: str = "block") -> DataFrame:
    """(bar, group, ret, n): return to the next bar of a group's names, equal weights or by inverse volatility; null where it has none."""
    raw = F.lit(1.0) if sizing == "eqw" else div(F.lit(1.0), F.col("sigma"))
    g = df.withColumn("_w", raw).groupBy("bar", group)
    return g.agg(div(F.sum(F.col("_w") * F.coalesce("fwd", F.lit(0.0))), F.sum("_w")).alias("ret"), F.count("*").alias("n"))


def trend_gate(df: DataFrame, weeks: int = 43, group: str = "block") -> DataFrame:
    """df(bar, group, ret) with `on`: last bar's compounded value above its mean over `weeks` bars before; null in the warm-up."""
    w = Window.partitionBy(group).orderBy("bar")
    nav = df.withColumn("_nav", F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(rows(group, "bar", None, 0))))
    # a return that starts at a bar is known at the next one
    nav = nav.withColumn("_lag", F.lag("_nav", 1).over(w))
    return nav.withColumn("on", F.col("_lag") > full(F.avg("_lag"), "_lag", rows(group, "bar", -(weeks - 1)), weeks)).drop("_nav", "_lag")


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance shrunk towards its diagonal by the share of noise in the covariances; fewer than two rows: identity."""
    t = len(x)
    if t < 2:
        return np.eye(x.shape[1])
    d = x - x.mean(axis=0)
    s = d.T @ d / (t - 1)
    off = ~np.eye(len(s), dtype=bool)
    noise = (((d[:, :, None] * d[:, None, :] - s) ** 2).mean(axis=0) / t)[off].sum()
    size = (s[off] ** 2).sum()
    a = min(1.0, max(0.0, noise / size)) if size > 0 else 1.0
    return np.where(off, (1 - a) * s, s)


def naive_budget(cov: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights in proportion to the root of the share over volatility: exact where nothing correlates."""
    w = np.sqrt(share) / np.sqrt(np.diag(cov))
    return w / w.sum()


def risk_budget(cov: np.ndarray, share: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Weights whose parts of the variance are the shares: the minimum of w'Cw/2 - share'ln w, by damped Newton steps, scaled to one."""
    scale = np.sqrt(np.diag(cov))
    c = cov / np.outer(scale, scale)
    some = share > 0
    w = np.sqrt(np.where(some, share, 0))
    p, c = share[some], c[np.ix_(some, some)]
    y = w[some]
    for _ in range(200):
        gradient = c @ y - p / y
        step = np.linalg.solve(c + np.diag(p / y**2), gradient)
        size = 1.0
        while (y - size * step <= 0).any():
            size /= 2
        y = y - size * step
        if np.abs(step).max() < tolerance:
            break
    w[some] = y
    w /= scale
    return w / w.sum()


def risk_shares(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Each weight's part of the variance."""
    part = w * (cov @ w)
    return part / part.sum() if part.sum() else np.zeros_like(w)


def risk_budgets(cov: np.ndarray, shares: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """`risk_budget` for many share vectors, the rows of shares, on one covariance: all go through the Newton steps together."""
    scale = np.sqrt(np.diag(cov))
    out = np.zeros_like(shares, dtype=float)
    some = shares > 0
    for active in np.unique(some, axis=0):
        rows = np.flatnonzero((some == active).all(axis=1))
        p, c = shares[np.ix_(rows, active)], (cov / np.outer(scale, scale))[np.ix_(active, active)]
        y, every = np.sqrt(p), np.arange(p.shape[1])
        for _ in range(200):
            hessian = np.repeat(c[None], len(y), axis=0)
            hessian[:, every, every] += p / y**2
            step = np.linalg.solve(hessian, (y @ c - p / y)[..., None])[..., 0]
            size = np.ones((len(y), 1))
            while (low := (y - size * step <= 0).any(axis=1)).any():
                size[low] /= 2
            y = y - size * step
            if np.abs(step).max() < tolerance:
                break
        w = y / scale[active]
        out[np.ix_(rows, active)] = w / w.sum(axis=1, keepdims=True)
    return out


def naive_budgets(cov: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """`naive_budget` for the rows of shares."""
    w = np.sqrt(shares) / np.sqrt(np.diag(cov))
    return w / w.sum(axis=1, keepdims=True)


METHODS = {"erc": risk_budgets, "naive": naive_budgets}


def budget_grid(returns: DataFrame, policies: dict[str, dict], methods: tuple[str, ...] = ("erc",), weeks: int = 52, least: int = 26, group: str = "block", by: list[str] | None = None) -> DataFrame:
    """(by, bar, policy, method, group, w, rc, on): weights of the groups under every policy and method at each bar, from the returns of the `weeks` bars strictly before.

    returns(by, bar, group, ret, on), by: the cells whose groups these are; policies: name -> group -> share. A bar of a cell has one covariance, on which all policies are
    solved in one call. A group needs `least` returns; with fewer complete rows the covariance is the diagonal of the groups' own variances. A policy without
    a share in the groups that are there holds nothing. `on` (true where returns has none) is passed through: a group that is off is to be held as cash,
    so both variants come from one solution. Bars are solved in parallel, from a bounded list of rows each.
    """
    by = by or []
    names = sorted(next(iter(policies.values())))
    target = np.array([[p[g] for g in names] for p in policies.values()], dtype=float)
    tags = [(p, m) for m in methods for p in policies]
    on = F.coalesce(F.col("on"), F.lit(True)) if "on" in returns.columns else F.lit(True)
    packed = returns.withColumn("on", on).groupBy(*by, "bar").agg(F.map_from_entries(F.collect_list(F.struct(F.col(group), F.struct("ret", "on").alias("v")))).alias("m"))
    row = packed.select(*by, "bar", F.array(*[F.col("m")[F.lit(g)]["ret"] for g in names]).alias("r"), F.array(*[F.coalesce(F.col("m")[F.lit(g)]["on"], F.lit(True)) for g in names]).alias("on"))
    # one short list of groups for each bar; a year of them for each solution
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bar").rowsBetween(-weeks, -1)
    past = row.withColumn("past", F.collect_list("r").over(w)).repartition(*by, "bar").select(*by, "bar", "on", "past")
    kinds = dict(returns.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for *key, on, past in zip(*[pdf[c] for c in (*by, "bar", "on", "past")], strict=True):
                x = np.array([list(p) for p in past], dtype=float).reshape(-1, len(names))
                able = np.isfinite(x).sum(axis=0) >= least
                w, rc = np.zeros((len(methods), *target.shape)), np.zeros((len(methods), *target.shape))
                held = np.flatnonzero(target[:, able].sum(axis=1) > 0)
                if able.any() and len(held):
                    y = x[:, able]
                    whole = y[np.isfinite(y).all(axis=1)]
                    cov = shrunk_covariance(whole) if len(whole) >= least else np.diag(np.nanstd(y, axis=0, ddof=1) ** 2)
                    if (np.diag(cov) > 0).all():
                        p = target[np.ix_(held, able)]
                        p = p / p.sum(axis=1, keepdims=True)
                        for i, m in enumerate(methods):
                            v = METHODS[m](cov, p)
                            part = v * (v @ cov)
                            w[np.ix_([i], held, able)] = v
                            rc[np.ix_([i], held, able)] = part / part.sum(axis=1, keepdims=True)
                w, rc = w.reshape(-1, len(names)), rc.reshape(-1, len(names))
                out += [(*key, *tag, g, float(w[i, j]), float(rc[i, j]), bool(on[j])) for i, tag in enumerate(tags) for j, g in enumerate(names)]
            yield pd.DataFrame(out, columns=[*by, "bar", "policy", "method", group, "w", "rc", "on"])

    keys = "".join(f"{c} {kinds[c]}, " for c in [*by, "bar"])
    return past.mapInPandas(run, f"{keys}policy string, method string, {group} {kinds[group]}, w double, rc double, on boolean")


def budget_weights(returns: DataFrame, shares: dict[int, float], method: str = "erc", weeks: int = 52, least: int = 26, group: str = "block") -> DataFrame:
    """(bar, group, w, rc) of one policy, see `budget_grid`; groups that are switched off (on = false) get zero and their part stays in cash."""
    g = budget_grid(returns, {"": shares}, (method,), weeks, least, group)
    return g.select("bar", group, F.when(F.col("on"), F.col("w")).otherwise(0.0).alias("w"), "rc")


def share_grid(base: dict, step: float = 0.1) -> dict[str, dict]:
    """Every combination of base moved by -step, 0 or step in each group, cut at zero and scaled to one; by a tag of the moves. The base itself isn't among them."""
    out = {}
    for moves in product((-1, 0, 1), repeat=len(base)):
        raw = {g: max(0.0, v + m * step) for (g, v), m in zip(base.items(), moves, strict=True)}
        if any(moves) and sum(raw.values()) > 0:
            out["grid" + "".join(f"_{g}{m * step * 100:+.0f}" for g, m in zip(base, moves, strict=True))] = {g: v / sum(raw.values()) for g, v in raw.items()}
    return out


def to_names(group_w: DataFrame, within: DataFrame, group: str = "block") -> DataFrame:
    """(bar, code, w): group weight times weight within; an empty group is cash."""
    return group_w.select("bar", group, F.col("w").alias("_g")).join(within, ["bar", group]).select("bar", "code", (F.col("_g") * F.col("w")).alias("w")).filter("w <> 0")


def axis_shares(base: dict, group, delta: float) -> dict:
    """base with one group moved by delta and the others in proportion, all between 0 and 1, adding up to 1."""
    moved = min(1.0, max(0.0, base[group] + delta))
    rest = sum(v for k, v in base.items() if k != group)
    out = {k: moved if k == group else (v * (1 - moved) / rest if rest else 0.0) for k, v in base.items()}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def plateau(df: DataFrame, score: str, band: float, order: list[str]) -> DataFrame:
    """The row to pick: among those within `band` of the best score the first in `order`."""
    best = df.agg(F.max(score).alias("_best"))
    return df.crossJoin(F.broadcast(best)).filter(F.col(score) >= F.col("_best") - band).drop("_best").orderBy(*order).limit(1)
