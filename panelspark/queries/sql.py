"""SQL of the panel, for the queries' SQL to build on."""

from __future__ import annotations

from ..plans.panel import FACTORS, WINDOWS

FRIDAY = "({d} + ((12 - isodow({d})) % 7)::INTEGER)"

VIEWS = {
    "li": "SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, round(l_extendedprice * 100)::BIGINT AS ep, l_quantity AS q, round(l_discount * 100)::BIGINT AS di FROM lineitem",
    "daily": "SELECT d AS date, code, sum(ep)::DOUBLE / sum(q) / 100.0::DOUBLE AS close, sum(ep)::BIGINT AS amount, sum(q) AS qty FROM li GROUP BY ALL",
    "cells": f"SELECT CAST({FRIDAY.format(d='d')} AS DATE) AS bar, code, sum(ep)::DOUBLE / sum(q) / 100.0::DOUBLE AS close, sum(ep)::BIGINT AS amount, sum(q) AS qty, count(*) AS n_rows, avg(di) / 100.0::DOUBLE AS discount FROM li GROUP BY ALL",
    "instruments": "SELECT s_suppkey AS code, n_regionkey AS block, s_nationkey AS idx FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "grid": "SELECT code, CAST(unnest(generate_series(first::TIMESTAMP, (SELECT max(bar) FROM cells)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS bar FROM (SELECT code, min(bar) AS first FROM cells GROUP BY code)",
    "p1": """SELECT g.bar, g.code, last_value(close IGNORE NULLS) OVER s AS px, n_rows IS NOT NULL AS obs, coalesce(amount, 0) AS amount, last_value(discount IGNORE NULLS) OVER s AS disc
        FROM grid g LEFT JOIN cells c ON g.bar = c.bar AND g.code = c.code WINDOW s AS (PARTITION BY g.code ORDER BY g.bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "p2": """SELECT *, px / lag(px) OVER w - 1 AS ret, ln(px / lag(px) OVER w) AS lr, lead(px) OVER w / px - 1 AS fwd, -(px / lag(px, 4) OVER w - 1) + 0.0 AS rev4, px / lag(px, 13) OVER w - 1 AS mom13,
        avg(amount) OVER (PARTITION BY code ORDER BY bar ROWS 7 PRECEDING) AS amt, sum(obs::INT) OVER (PARTITION BY code ORDER BY bar ROWS 12 PRECEDING) AS traded FROM p1 WINDOW w AS (PARTITION BY code ORDER BY bar)""",
    "p3": "SELECT *, -ret + 0.0 AS rev1, CASE WHEN count(lr) OVER w >= 26 AND round(stddev_samp(lr) OVER w, 12) > 1e-12 THEN round(stddev_samp(lr) OVER w, 12) END AS sigma FROM p2 WINDOW w AS (PARTITION BY code ORDER BY bar ROWS 25 PRECEDING)",
    "panel": "SELECT p3.*, -sigma AS lowvol, traded >= 4 AND sigma IS NOT NULL AS member, block, idx FROM p3 JOIN instruments USING (code)",
    "members": "SELECT * FROM panel WHERE member AND rev4 IS NOT NULL",
    "factors": " UNION ALL ".join(f"SELECT bar, code, block, fwd, sigma, '{f}' AS factor, {f} AS value FROM panel WHERE member" for f in FACTORS),
    "windows": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS) + ") t(win, lo, hi)",
}
ORDER = list(VIEWS)

# From kbook(cell, bar, code, w): every name held at a bar or the one before, and each cell's series.
KMOVED = ("kmoved", "SELECT x.cell, c.bar, x.code, sum(x.w) AS w, sum(x.prev) AS prev, any_value(c.seq) AS seq FROM (SELECT cell, bar, code, w, 0.0 AS prev FROM kbook UNION ALL SELECT b.cell, c.bar, code, 0.0, w FROM kbook b JOIN calx c ON b.bar = c.prior) x JOIN calx c ON x.bar = c.bar GROUP BY x.cell, c.bar, x.code")
KNET = ("knet", "SELECT cc.cell, c.bar, coalesce(gross, 0.0) AS gross, coalesce(turnover, 0.0) AS turnover, coalesce(gross, 0.0) - 0.001::DOUBLE * coalesce(turnover, 0.0) AS net, coalesce(n_held, 0)::BIGINT AS n_held FROM (SELECT DISTINCT cell FROM kbook) cc CROSS JOIN calx c LEFT JOIN (SELECT m.cell, m.bar, sum(w * coalesce(fwd, 0.0)) AS gross, sum(CASE WHEN seq = 1 THEN 0.0 ELSE abs(w - prev) END) AS turnover, sum((w <> 0)::INT) AS n_held FROM kmoved m LEFT JOIN panel p ON m.bar = p.bar AND m.code = p.code GROUP BY m.cell, m.bar) g ON g.cell = cc.cell AND g.bar = c.bar")


def sql(final: str, *steps: tuple[str, str], base: str = "members") -> str:
    """WITH the views up to `base`, the windows, and the steps: the final select."""
    views = [(v, VIEWS[v]) for v in ORDER[: ORDER.index(base) + 1]]
    if base != "windows":
        views.append(("windows", VIEWS["windows"]))
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in [*views, *steps]) + "\n" + final


def ranks(value: str, by: str) -> str:
    """Average rank of non-null values."""
    return f"CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {value} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 END"


def pearson(x: str, y: str, least: int = 2, over: str = "") -> str:
    """Correlation from sums, null with few pairs or a constant side."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    n, sx, sy, sxx, syy, sxy = (f"{f}({e}){over}" for f, e in (("count", x), ("sum", x), ("sum", y), ("sum", f"({x})*({x})"), ("sum", f"({y})*({y})"), ("sum", f"({x})*({y})")))
    vx, vy = f"({n}*{sxx} - {sx}*{sx})", f"({n}*{syy} - {sy}*{sy})"
    return f"CASE WHEN {n} >= {least} AND {vx} > 1e-12*{n}*{sxx} AND {vy} > 1e-12*{n}*{syy} THEN ({n}*{sxy} - {sx}*{sy}) / (sqrt(abs({vx})) * sqrt(abs({vy}))) END"
