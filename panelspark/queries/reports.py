"""Tables of a report: frozen sets, earlier books and their replay, strips, transitions, what trades most, cells of leverage, rivals of an ensemble."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..operators import book, cluster, files, ic, leverage, metrics, vol
from ..plans import panel as P
from ..plans import store
from .books import FWDVOL, RIVALS, keyed, keyed_net, predictor_alignment
from .core import BOOK, ENSEMBLE, IC, Q, SQL, TRIPLE, _stats_sql, eligible, ensemble_alpha, factors, long_book, net, query  # noqa: F401
from .models import CURVE, FUND, LAMBDA, EXPCT, SCORE, _LEV_STATS, cluster_rows, ewma_sql, levered, risk_score
from .sql import pearson, ranks, sql

# --- what was fixed earlier ------------------------------------------------------------------------------------------


@query("frozen_representatives")
def frozen_representatives(spark, sf_dir):
    """Books of representatives that were fixed in a CSV folder, which is checked before it is used: nothing is clustered again."""
    at = store.fresh(spark, "frozen")
    kinds = dict(cluster_rows(spark, sf_dir).dtypes)
    files.write_csv(cluster.refresh(cluster_rows(spark, sf_dir)), at)
    fixed = files.frozen(spark, at, f"code {kinds['code']}, year int, block {kinds['block']}, label int, rep {kinds['code']}", ["code", "year"], within=("rep", ["year", "block", "label"]))
    return cluster.reps_only(eligible(spark, sf_dir), fixed)


ANCHORED = "SELECT 't1' AS cell, 1.0::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, 0 AS alpha, sigma FROM members UNION ALL SELECT 't2', 1.0, 'inv_vol', bar, code, 0, sigma FROM members WHERE block = 0 UNION ALL SELECT 'solo', 0.2, 'inv_vol', bar, code, rev4, sigma FROM members"


def anchored(spark, sf_dir):
    """(cell, bar, net) of three books that later ones are held against."""
    m = eligible(spark, sf_dir)
    kinds = [("t1", m, F.lit(0.0), 1.0), ("t2", m.filter("block = 0"), F.lit(0.0), 1.0), ("solo", m, F.col("alpha"), 0.2)]
    parts = [df.select(F.lit(c).alias("cell"), "bar", "code", a.alias("alpha"), "sigma", F.lit(q).alias("q"), F.lit("inv_vol").alias("sizing")) for c, df, a, q in kinds]
    return keyed_net(spark, sf_dir, parts[0].union(parts[1]).union(parts[2])).select("cell", "bar", "net")


@query("anchor_stats", sql("SELECT anchor, * EXCLUDE (anchor) FROM st", *keyed(ANCHORED), ("st", _stats_sql("anchor", f"SELECT cell AS anchor, bar, net FROM knet WHERE bar <= DATE '{P.IS_END}'"))))
def anchor_stats(spark, sf_dir):
    """Earlier books from where they are stored, if they are, by their performance in sample; one that isn't stored is passed over."""
    at = store.fresh(spark, "anchors")
    series = store.cut(anchored(spark, sf_dir), "anchored")
    names = ("t1", "t2", "solo")
    for n in names:
        series.filter(F.col("cell") == n).select("bar", "net").write.parquet(f"{at}/{n}")
    found = files.anchors(spark, {n: f"{at}/{n}" for n in (*names, "never_run")})
    return metrics.window_stats(found.filter(F.col("bar") <= P.IS_END), ["anchor"]).filter("n_bars >= 2")


@query("replay_check", sql("SELECT cell, count(*) AS n, 0::BIGINT AS missing, 0.0::DOUBLE AS max_gap, TRUE AS same FROM knet GROUP BY cell", *keyed(ANCHORED)))
def replay_check(spark, sf_dir):
    """Stored series against the same books worked out anew: every bar there and equal."""
    at = store.fresh(spark, "replay")
    anchored(spark, sf_dir).write.parquet(at)
    return files.replayed(spark.read.parquet(at), anchored(spark, sf_dir), "cell").withColumn("max_gap", F.round("max_gap", 9))


# --- diagnostics -----------------------------------------------------------------------------------------------------

STRIPS = [("autumn_97", "1997-07-01", "1997-12-31"), ("autumn_98", "1998-08-01", "1998-10-31")]
_IN = {n: f"bar BETWEEN DATE '{a}' AND DATE '{b}'" for n, a, b in STRIPS}
_STRIPPED = " UNION ALL ".join(f"SELECT bar, net, '{n}' AS strip FROM net WHERE {c}" for n, c in {"none": "TRUE", **{n: f"NOT ({c})" for n, c in _IN.items()}, "all": " AND ".join(f"NOT ({c})" for c in _IN.values())}.items())


@query("crisis_strips", sql("SELECT * FROM st", *BOOK, ("st", _stats_sql("strip", _STRIPPED))))
def crisis_strips(spark, sf_dir):
    """Performance with crises taken out, each alone and all together."""
    return metrics.window_stats(metrics.without(net(spark, sf_dir).select("bar", "net"), STRIPS), ["strip"]).filter("n_bars >= 2")


@query("marginal_churn", sql("SELECT e.bar, e.code, event, (k - rk)::INTEGER AS distance, coalesce(abs(k - rk) <= 2, FALSE) AS marginal FROM (SELECT bar, code, CASE WHEN prev = 0 AND w <> 0 THEN 'entry' WHEN prev <> 0 AND w = 0 THEN 'exit' END AS event FROM moved) e LEFT JOIN rkd r ON r.bar = e.bar AND r.code = e.code WHERE event IS NOT NULL", *BOOK[:5]))
def marginal_churn(spark, sf_dir):
    """Entries and exits by how far the name is from the last place held."""
    ranked = ic.eligible_k(eligible(spark, sf_dir), 0.2)
    return book.marginal_churn(long_book(spark, sf_dir), ranked, book.calendar(P.panel(spark, sf_dir)))


@query("turnover_top_weeks", sql("SELECT n.bar, round(turnover, 6) AS turnover, round(turnover / (SELECT sum(turnover) FROM net), 6) AS share, round(turnover * 10, 6) AS drag_bp, r.bar IS NOT NULL AS refresh FROM net n LEFT JOIN (SELECT min(bar) AS bar FROM panel GROUP BY year(bar), quarter(bar)) r ON n.bar = r.bar ORDER BY round(turnover, 9) DESC, n.bar LIMIT 5", *BOOK))
def turnover_top_weeks(spark, sf_dir):
    """A report: the five bars that trade most."""
    dates = P.panel(spark, sf_dir).groupBy(F.year("bar"), F.quarter("bar")).agg(F.min("bar").alias("refresh"))
    return book.top_turnover(net(spark, sf_dir), dates)


@query("transition_costs", sql("SELECT step > 0 AS moved, count(*) AS n, round(avg(step), 6) AS mean_step, round(avg(turnover), 6) AS mean_turnover, round(avg(turnover) * 520, 6) AS cost_bp FROM (SELECT bar, coalesce(abs(share - lag(share) OVER (ORDER BY bar)), 0.0) AS step FROM lam) JOIN net USING (bar) GROUP BY 1", *BOOK, SCORE, EXPCT, LAMBDA))
def transition_costs(spark, sf_dir):
    """What a blend's moves cost: the flagship's turnover on the bars at which the share moves, and on the others."""
    share = risk_score(spark, sf_dir).select("bar", ramp("p").alias("share"))
    return book.transition_costs(share, net(spark, sf_dir))


@query("ic_triple_summary", sql(f"SELECT factor, win AS \"window\", round(avg(raw), 6) + 0.0 AS raw, round(avg(within), 6) + 0.0 AS within, round(avg(\"between\"), 6) + 0.0 AS \"between\", count(raw) AS n_bars FROM (SELECT factor, bar, {pearson('a', 'b', 5)} AS raw, {pearson('ia', 'ib', 5)} AS within, CASE WHEN count(DISTINCT block) >= 2 THEN {pearson('am', 'bm')} END AS \"between\" FROM (SELECT *, CASE WHEN size >= 2 THEN a - am END AS ia, CASE WHEN size >= 2 THEN b - bm END AS ib FROM tri) GROUP BY factor, bar) JOIN windows ON bar BETWEEN lo AND hi GROUP BY factor, win", ("bth", "SELECT factor, bar, code, block, value, fwd FROM factors WHERE value IS NOT NULL AND fwd IS NOT NULL UNION ALL SELECT 'ensemble', e.bar, e.code, p.block, round(e.alpha, 9), p.fwd FROM ens e JOIN panel p ON p.bar = e.bar AND p.code = e.code WHERE e.alpha IS NOT NULL AND p.fwd IS NOT NULL"), IC[1], TRIPLE, base="factors").replace("bth AS MATERIALIZED", ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ENSEMBLE) + ", bth AS MATERIALIZED"))
def ic_triple_summary(spark, sf_dir):
    """The three correlations, whole, within blocks and between them, averaged over each window, for every factor and the ensemble."""
    f = factors(spark, sf_dir).select("factor", "bar", "code", "block", "value", "fwd")
    e = ensemble_alpha(spark, sf_dir).filter("alpha is not null").join(P.panel(spark, sf_dir).select("bar", "code", "block", "fwd"), ["bar", "code"])
    both = f.unionByName(e.select(F.lit("ensemble").alias("factor"), "bar", "code", "block", F.round("alpha", 9).alias("value"), "fwd"))
    t = P.in_windows(ic.ic_triple(both))
    return t.groupBy("factor", "window").agg(*[F.avg(c).alias(c) for c in ("raw", "within", "between")], F.count("raw").alias("n_bars"))


RANKED_RIVAL = f" UNION ALL SELECT 'rank', 0.2, 'inv_vol', r.bar, r.code, r.alpha, m.sigma FROM (SELECT bar, code, round(avg(v), 9) AS alpha FROM (SELECT factor, bar, code, {ranks('value', 'factor, bar')} / count(value) OVER (PARTITION BY factor, bar) AS v FROM factors WHERE factor IN ('rev1', 'mom13', 'lowvol')) GROUP BY bar, code) r JOIN members m ON r.bar = m.bar AND r.code = m.code WHERE r.alpha IS NOT NULL"


@query("ensemble_correlations", sql(f"SELECT a.cell AS c1, b.cell AS c2, round({pearson('a.net', 'b.net')}, 6) AS rho, count(*) AS n FROM knet a JOIN knet b ON a.bar = b.bar AND a.cell < b.cell GROUP BY 1, 2", *ENSEMBLE, *keyed(RIVALS + RANKED_RIVAL), base="factors"))
def ensemble_correlations(spark, sf_dir):
    """Single factors' books, that of their mean score and that of their mean rank: correlations of their returns."""
    f = factors(spark, sf_dir).filter("value is not null and factor in ('rev1', 'mom13', 'lowvol')")
    single = f.select(F.col("factor").alias("cell"), "bar", "code", F.col("value").alias("alpha"), "sigma")
    sigma = eligible(spark, sf_dir).select("bar", "code", "sigma")
    e = ensemble_alpha(spark, sf_dir).filter("alpha is not null").join(sigma, ["bar", "code"]).select(F.lit("rowz").alias("cell"), "bar", "code", "alpha", "sigma")
    ranked = ic.average_rank(f, "value", ["factor", "bar"], "r").withColumn("v", F.col("r") / F.count("*").over(Window.partitionBy("factor", "bar")))
    r = ranked.groupBy("bar", "code").agg(F.round(F.avg("v"), 9).alias("alpha")).join(sigma, ["bar", "code"]).select(F.lit("rank").alias("cell"), "bar", "code", "alpha", "sigma")
    series = store.cut(keyed_net(spark, sf_dir, single.union(e).union(r).withColumn("q", F.lit(0.2)).withColumn("sizing", F.lit("inv_vol"))).select("cell", "bar", "net"), "rivals")
    return ic.correlations(series.select("bar", F.lit(0).alias("code"), F.col("cell").alias("factor"), F.col("net").alias("value")), 2).select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rho", "n")


# --- leverage and blends ---------------------------------------------------------------------------------------------

TARGETS, CAPS = (0.2, 0.3, 0.4), (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 5.0)
CELLS21 = [
    *BOOK,
    CURVE,
    FUND,
    ("ew", f"SELECT bar, {ewma_sql('gross', 'seq')} AS sig FROM net JOIN calx USING (bar) WINDOW w AS (ORDER BY bar ROWS UNBOUNDED PRECEDING)"),
    ("prior", "SELECT bar, lag(sig) OVER (ORDER BY bar) AS sp FROM ew"),
    ("cells21", "SELECT target, cap FROM (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TARGETS) + ") a(target) CROSS JOIN (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in CAPS) + ") b(cap)"),
    ("lv", "SELECT bar, gross, target, cap, sp, round(accrual, 12) AS funding, round(accrual, 12) * 0.5 AS cash_rate, turnover * 0.001 AS cost, (1 - least(1.0, n_held)) * round(accrual, 12) * 0.5 AS carry, CASE WHEN gross <> 0 AND sp > 0 THEN greatest(1.0, least(cap, target / sp)) ELSE 1.0 END AS l FROM net JOIN prior USING (bar) JOIN fund USING (bar) CROSS JOIN cells21"),
    ("lev", "SELECT *, (l - 1) * funding AS funding_cost, l * gross + carry - (l - 1) * funding - cost AS net FROM lv"),
]


@query("leverage_cells", sql('SELECT win AS "window", target, cap, count(*) AS n_bars, ' + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in _LEV_STATS.items()) + " FROM (SELECT *, quantile_cont(funding, 0.9) OVER (PARTITION BY win, target, cap) AS p90 FROM lev JOIN windows ON bar BETWEEN lo AND hi) GROUP BY win, target, cap", *CELLS21))
def leverage_cells(spark, sf_dir):
    """Three volatility targets by seven caps, all windows, one plan: a row of performance, leverage, drags and tails each."""
    base = levered(spark, sf_dir, (1.0,)).select("bar", "gross", "cash", "sigma_prior", "funding", "cash_rate", "cost")
    cells = spark.createDataFrame([(t, c) for t in TARGETS for c in CAPS], "target double, cap double")
    # 21 rows
    every = leverage.vol_target(base.crossJoin(F.broadcast(cells)), F.col("target"), F.col("cap"))
    return leverage.summary(P.in_windows(every), ["window", "target", "cap"], F.col("cap"))


_SHARES = "SELECT share::DOUBLE AS share FROM (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) s(share)"
_TWO = "SELECT 'a' AS cell, 0.2::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, rev4 AS alpha, sigma FROM members UNION ALL SELECT 'b', 0.2, 'inv_vol', bar, code, lowvol, sigma FROM members"
FIXED = [
    *keyed(_TWO),
    ("two", "SELECT a.bar, a.net AS a, b.net AS b FROM knet a JOIN knet b ON a.bar = b.bar WHERE a.cell = 'a' AND b.cell = 'b'"),
    ("mixes", f"SELECT 'fixed_' || round(share * 100)::INT AS cell, bar, share * a + (1 - share) * b AS net FROM two CROSS JOIN ({_SHARES}) UNION ALL SELECT 'oracle', bar, greatest(a, b) FROM two UNION ALL SELECT 'worst', bar, least(a, b) FROM two"),
    ("st", _stats_sql('cell, "window"', 'SELECT cell, bar, net, win AS "window" FROM mixes JOIN windows ON bar BETWEEN lo AND hi')),
]


@query("oracle_blends", sql("SELECT *, coalesce(cell LIKE 'fixed%' AND sharpe = max(CASE WHEN cell LIKE 'fixed%' THEN sharpe END) OVER (PARTITION BY \"window\"), FALSE) AS best_fixed FROM st", *FIXED))
def oracle_blends(spark, sf_dir):
    """Two books mixed at fixed shares, and at each bar the better and the worse one in hindsight: the room that any timing has. The best fixed share of each window is marked."""
    m = P.members(P.panel(spark, sf_dir))
    parts = [m.select(F.lit(c).alias("cell"), "bar", "code", F.col(a).alias("alpha"), "sigma", F.lit(0.2).alias("q"), F.lit("inv_vol").alias("sizing")) for c, a in (("a", "rev4"), ("b", "lowvol"))]
    two = keyed_net(spark, sf_dir, parts[0].union(parts[1])).groupBy("bar").agg(*[F.max(F.when(F.col("cell") == c, F.col("net"))).alias(c) for c in ("a", "b")])
    fixed = [F.struct(F.lit(f"fixed_{round(s * 100)}").alias("cell"), (F.lit(s) * F.col("a") + F.lit(1 - s) * F.col("b")).alias("net")) for s in (0.0, 0.25, 0.5, 0.75, 1.0)]
    ends = [F.struct(F.lit(n).alias("cell"), f("a", "b").alias("net")) for n, f in (("oracle", F.greatest), ("worst", F.least))]
    mixes = two.select("bar", F.explode(F.array(*fixed, *ends)).alias("m")).select("m.cell", "bar", "m.net")
    s = metrics.window_stats(P.in_windows(mixes), ["cell", "window"]).filter("n_bars >= 2").withColumn("sharpe", F.round("sharpe", 6))
    timed = F.col("cell").startswith("fixed")
    return s.withColumn("best_fixed", F.coalesce(timed & (F.col("sharpe") == F.max(F.when(timed, F.col("sharpe"))).over(Window.partitionBy("window"))), F.lit(False)))


_PRED = "SELECT bar, code, 'roll26' AS predictor, sigma * sqrt(52.0) AS f, fv FROM fwdvol UNION ALL SELECT bar, code, 'last', abs(lr) * sqrt(52.0), fv FROM fwdvol UNION ALL SELECT bar, code, 'lag4', lag(fv, 5) OVER (PARTITION BY code ORDER BY bar), fv FROM fwdvol"


@query("predictor_quality", sql(f"SELECT code, predictor, count(*) AS n, round(sqrt(avg((f - fv) * (f - fv))), 5) AS rmse, round(avg(abs(f - fv)), 5) AS mae, round({pearson('f', 'fv')}, 5) AS corr FROM (SELECT code, predictor, round(f, 9) AS f, round(fv, 9) AS fv FROM ({_PRED}) WHERE f IS NOT NULL AND fv IS NOT NULL) GROUP BY code, predictor HAVING count(*) >= 10", FWDVOL))
def predictor_quality(spark, sf_dir):
    """Forecasts of volatility against what came, a row for each code and predictor."""
    p = predictor_alignment(spark, sf_dir).select("bar", F.struct("code", "predictor").alias("code"), F.round("value", 9).alias("f"), F.round("realised", 9).alias("fv"))
    g = vol.quality(p, "f", "fv", ["code"]).select("code.code", "code.predictor", "n", *[F.round(c, 5).alias(c) for c in ("rmse", "mae", "corr")])
    return g
