"""Studies that put operators together: books day by day, attribution, popularity, books within blocks, screens driven by their own result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import div, probit_sql
from ..operators import book, daily, hysteresis, ic, leverage, metrics, ridge
from ..plans import panel as P
from ..plans import store
from .books import SCREEN, SCREENED, keyed, keyed_net, screen_cell
from .core import BLOCK_DEDUP, BOOK, CAL, EZ, Q, SQL, _stats_sql, _block_dedup, block_dedup, block_strength, by_strength, eligible, ensemble_alpha, factors, long_book, net, query, walk_sql  # noqa: F401
from .models import NW, replace_steps
from .sql import KMOVED, KNET, pearson, ranks, sql

# --- day by day ------------------------------------------------------------------------------------------------------

DAYBOOK = [
    *BOOK,
    ("moves", "SELECT * FROM (SELECT date, code, close, lag(close) OVER (PARTITION BY code ORDER BY date) AS prev FROM daily) WHERE prev IS NOT NULL"),
    ("dated", "SELECT d.date, c.bar FROM (SELECT DISTINCT date FROM daily) d ASOF JOIN calx c ON d.date > c.bar WHERE c.bar >= (SELECT min(bar) FROM book)"),
    ("hd", "SELECT m.date, b.w, m.close, m.prev, m.base FROM (SELECT m.*, t.bar, first_value(prev) OVER (PARTITION BY code, t.bar ORDER BY m.date) AS base FROM moves m JOIN dated t ON m.date = t.date) m JOIN book b ON b.bar = m.bar AND b.code = m.code"),
    ("earned", "SELECT date, sum(w * (close / prev - 1)) AS ret, sum(w * (close - prev) / base) AS pnl, count(*) AS n FROM hd GROUP BY date"),
    ("dbook", "SELECT t.date, t.bar, coalesce(ret, 0.0) AS ret, coalesce(pnl, 0.0) AS pnl, coalesce(n, 0) AS n FROM dated t LEFT JOIN earned e ON e.date = t.date"),
]


def day_book(spark, sf_dir):
    return daily.book_returns(long_book(spark, sf_dir), P.daily(spark, sf_dir), P.panel(spark, sf_dir).select("bar"))


@query("daily_book_return", sql("SELECT date, bar, round(ret, 6) + 0.0 AS ret, round(pnl / nullif(1 + coalesce(sum(pnl) OVER (PARTITION BY bar ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0), 6) + 0.0 AS drifted, n FROM dbook", *DAYBOOK))
def daily_book_return(spark, sf_dir):
    """The flagship day by day: with the weights of the bar before, and with weights that drift from there."""
    return day_book(spark, sf_dir)


def _ewma(x: str, i: str, half: float, least: int, scale: float) -> str:
    u = f"exp({i} * ln(2.0) / {half})"
    return f"CASE WHEN count({x}) OVER w >= {least} THEN sqrt(sum({x} * {x} * {u}) OVER w / sum({u}) OVER w * {scale}) END"


_LATER = "CASE WHEN count(gross) OVER f{h} = {h} THEN stddev_samp(gross) OVER f{h} * sqrt(52.0) END AS fwd{h}"
CALIBRATION = [
    *DAYBOOK,
    ("nwp", "SELECT bar, p, len(p) AS n, list_avg(p) AS m FROM (SELECT bar, list(gross) OVER (ORDER BY bar ROWS 51 PRECEDING) AS p FROM net)"),
    ("nwd", NW[1][1].replace("code, ", "")),
    ("nwc", NW[2][1].replace("code, ", "")),
    ("wk", f"SELECT net.bar, gross AS ret, {_ewma('gross', 'seq', 26.0, 13, 52.0)} AS weekly_ewma, {_LATER.format(h=4)}, {_LATER.format(h=13)} FROM net JOIN calx USING (bar) WINDOW w AS (ORDER BY net.bar ROWS UNBOUNDED PRECEDING), f4 AS (ORDER BY net.bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), f13 AS (ORDER BY net.bar ROWS BETWEEN 1 FOLLOWING AND 13 FOLLOWING)"),
    ("dayi", "SELECT date, ret, row_number() OVER (ORDER BY date) AS i FROM dbook"),
    ("dy", f"SELECT date, {_ewma('ret', 'i', 30.0, 30, 252.0)} AS daily_ewma, CASE WHEN count(ret) OVER r >= 30 THEN stddev_samp(ret) OVER r * sqrt(252.0) END AS daily_60d FROM dayi WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING), r AS (ORDER BY date ROWS 59 PRECEDING)"),
    ("side", "SELECT wk.*, CASE WHEN n >= 26 THEN sqrt(greatest(c0 + 1.6 * c1 + 1.2 * c2 + 0.8 * c3 + 0.4 * c4, 0.0) * 52.0) END AS weekly_newey_west, daily_ewma, daily_60d FROM wk LEFT JOIN nwc ON nwc.bar = wk.bar ASOF LEFT JOIN dy ON wk.bar >= dy.date"),
    ("est", " UNION ALL ".join(f"SELECT bar, ret, fwd4, fwd13, '{e}' AS estimator, {e} AS est FROM side" for e in ("weekly_ewma", "weekly_newey_west", "daily_ewma", "daily_60d"))),
]
_SHAPE = ", ".join(f"round(CASE WHEN count(est / nullif(fwd{h}, 0)) >= 4 THEN {f.format(x=f'est / nullif(fwd{h}, 0)')} END, 4) AS fwd{h}_{n}" for h in (4, 13) for n, f in (("mean", "avg({x})"), ("p50", "quantile_cont({x}, 0.5)"), ("p95", "quantile_cont({x}, 0.95)")))
_SIGMA = f"""SELECT estimator, win AS "window", count(est) AS n, round(m, 6) AS est, round(s, 6) AS realised, round(m / nullif(s, 0), 4) AS ratio, round(avg(est - fwd13), 6) + 0.0 AS bias, round(avg(CASE WHEN est / nullif(fwd13, 0) IS NOT NULL THEN (abs(est / nullif(fwd13, 0) - 1) <= 0.25)::INT END), 6) AS hit, {_SHAPE},
 coalesce(m / nullif(s, 0) BETWEEN 0.9 AND 1.1, FALSE) AS qualifies FROM (SELECT e.*, win, CASE WHEN count(est) OVER g >= 8 AND count(ret) OVER g >= 8 THEN avg(est) OVER g END AS m, CASE WHEN count(est) OVER g >= 8 AND count(ret) OVER g >= 8 THEN stddev_samp(ret) OVER g * sqrt(52.0) END AS s FROM est e JOIN windows ON bar BETWEEN lo AND hi WINDOW g AS (PARTITION BY estimator, win)) GROUP BY estimator, win, m, s"""


@query("sigma_calibration", sql(_SIGMA, *CALIBRATION))
def sigma_calibration(spark, sf_dir):
    """Two estimators on weeks and two on days, side by side on the book's bars: how far each is from what the returns were."""
    weekly = net(spark, sf_dir).select("bar", F.col("gross").alias("ret"))
    est = daily.estimates(weekly, day_book(spark, sf_dir))
    out = daily.calibration(P.in_windows(est), ["estimator", "window"])
    return out.select(*[F.round(c, 4).alias(c) if c == "ratio" or c.startswith("fwd") else F.col(c) for c in out.columns])


# --- attribution -----------------------------------------------------------------------------------------------------

_LEGS = "SELECT 'bond' AS cell, 1.0::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, 0 AS alpha, sigma FROM members WHERE block = 0 UNION ALL SELECT 'equity', 1.0, 'inv_vol', bar, code, 0, sigma FROM members WHERE block = 1"
HEDGE = [
    *BOOK[:3],
    *keyed(_LEGS),
    BOOK[4],
    BOOK[5],
    ("hs", 'SELECT net.bar, win AS "window", net.net AS y, b.net AS x, e.net AS z FROM net JOIN (SELECT bar, net FROM knet WHERE cell = \'bond\') b ON b.bar = net.bar JOIN (SELECT bar, net FROM knet WHERE cell = \'equity\') e ON e.bar = net.bar JOIN windows ON net.bar BETWEEN lo AND hi'),
    ("hc", 'SELECT "window", count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM hs GROUP BY "window"'),
    ("hb", 'SELECT *, (xy * zz - zy * xz) / d AS bx, (zy * xx - xy * xz) / d AS bz FROM (SELECT *, CASE WHEN n >= 4 AND xx * zz - xz * xz > 1e-12 * xx * zz THEN xx * zz - xz * xz END AS d FROM hc)'),
    ("hh", 'SELECT "window", avg(y - bx * x - bz * z) / nullif(stddev_samp(y - bx * x - bz * z), 0) * sqrt(52.0) AS sharpe FROM hs JOIN hb USING ("window") GROUP BY "window"'),
]


@query("bivariate_hedge", sql('SELECT "window", n, round(bx, 4) + 0.0 AS beta_bond, round(bz, 4) + 0.0 AS beta_equity, round((my - bx * mx - bz * mz) * 52, 6) + 0.0 AS alpha_ann, round((bx * xy + bz * zy) / nullif(yy, 0), 4) + 0.0 AS r2, round(sharpe, 4) + 0.0 AS hedged_sharpe FROM hb LEFT JOIN hh USING ("window")', *HEDGE))
def bivariate_hedge(spark, sf_dir):
    """The flagship on a bond leg and an equity leg at once, in each window: betas, what is left, and the Sharpe ratio of the hedged series."""
    m = eligible(spark, sf_dir)
    legs = [m.filter(F.col("block") == b).select(F.lit(c).alias("cell"), "bar", "code", F.lit(0).alias("alpha"), "sigma", F.lit(1.0).alias("q"), F.lit("inv_vol").alias("sizing")) for b, c in ((0, "bond"), (1, "equity"))]
    wide = keyed_net(spark, sf_dir, legs[0].union(legs[1])).groupBy("bar").agg(*[F.max(F.when(F.col("cell") == c, F.col("net"))).alias(c) for c in ("bond", "equity")])
    both = P.in_windows(net(spark, sf_dir).select("bar", "net").join(wide, "bar").filter("bond is not null and equity is not null"))
    h = leverage.bivariate(both, "net", "bond", "equity", ["window"])
    return h.select("window", "n", *[F.round(c, 4).alias(c) for c in ("beta_bond", "beta_equity")], (F.col("alpha") * 52).alias("alpha_ann"), F.round("r2", 4).alias("r2"), F.round("hedged_sharpe", 4).alias("hedged_sharpe"))


# --- ridge over a grid of penalties ----------------------------------------------------------------------------------

RIDGED = [n for n in P.FACTORS if n != "amt"]


def ridge_rows(spark, sf_dir):
    """(bar, code, five factors' row z, y, fwd): y is the next return less the bar's mean."""
    m = P.panel(spark, sf_dir).filter("member").select("bar", "code", "fwd", *RIDGED)
    # a row for each bar: rows of the panel have all factors side by side, so none is shuffled
    s = m.groupBy("bar").agg(F.avg("fwd").alias("_fwd"), *[f(c).alias(f"{n}{c}") for c in RIDGED for n, f in (("_m_", F.avg), ("_s_", F.stddev_samp))])
    z = [div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in RIDGED]
    return store.cut(m.join(F.broadcast(s), "bar").select("bar", "code", *z, "fwd", (F.col("fwd") - F.col("_fwd")).alias("y")), "ridge")


def ridged(spark, sf_dir):
    """(fits, forecasts) of all penalties and folds."""
    rows = ridge_rows(spark, sf_dir)
    placed = store.cut(ridge.folds(rows), "folds")
    summed = ridge.products(rows.dropna(subset=[*RIDGED, "y"]).join(F.broadcast(placed.select("bar", "trains")), "bar"), RIDGED, "y")
    fitted = store.cut(ridge.fits(summed, placed.filter("fold is not null")), "fits")
    return placed, fitted, store.cut(ridge.forecasts(rows, placed, fitted, RIDGED), "forecasts")


def ridge_ics(found):
    """(alpha, n_bars and mean IC in sample and after it, chosen): the penalty of the highest mean IC in sample, the smaller one on ties."""
    per_bar = ic.rank_ic(found, "pred", "fwd", ["alpha", "bar"])
    inside = F.col("bar") <= P.IS_END
    g = per_bar.groupBy("alpha").agg(*[F.count(F.when(w, F.col("ic"))).alias(f"{n}_bars") for n, w in (("is", inside), ("oos", ~inside))], *[F.avg(F.when(w, F.col("ic"))).alias(f"{n}_ic") for n, w in (("is", inside), ("oos", ~inside))])
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("is_ic", 9).desc_nulls_last(), "alpha"))
    return g.withColumn("chosen", rank == 1)


@query("ridge_grid")
def ridge_grid(spark, sf_dir):
    """Out-of-fold forecasts of every penalty: mean IC by period, and the one that is taken."""
    return ridge_ics(ridged(spark, sf_dir)[2])


@query("ridge_stability")
def ridge_stability(spark, sf_dir):
    """Of the penalty that is taken: do the last five folds that end in sample agree on the factors' signs."""
    placed, fitted, found = ridged(spark, sf_dir)
    taken = ridge_ics(found).filter("chosen").select("alpha")
    ended = placed.filter("fold is not null").groupBy("fold").agg(F.max("bar").alias("last")).filter(F.col("last") <= P.IS_END).select("fold")
    return ridge.stability(fitted.join(F.broadcast(taken), "alpha", "left_semi").join(F.broadcast(ended), "fold", "left_semi"), RIDGED)


@query("ridge_blend")
def ridge_blend(spark, sf_dir):
    """The forecasts of the penalty that is taken, half and half by rank with the ensemble's score: performance of the book of each and of the blend."""
    _, _, found = ridged(spark, sf_dir)
    scored = found.join(F.broadcast(ridge_ics(found).filter("chosen").select("alpha")), "alpha", "left_semi").select("bar", "code", F.col("pred").alias("alpha"))
    # read by several steps, and a few numbers for each name and bar
    scored = store.cut(scored, "scored")
    e = store.cut(ensemble_alpha(spark, sf_dir).filter("alpha is not null").join(F.broadcast(scored.select("bar").distinct()), "bar", "left_semi"), "ensemble")
    rivals = {"ridge": scored, "ensemble": e, "blend": ic.rank_blend(e, scored)}
    # a name and bar once, with all three scores
    keys = ["bar", "code"]
    every = [df.filter("alpha is not null").select(*keys, *[(F.col("alpha") if n == m else F.lit(None).cast("double")).alias(m) for m in rivals]) for n, df in rivals.items()]
    wide = every[0].union(every[1]).union(every[2]).groupBy(*keys).agg(*[F.max(n).alias(n) for n in rivals])
    wide = store.cut(wide.join(eligible(spark, sf_dir).select(*keys, "sigma", "fwd"), keys), "rivals")
    long = wide.unpivot([*keys, "sigma", "fwd"], list(rivals), "cell", "alpha").filter("alpha is not null").withColumn("q", F.lit(0.2)).withColumn("sizing", F.lit("inv_vol"))
    series = store.cut(keyed_net(spark, sf_dir, long, cheap=True), "series")
    return metrics.window_stats(P.in_windows(series), ["cell", "window"]).filter("n_bars >= 2")


# --- popularity ------------------------------------------------------------------------------------------------------

POPULAR = [
    ("elig", "SELECT bar, code, block, sigma FROM members WHERE bar <= DATE '1998-12-31'"),
    ("pscore", "SELECT f.factor, e.bar, e.code, e.block, f.value AS score FROM elig e JOIN factors f ON e.bar = f.bar AND e.code = f.code WHERE f.value IS NOT NULL AND f.factor <> 'lowvol' UNION ALL SELECT 'null', bar, code, block, -sigma FROM elig"),
    ("nb", "SELECT bar, block, count(*) AS nb FROM elig GROUP BY bar, block"),
    ("pick", "SELECT * FROM (SELECT p.*, nb, ceil(0.2::DOUBLE * nb)::BIGINT AS k, row_number() OVER (PARTITION BY factor, p.bar, p.block ORDER BY score DESC, code) AS rk FROM pscore p JOIN nb ON nb.bar = p.bar AND nb.block = p.block) WHERE rk <= k"),
    ("pres", "SELECT c.factor, e.block, e.code, coalesce(n, 0) / e.m AS p FROM (SELECT DISTINCT factor FROM pick) c CROSS JOIN (SELECT block, code, count(*)::DOUBLE AS m FROM elig GROUP BY block, code) e LEFT JOIN (SELECT factor, code, count(*) AS n FROM pick GROUP BY factor, code) k ON k.factor = c.factor AND k.code = e.code"),
    ("effn", "SELECT factor, block, sum(p) * sum(p) / nullif(sum(p * p), 0) AS eff_n, max(p) AS top_presence FROM pres GROUP BY factor, block"),
    ("bix", "SELECT block, bar, nb, lag(bar) OVER (PARTITION BY block ORDER BY bar) AS prior FROM nb"),
    ("moved_", "SELECT factor, block, bar, sum(d) AS d FROM (SELECT factor, block, bar, code, abs(sum(x)) AS d FROM (SELECT factor, block, bar, code, 1 AS x FROM pick UNION ALL SELECT p.factor, p.block, b.bar, p.code, -1 FROM pick p JOIN bix b ON b.block = p.block AND b.prior = p.bar) GROUP BY ALL) GROUP BY factor, block, bar"),
    ("churn_", "SELECT f.factor, b.block, avg(CASE WHEN prior IS NULL THEN 0.0 ELSE coalesce(d, 0) END / (2.0 * ceil(0.2::DOUBLE * nb))) AS turnover FROM (SELECT DISTINCT factor, block FROM pick) f JOIN bix b ON b.block = f.block LEFT JOIN moved_ m ON m.factor = f.factor AND m.block = f.block AND m.bar = b.bar GROUP BY f.factor, b.block"),
    ("over", "SELECT factor, block, avg(j) AS overlap FROM (SELECT a.factor, a.block, a.bar, sum(a.both_)::DOUBLE / (any_value(a.n) + any_value(m.n) - sum(a.both_)) AS j FROM (SELECT p.factor, p.block, p.bar, (z.code IS NOT NULL)::INT AS both_, count(*) OVER (PARTITION BY p.factor, p.block, p.bar) AS n FROM pick p LEFT JOIN pick z ON z.factor = 'null' AND z.bar = p.bar AND z.code = p.code WHERE p.factor <> 'null') a JOIN (SELECT bar, block, count(*) AS n FROM pick WHERE factor = 'null' GROUP BY bar, block) m ON m.bar = a.bar AND m.block = a.block GROUP BY a.factor, a.block, a.bar) GROUP BY factor, block"),
]


@query("popularity_verdict", sql("SELECT f.factor, f.block, round(eff_n, 4) AS eff_n, round(top_presence, 6) AS top_presence, round(turnover, 6) AS turnover, round(overlap, 6) AS overlap, round(null_n, 4) AS null_n, CASE WHEN overlap >= 0.7 AND abs(eff_n - null_n) / greatest(null_n, 1e-9) <= 0.2 THEN 'INV_VOL_LIKE' WHEN overlap <= 0.5 AND turnover >= 0.15 THEN 'ROTATIONAL' ELSE 'MIXED' END AS verdict FROM effn f JOIN churn_ c ON c.factor = f.factor AND c.block = f.block JOIN over o ON o.factor = f.factor AND o.block = f.block LEFT JOIN (SELECT block, eff_n AS null_n FROM effn WHERE factor = 'null') z ON z.block = f.block WHERE f.factor <> 'null'", *POPULAR, base="factors"))
def popularity_verdict(spark, sf_dir):
    """Which names each factor picks within each block in sample: how many there are in effect, how they turn over, and whether they are those of the lowest volatility."""
    m = eligible(spark, sf_dir).filter(F.col("bar") <= P.IS_END).select("bar", "code", "block", "sigma")
    f = factors(spark, sf_dir).filter("value is not null and factor <> 'lowvol'").select("factor", "bar", "code", F.col("value").alias("score"))
    scored = m.drop("sigma").join(f, ["bar", "code"]).select("factor", "bar", "code", "block", "score").union(m.select(F.lit("null").alias("factor"), "bar", "code", "block", (-F.col("sigma")).alias("score")))
    out = book.popularity_verdict(store.cut(book.picked(scored, m, 0.2), "picks"), m, "null")
    return out.select("factor", "block", F.round("eff_n", 4).alias("eff_n"), F.round("null_n", 4).alias("null_n"), "top_presence", "turnover", "overlap", "verdict")


# --- screens driven by their own result ------------------------------------------------------------------------------

_SCREEN_ST = ("st", _stats_sql('cell, "window"', 'SELECT cell, bar, net, win AS "window" FROM knet JOIN windows ON bar BETWEEN lo AND hi'))
TO_BOOK = [
    *SCREEN,
    _SCREEN_ST,
    ("scr", SCREENED),
    ("passing", "SELECT * FROM scr WHERE is_sharpe >= 0.5 AND oos_sharpe >= 0.2 AND oos_sharpe / nullif(is_sharpe, 0) >= 0.3"),
    ("g2", f"SELECT cell, bar, code, {probit_sql('u')} AS g FROM (SELECT cell, bar, code, CASE WHEN count(alpha) OVER (PARTITION BY cell, bar) >= 3 THEN ({ranks('alpha', 'cell, bar')} - 0.5) / count(alpha) OVER (PARTITION BY cell, bar) END AS u FROM kmem JOIN passing USING (cell))"),
    ("strength", "SELECT 0 AS block, cell AS factor, full_sharpe AS z FROM passing"),
    ("rhos", f"SELECT 0 AS block, a.cell AS f1, b.cell AS f2, coalesce({pearson('a.g', 'b.g')}, 0.0) AS rho FROM g2 a JOIN g2 b ON a.bar = b.bar AND a.code = b.code AND a.cell < b.cell WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY 2, 3"),
    *walk_sql(0.3),
    ("ensx", "SELECT bar, code, round(avg(z), 9) AS alpha FROM (SELECT cell, bar, code, (alpha - avg(alpha) OVER w) / nullif(stddev_samp(alpha) OVER w, 0) AS z FROM kmem WINDOW w AS (PARTITION BY cell, bar)) JOIN walk ON cell = factor AND kept WHERE z IS NOT NULL GROUP BY bar, code"),
    ("mem", "SELECT e.bar, e.code, block, e.alpha, sigma, fwd FROM ensx e JOIN members m ON m.bar = e.bar AND m.code = e.code"),
    *BOOK[1:3],
    *BOOK[4:],
    ("stx", _stats_sql('"window"', 'SELECT bar, net, win AS "window" FROM net JOIN windows ON bar BETWEEN lo AND hi')),
]


def passing_cells(spark, sf_dir):
    """(cell, full_sharpe) of the factors and polarities that pass the screen, from the series of a costed book of each."""
    return store.cut(screen_cell(spark, sf_dir).filter("passed").select("cell", "full_sharpe"), "passing")


@query("screen_to_book", sql('SELECT stx.*, (SELECT count(*) FROM passing) AS n_passed, (SELECT count(*) FROM walk WHERE kept) AS n_kept FROM stx', *TO_BOOK, base="factors"))
def screen_to_book(spark, sf_dir):
    """From the screen to a book: what passes, less what correlates with a better one, as the mean of row z, held by the best fifth. What is kept is a table that is joined on."""
    kept = passing_cells(spark, sf_dir)
    f = factors(spark, sf_dir).filter("value is not null").crossJoin(F.broadcast(spark.createDataFrame([(1,), (-1,)], "pol int")))
    f = f.withColumn("factor", F.concat("factor", F.when(F.col("pol") == 1, "+").otherwise("-"))).withColumn("value", F.col("value") * F.col("pol"))
    # a row for each factor and polarity at most
    some = store.cut(f.join(F.broadcast(kept.select(F.col("cell").alias("factor"))), "factor", "left_semi"), "passing-values")
    ranked = ic.gaussian_rank(some, "value", ["factor", "bar"]).select("factor", "bar", "code", F.col("g").alias("value"))
    rho = ic.correlations(ranked, 2).withColumn("one", F.lit(0))
    order = by_strength(kept.select(F.lit(0).alias("one"), F.col("cell").alias("factor"), F.col("full_sharpe").alias("z")), ["one"])
    taken = store.cut(ic.dedup(order, rho, 0.3, ["one"]).filter("kept").select("factor"), "kept")
    e = ic.ensemble(some, taken.withColumn("sign", F.lit(1.0))).withColumn("alpha", F.round("alpha", 9))
    m = eligible(spark, sf_dir).drop("alpha").join(e.filter("alpha is not null"), ["bar", "code"])
    series = book.run_book(book.static_weights(m), P.panel(spark, sf_dir))
    n = kept.agg(F.count("*").alias("n_passed")).crossJoin(taken.agg(F.count("*").alias("n_kept")))
    # one row of counts
    return metrics.window_stats(P.in_windows(series), ["window"]).filter("n_bars >= 2").crossJoin(F.broadcast(n))


# --- books within blocks ---------------------------------------------------------------------------------------------

STRONG = 0.5
_HELD = "greatest(1, ceil(0.2::DOUBLE * (count(*) OVER p))::BIGINT)"
_INSIDE = f"bar <= DATE '{P.IS_END}'"


def _against_nulls(spark, sf_dir, books, names):
    """(cell parts, performance in sample, differences from the block's null books, passes) of the names in books(cell, bar, code, sigma, fwd), alike and by inverse volatility; cells begin with their block.

    The null books hold every name of a block.
    """
    nulls = P.panel(spark, sf_dir).filter("member").select(F.concat_ws("|", "block", F.lit("null")).alias("cell"), "bar", "code", "sigma", "fwd")
    every = store.cut(books.select("cell", "bar", "code", "sigma", "fwd"), "held").unionByName(nulls)
    series = store.cut(book.run_sizings(every, P.panel(spark, sf_dir)).filter(F.col("bar") <= P.IS_END), "within")
    s = metrics.window_stats(series, ["cell"]).join(series.groupBy("cell").agg(F.avg("turnover").alias("turnover")), "cell")
    part = F.split("cell", r"\|")
    s = s.withColumns({c: F.round(c, 6) for c in ("sharpe", "cagr")})
    s = store.cut(s.withColumn("block", part[0].cast("long")), "within-stats")
    null = part[1] == "null"
    hurdles = s.filter(null).groupBy("block").agg(*[F.max(F.when(part[2] == z, F.col(c))).alias(f"_{c}_{z}") for z, c in (("eqw", "sharpe"), ("inv_vol", "sharpe"), ("eqw", "cagr"))])
    # one row for each block
    j = s.filter(~null).join(F.broadcast(hurdles), "block")
    better = (F.col("sharpe") > F.greatest("_sharpe_eqw", "_sharpe_inv_vol")) & (F.col("cagr") >= F.col("_cagr_eqw"))
    return j.select("block", *[part[i + 1].alias(n) for i, n in enumerate(names)], "sharpe", "cagr", "max_dd", "ann_vol", "turnover", (F.col("sharpe") - F.col("_sharpe_eqw")).alias("d_sharpe_eqw"), (F.col("sharpe") - F.col("_sharpe_inv_vol")).alias("d_sharpe_inv_vol"), (F.col("cagr") - F.col("_cagr_eqw")).alias("d_cagr_eqw"), better.alias("passes"))


def kept_within(spark, sf_dir):
    """(block, factor, z): what each block's dedup keeps, with its strength in sample; and (block, factor, bar, code, sigma, fwd, score): standard scores of those, better is higher."""
    s = store.cut(block_strength(spark, sf_dir), "strength")
    kept = store.cut(_block_dedup(spark, sf_dir, s).filter("kept and factor <> 'amt'").select("block", "factor").join(F.broadcast(s.select("block", "factor", "z")), ["block", "factor"]), "kept-within")
    f = P.long_factors_by(P.panel(spark, sf_dir), "code")
    scored = ic.expanding_z(f.join(F.broadcast(kept), ["block", "factor"]).withColumnRenamed("z", "_strength"), "value")
    sign = F.when(F.col("_strength") < 0, -1.0).otherwise(1.0)
    return kept, store.cut(scored.filter("z is not null").select("block", "factor", "bar", "code", "sigma", "fwd", (F.round(F.col("z") * sign, 7) + 0.0).alias("score")), "scores-within")


WITHIN = [
    *BLOCK_DEDUP,
    ("keptw", "SELECT w.block, w.factor, s.z FROM walk w JOIN strength s ON s.block = w.block AND s.factor = w.factor WHERE kept AND w.factor <> 'amt'"),
    EZ,
    ("ws", "SELECT e.block, e.factor, bar, code, sigma, round(e.z * CASE WHEN k.z < 0 THEN -1.0 ELSE 1.0 END, 7) + 0.0 AS score FROM ez e JOIN keptw k ON k.block = e.block AND k.factor = e.factor WHERE e.z IS NOT NULL"),
    CAL,
]
_SIZED = "SELECT cell || '|' || sizing AS cell, bar, code, raw / sum(raw) OVER (PARTITION BY cell, sizing, bar) AS w FROM (SELECT cell, sizing, bar, code, CASE WHEN sizing = 'eqw' THEN 1.0::DOUBLE ELSE 1 / sigma END AS raw FROM ({source}) CROSS JOIN (VALUES ('eqw'), ('inv_vol')) z(sizing))"
_NULLS = "SELECT block::VARCHAR || '|null' AS cell, bar, code, sigma FROM factors WHERE factor = 'lowvol'"


def _against_sql(names: list[str]) -> list[tuple[str, str]]:
    """Steps from rheld to the rows, `judged`."""
    parts = ", ".join(f"split_part(cell, '|', {i + 2}) AS {n}" for i, n in enumerate(names))
    return [
        ("kbook", _SIZED.format(source="SELECT cell, r.bar, r.code, sigma FROM rheld r JOIN (SELECT bar, code, sigma FROM factors WHERE factor = 'lowvol') f ON f.bar = r.bar AND f.code = r.code") + " UNION ALL " + _SIZED.format(source=_NULLS)),
        KMOVED,
        KNET,
        ("st", _stats_sql("cell", f"SELECT cell, bar, net FROM knet WHERE {_INSIDE}")),
        ("stt", f"SELECT st.*, split_part(st.cell, '|', 1)::BIGINT AS block, round(turnover, 6) AS turnover FROM st JOIN (SELECT cell, avg(turnover) AS turnover FROM knet WHERE {_INSIDE} GROUP BY cell) t ON t.cell = st.cell"),
        ("hurd", "SELECT block, max(CASE WHEN cell LIKE '%|eqw' THEN sharpe END) AS se, max(CASE WHEN cell LIKE '%|inv_vol' THEN sharpe END) AS si, max(CASE WHEN cell LIKE '%|eqw' THEN cagr END) AS ce FROM stt WHERE cell LIKE '%|null|%' GROUP BY block"),
        ("judged", f"SELECT stt.block, {parts}, sharpe, cagr, max_dd, ann_vol, turnover, round(sharpe - se, 6) + 0.0 AS d_sharpe_eqw, round(sharpe - si, 6) + 0.0 AS d_sharpe_inv_vol, round(cagr - ce, 6) + 0.0 AS d_cagr_eqw, sharpe > greatest(se, si) AND cagr >= ce AS passes FROM stt JOIN hurd USING (block) WHERE cell NOT LIKE '%|null|%'"),
    ]


@query("block_solo_vs_null", sql("SELECT * FROM judged", *WITHIN, *replace_steps(f"SELECT block::VARCHAR || '|' || factor AS cell, bar, code, row_number() OVER (PARTITION BY block, factor, bar ORDER BY score DESC, code) AS rk, count(*) OVER p AS n, {_HELD} AS k, 0.2::DOUBLE AS epsilon FROM ws WINDOW p AS (PARTITION BY block, factor, bar)"), *_against_sql(["factor", "sizing"]), base="factors"))
def block_solo_vs_null(spark, sf_dir):
    """Each kept factor alone within its block under the replace rule, in both sizings, against holding the block: it passes with a higher Sharpe ratio than either null book and no less growth than the plain one."""
    _, scored = kept_within(spark, sf_dir)
    cell = F.concat_ws("|", "block", "factor")
    held = hysteresis.replace_book(scored.select(cell.alias("cell"), "bar", "code", F.col("score").alias("alpha"), "sigma", "fwd"), P.panel(spark, sf_dir), 0.2, 0.2, ["cell"], keep=("sigma", "fwd"), cheap=True)
    return _against_nulls(spark, sf_dir, held, ["factor", "sizing"])


PREFIXES = (1, 2, 3)
_ENS_K = " UNION ALL ".join(f"SELECT block, bar, code, '{k}' AS k, avg(z) AS alpha FROM rz WHERE pos <= {k} AND size > {k} GROUP BY block, bar, code" for k in PREFIXES)


@query("block_ensemble_sweep", sql("SELECT * FROM judged", *WITHIN, ("pool", f"SELECT block, factor, row_number() OVER (PARTITION BY block ORDER BY round(abs(z), 9) DESC, factor) AS pos, count(*) OVER (PARTITION BY block) AS size FROM keptw WHERE abs(z) >= {STRONG}"), ("rz", "SELECT w.block, w.factor, bar, code, pos, size, (score - avg(score) OVER g) / nullif(stddev_samp(score) OVER g, 0) AS z FROM ws w JOIN pool p ON p.block = w.block AND p.factor = w.factor WINDOW g AS (PARTITION BY w.block, w.factor, bar)"), ("pens", f"SELECT block, bar, code, k, round(alpha, 7) + 0.0 AS alpha FROM ({_ENS_K} UNION ALL SELECT block, bar, code, 'all', avg(z) FROM rz GROUP BY block, bar, code) WHERE alpha IS NOT NULL"), *replace_steps(f"SELECT block::VARCHAR || '|' || kk || '|' || eps AS cell, bar, code, row_number() OVER (PARTITION BY block, kk, eps, bar ORDER BY alpha DESC, code) AS rk, count(*) OVER p AS n, {_HELD} AS k, eps::DOUBLE AS epsilon FROM (SELECT block, bar, code, k AS kk, alpha FROM pens) CROSS JOIN (VALUES ('0.0'), ('0.2')) e(eps) WINDOW p AS (PARTITION BY block, kk, eps, bar)"), *_against_sql(["k", "epsilon", "sizing"]), base="factors"))
def block_ensemble_sweep(spark, sf_dir):
    """The strongest one, two, three and all of a block's kept factors, as means of their row z, in both bands and sizings, against holding the block. All prefixes are means of one pass."""
    kept, scored = kept_within(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.round(F.abs("z"), 9).desc(), "factor"))
    pool = kept.filter(F.abs("z") >= STRONG).withColumn("pos", rank).withColumn("size", F.count("*").over(Window.partitionBy("block"))).drop("z")
    z = scored.join(F.broadcast(pool), ["block", "factor"])
    z = ic.with_row_z(z, "score", ["block", "factor", "bar"])
    means = z.groupBy("block", "bar", "code").agg(F.first("sigma").alias("sigma"), F.first("fwd").alias("fwd"), *[F.avg(F.when((F.col("pos") <= k) & (F.col("size") > k), F.col("z"))).alias(str(k)) for k in PREFIXES], F.avg("z").alias("all"))
    long = store.cut(means, "means").unpivot(["block", "bar", "code", "sigma", "fwd"], [*map(str, PREFIXES), "all"], "prefix", "alpha").withColumn("alpha", F.round("alpha", 7) + 0.0).filter("alpha is not null")
    bands = spark.createDataFrame([("0.0", 0.0), ("0.2", 0.2)], "band string, epsilon double")
    held = hysteresis.replace_book(long, P.panel(spark, sf_dir), 0.2, F.col("epsilon"), ["block", "prefix", "band"], cells=bands, keep=("sigma", "fwd"), cheap=True)
    return _against_nulls(spark, sf_dir, held.withColumn("cell", F.concat_ws("|", "block", "prefix", "band")), ["k", "epsilon", "sizing"])
