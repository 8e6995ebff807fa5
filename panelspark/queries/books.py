"""Grids of books in one plan, two-layer books, diagnostics, sources and sinks, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import div, k_of
from ..functions.stats import rows
from ..operators import book, files, hysteresis, metrics, risk
from ..plans import panel as P
from ..plans import store
from .core import BLOCK_BOOK, BOOK, CAL, ENSEMBLE, MEMBERS, Q, SQL, _stats_sql, block_net, eligible, ensemble_alpha, factors, long_book, net, query  # noqa: F401
from .models import COMP, replace_steps
from .sql import KMOVED, KNET, sql

# --- grids of books, keyed by cell -----------------------------------------------------------------------------------


def keyed(source: str) -> list[tuple[str, str]]:
    """Steps from (cell, bar, code, alpha, sigma, q, sizing) to each cell's series, knet."""
    return [
        CAL,
        ("kmem", source),
        ("kbook", "SELECT cell, bar, code, raw / sum(raw) OVER (PARTITION BY cell, bar) AS w FROM (SELECT *, CASE WHEN sizing = 'eqw' THEN 1.0::DOUBLE ELSE 1 / sigma END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY cell, bar ORDER BY alpha DESC, code) AS rk, greatest(1, ceil(q * (count(*) OVER (PARTITION BY cell, bar)))::BIGINT) AS k FROM kmem) WHERE rk <= k)"),
        KMOVED,
        KNET,
    ]


def keyed_net(spark, sf_dir, df, cheap=False):
    return book.run_book(book.keyed_weights(df, cheap=cheap), P.panel(spark, sf_dir), ["cell"])


SIZINGS = "SELECT 'q' || lpad(round(q * 100)::INT::VARCHAR, 2, '0') || '_' || sizing AS cell, q::DOUBLE AS q, sizing FROM (VALUES (0.1), (0.2), (0.3), (0.4)) a(q) CROSS JOIN (VALUES ('eqw'), ('inv_vol')) b(sizing)"
GRID = [MEMBERS, ("params", SIZINGS), *keyed("SELECT cell, q, sizing, bar, code, alpha, sigma FROM mem CROSS JOIN params"), ("st", _stats_sql("cell", "SELECT cell, bar, net FROM knet"))]


def params(spark):
    """(cell, q, sizing): the cross of two short lists of parameters, tagged."""
    q = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "q double")
    sizing = spark.createDataFrame([("eqw",), ("inv_vol",)], "sizing string")
    return q.crossJoin(sizing).coalesce(1).select(F.concat(F.lit("q"), F.lpad(F.round(F.col("q") * 100).cast("int").cast("string"), 2, "0"), F.lit("_"), "sizing").alias("cell"), "q", "sizing")


def sizing_stats(spark, sf_dir):
    m = eligible(spark, sf_dir).crossJoin(F.broadcast(params(spark)))
    return metrics.window_stats(keyed_net(spark, sf_dir, m), ["cell"])


@query("cell_tags", sql("SELECT cell, q, sizing, round(avg(greatest(1, ceil(q * n))), 6) AS mean_k, count(*) AS bars FROM params CROSS JOIN (SELECT bar, count(*) AS n FROM mem GROUP BY bar) GROUP BY cell, q, sizing", MEMBERS, ("params", SIZINGS)))
def cell_tags(spark, sf_dir):
    """The cells of the grid by their tags, and how many names each holds: a cross join of parameters with the bars."""
    n = eligible(spark, sf_dir).groupBy("bar").agg(F.count("*").alias("n"))
    both = n.crossJoin(F.broadcast(params(spark))).withColumn("k", k_of("n", F.col("q")))
    return both.groupBy("cell", "q", "sizing").agg(F.avg("k").alias("mean_k"), F.count("*").alias("bars"))


@query("sizing_grid", sql("SELECT * FROM st JOIN params USING (cell)", *GRID))
def sizing_grid(spark, sf_dir):
    """Every size and sizing, a book each, in one plan: one row of performance for each."""
    return sizing_stats(spark, sf_dir).join(F.broadcast(params(spark)), "cell")


@query("grid_table", sql("SELECT * FROM ((SELECT 'top' AS part, cell, sharpe FROM st ORDER BY sharpe DESC, cell LIMIT 3) UNION ALL (SELECT 'bottom', cell, sharpe FROM st ORDER BY sharpe, cell LIMIT 3))", *GRID))
def grid_table(spark, sf_dir):
    """A report: the three best and the three worst cells."""
    s = sizing_stats(spark, sf_dir).select("cell", F.round("sharpe", 6).alias("sharpe"))
    top = s.orderBy(F.desc("sharpe"), "cell").limit(3).select(F.lit("top").alias("part"), "cell", "sharpe")
    return top.union(s.orderBy("sharpe", "cell").limit(3).select(F.lit("bottom"), "cell", "sharpe"))


SCREEN = keyed("SELECT factor || CASE WHEN pol = 1 THEN '+' ELSE '-' END AS cell, 0.2::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, value * pol AS alpha, sigma FROM factors CROSS JOIN (VALUES (1), (-1)) p(pol) WHERE value IS NOT NULL")
SCREENED = "SELECT cell, max(CASE WHEN \"window\" = 'is' THEN sharpe END) AS is_sharpe, max(CASE WHEN \"window\" = 'oos' THEN sharpe END) AS oos_sharpe, max(CASE WHEN \"window\" = 'full' THEN sharpe END) AS full_sharpe FROM st GROUP BY cell"


@query("screen_cell", sql(f"SELECT *, round(oos_sharpe / nullif(is_sharpe, 0), 4) + 0.0 AS decay, coalesce(is_sharpe >= 0.5 AND oos_sharpe >= 0.2 AND oos_sharpe / nullif(is_sharpe, 0) >= 0.3, FALSE) AS passed FROM ({SCREENED})", *SCREEN, ("st", _stats_sql('cell, "window"', 'SELECT cell, bar, net, win AS "window" FROM knet JOIN windows ON bar BETWEEN lo AND hi')), base="factors"))
def screen_cell(spark, sf_dir):
    """All factors in both polarities, a costed book each, in one plan; what passes does in sample, out of sample, and keeps enough of it."""
    f = factors(spark, sf_dir).filter("value is not null").crossJoin(F.broadcast(spark.createDataFrame([(1,), (-1,)], "pol int")))
    cell = F.concat("factor", F.when(F.col("pol") == 1, "+").otherwise("-"))
    m = f.select(cell.alias("cell"), "bar", "code", (F.col("value") * F.col("pol")).alias("alpha"), "sigma", "fwd", F.lit(0.2).alias("q"), F.lit("inv_vol").alias("sizing"))
    stats = metrics.window_stats(P.in_windows(keyed_net(spark, sf_dir, m, cheap=True)), ["cell", "window"]).filter("n_bars >= 2")
    s = stats.groupBy("cell").agg(*[F.max(F.when(F.col("window") == w, F.round("sharpe", 6))).alias(f"{w}_sharpe") for w in ("is", "oos", "full")])
    decay = div(F.col("oos_sharpe"), F.col("is_sharpe"))
    return s.withColumn("decay", F.round(decay, 4) + 0.0).withColumn("passed", F.coalesce((F.col("is_sharpe") >= 0.5) & (F.col("oos_sharpe") >= 0.2) & (decay >= 0.3), F.lit(False)))


RIVALS = "SELECT factor AS cell, 0.2::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, value AS alpha, sigma FROM factors WHERE value IS NOT NULL AND factor IN ('rev1', 'mom13', 'lowvol') UNION ALL SELECT 'rowz', 0.2, 'inv_vol', e.bar, e.code, e.alpha, m.sigma FROM ens e JOIN members m ON e.bar = m.bar AND e.code = m.code WHERE e.alpha IS NOT NULL"


@query("ensemble_comparison", sql("SELECT * FROM st", *ENSEMBLE, *keyed(RIVALS), ("st", _stats_sql("cell", "SELECT cell, bar, net FROM knet UNION ALL SELECT 'books', bar, avg(net) FROM knet WHERE cell <> 'rowz' GROUP BY bar")), base="factors"))
def ensemble_comparison(spark, sf_dir):
    """Single factors' books, the book of their mean score, and the mean of their books."""
    f = factors(spark, sf_dir).filter("value is not null and factor in ('rev1', 'mom13', 'lowvol')").select(F.col("factor").alias("cell"), "bar", "code", F.col("value").alias("alpha"), "sigma")
    e = ensemble_alpha(spark, sf_dir).filter("alpha is not null").join(eligible(spark, sf_dir).select("bar", "code", "sigma"), ["bar", "code"])
    m = f.unionByName(e.select(F.lit("rowz").alias("cell"), "bar", "code", "alpha", "sigma")).withColumn("q", F.lit(0.2)).withColumn("sizing", F.lit("inv_vol"))
    series = keyed_net(spark, sf_dir, m).select("cell", "bar", "net")
    mean = series.filter("cell <> 'rowz'").groupBy("bar").agg(F.avg("net").alias("net")).select(F.lit("books").alias("cell"), "bar", "net")
    return metrics.window_stats(series.union(mean), ["cell"])


@query("passive_books", sql("SELECT * FROM st", *keyed("SELECT 't1' AS cell, 1.0::DOUBLE AS q, 'inv_vol' AS sizing, bar, code, 0 AS alpha, sigma FROM members UNION ALL SELECT 't2', 1.0, 'inv_vol', bar, code, 0, sigma FROM members WHERE block = 0 UNION ALL SELECT 't3', 1.0, 'eqw', bar, code, 0, sigma FROM panel WHERE obs UNION ALL SELECT 't4', 1.0, 'eqw', bar, code, 0, sigma FROM members WHERE block = 0"), ("st", _stats_sql("cell", "SELECT cell, bar, net FROM knet"))))
def passive_books(spark, sf_dir):
    """Books that hold all: by inverse volatility, those of one block, all that trade alike whether or not their volatility is known, and one block alike."""
    p, m = P.panel(spark, sf_dir), eligible(spark, sf_dir)
    kinds = [("t1", "inv_vol", m), ("t2", "inv_vol", m.filter("block = 0")), ("t3", "eqw", p.filter("obs")), ("t4", "eqw", m.filter("block = 0"))]
    parts = [df.select(F.lit(c).alias("cell"), "bar", "code", F.lit(0).alias("alpha"), "sigma", F.lit(1.0).alias("q"), F.lit(s).alias("sizing")) for c, s, df in kinds]
    return metrics.window_stats(keyed_net(spark, sf_dir, parts[0].union(parts[1]).union(parts[2]).union(parts[3])), ["cell"])


# --- two layers ------------------------------------------------------------------------------------------------------

#: The factors that score each block, and each block's group with the group's share.
LOCKED = [(0, "rev1"), (0, "rev4"), (1, "mom13"), (2, "lowvol"), (2, "rev4"), (3, "disc"), (4, "amt"), (4, "mom13")]
GROUPS = [(0, "a", 0.6), (1, "a", 0.6), (2, "b", 0.4), (3, "b", 0.4), (4, "b", 0.4)]
BSCORE = [
    ("locked", "SELECT * FROM (VALUES " + ", ".join(f"({b}, '{f}')" for b, f in LOCKED) + ") t(block, factor)"),
    ("groups", "SELECT * FROM (VALUES " + ", ".join(f"({b}, '{g}', {s}::DOUBLE)" for b, g, s in GROUPS) + ") t(block, grp, share)"),
    ("bscore", "SELECT bar, block, code, any_value(sigma) AS sigma, round(avg(z), 9) + 0.0 AS alpha FROM (SELECT f.*, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM factors f JOIN locked USING (block, factor) WINDOW w AS (PARTITION BY block, factor, bar)) WHERE z IS NOT NULL GROUP BY bar, block, code"),
    ("bsub", "SELECT bar, block, code, 1.0::DOUBLE / least(k, n) AS w FROM (SELECT *, count(*) OVER p AS n, greatest(1, ceil(0.2::DOUBLE * (count(*) OVER p))::BIGINT) AS k, row_number() OVER (PARTITION BY bar, block ORDER BY alpha DESC, code) AS rk FROM bscore WINDOW p AS (PARTITION BY bar, block)) WHERE rk <= k"),
    ("bmix", "SELECT s.bar, s.code, s.block, s.w * share * nb / ng AS w FROM bsub s JOIN (SELECT block, share, nb, sum(nb) OVER (PARTITION BY grp) AS ng FROM groups JOIN (SELECT block, count(DISTINCT code) AS nb FROM members GROUP BY block) USING (block)) g USING (block)"),
]


def block_scores(spark, sf_dir):
    """(bar, block, code, sigma, alpha): mean score, within the bar and block, over the factors of the block."""
    locked = spark.createDataFrame(LOCKED, "block int, factor string")
    f = factors(spark, sf_dir)
    f = f.join(F.broadcast(locked.withColumn("block", F.col("block").cast(dict(f.dtypes)["block"]))), ["block", "factor"])
    w = Window.partitionBy("block", "factor", "bar")
    z = f.withColumn("z", div(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))).filter("z is not null")
    return z.groupBy("bar", "block", "code").agg(F.first("sigma").alias("sigma"), (F.round(F.avg("z"), 9) + 0.0).alias("alpha"))


def sub_blocks(spark, sf_dir, epsilon):
    """(bar, block, code, w): the best fifth of each block under the replace rule, all alike."""
    held = hysteresis.replace_book(block_scores(spark, sf_dir), P.panel(spark, sf_dir), 0.2, epsilon, ["block"], trim="worst_rank" if not epsilon else "as_published")
    return held.select("bar", "block", "code", (1.0 / F.count("*").over(Window.partitionBy("bar", "block"))).alias("w"))


def mixed(spark, sf_dir, epsilon=0.0):
    m = eligible(spark, sf_dir)
    groups = spark.createDataFrame(GROUPS, "block int, grp string, share double").withColumn("block", F.col("block").cast(dict(m.dtypes)["block"]))
    return book.group_mixed(sub_blocks(spark, sf_dir, epsilon), groups, m)


@query("block_alpha_scores", sql("SELECT bar, block, code, alpha FROM bscore", *BSCORE[:3], base="factors"), exact=("alpha",))
def block_alpha_scores(spark, sf_dir):
    return block_scores(spark, sf_dir).drop("sigma")


@query("alpha_sub_block", sql("SELECT bar, block, code, round(w, 6) AS w FROM bsub", *BSCORE[:4], base="factors"))
def alpha_sub_block(spark, sf_dir):
    return sub_blocks(spark, sf_dir, 0.0)


_BRANKS = "SELECT block AS cell, bar, code, row_number() OVER (PARTITION BY bar, block ORDER BY alpha DESC, code) AS rk, count(*) OVER p AS n, greatest(1, ceil(0.2::DOUBLE * (count(*) OVER p))::BIGINT) AS k, 0.3::DOUBLE AS epsilon FROM bscore WINDOW p AS (PARTITION BY bar, block)"


@query("alpha_sub_block_memory", sql("SELECT bar, cell AS block, code, round(1.0 / count(*) OVER (PARTITION BY bar, cell), 6) AS w FROM rheld", *BSCORE[:3], CAL, *replace_steps(_BRANKS), base="factors"))
def alpha_sub_block_memory(spark, sf_dir):
    return sub_blocks(spark, sf_dir, 0.3)


@query("group_mixing", sql("SELECT bar, code, round(w, 6) AS w FROM bmix", *BSCORE, base="factors"))
def group_mixing(spark, sf_dir):
    return mixed(spark, sf_dir)


@query("mean_k_cash", sql('SELECT win AS "window", round(avg(k), 6) AS mean_k, round(avg(1 - held), 6) + 0.0 AS cash, count(*) AS n FROM (SELECT bar, count(*) AS k, sum(w) AS held FROM bmix WHERE w <> 0 GROUP BY bar) JOIN windows ON bar BETWEEN lo AND hi GROUP BY win', *BSCORE, base="factors"))
def mean_k_cash(spark, sf_dir):
    """Names held and cash on the bars that hold any."""
    by_bar = mixed(spark, sf_dir).filter("w <> 0").groupBy("bar").agg(F.count("*").alias("k"), F.sum("w").alias("held"))
    return P.in_windows(by_bar).groupBy("window").agg(F.avg("k").alias("mean_k"), F.avg(1 - F.col("held")).alias("cash"), F.count("*").alias("n"))


@query("group_weight_yearly", sql("SELECT year(bar) AS year, block, round(sum(w) / any_value(n), 6) AS mean_w FROM bmix JOIN (SELECT year(bar) AS y, count(DISTINCT bar) AS n FROM bmix GROUP BY 1) ON year(bar) = y GROUP BY 1, 2", *BSCORE, base="factors"))
def group_weight_yearly(spark, sf_dir):
    """A block's mean weight in each year; bars without it count as zero."""
    w = mixed(spark, sf_dir).join(P.instruments(spark, sf_dir), "code").withColumn("year", F.year("bar"))
    n = w.groupBy("year").agg(F.count_distinct("bar").alias("n"))
    return w.groupBy("year", "block").agg(F.sum("w").alias("t")).join(F.broadcast(n), "year").select("year", "block", (F.col("t") / F.col("n")).alias("mean_w"))


# --- diagnostics -----------------------------------------------------------------------------------------------------


@query("turnover_at_refreshes", sql("SELECT r.bar IS NOT NULL AS refresh, count(*) AS n, round(avg(turnover), 6) AS mean_turnover, round(max(turnover), 6) AS max_turnover FROM net LEFT JOIN (SELECT min(bar) AS bar FROM panel GROUP BY year(bar), quarter(bar)) r ON net.bar = r.bar GROUP BY 1", *BOOK))
def turnover_at_refreshes(spark, sf_dir):
    dates = P.panel(spark, sf_dir).groupBy(F.year("bar"), F.quarter("bar")).agg(F.min("bar").alias("refresh"))
    return book.at_refreshes(net(spark, sf_dir), dates)


GATE = ("gate", "SELECT bar, block, CASE WHEN count(l) OVER w >= 43 THEN round(l, 9) > round(avg(l) OVER w, 9) END AS g FROM (SELECT bar, block, lag(nav) OVER (PARTITION BY block ORDER BY bar) AS l FROM (SELECT bar, block, exp(sum(ln(1 + coalesce(ret, 0.0))) OVER (PARTITION BY block ORDER BY bar)) AS nav FROM comp)) WINDOW w AS (PARTITION BY block ORDER BY bar ROWS 42 PRECEDING)")


@query("trend_gate_diagnostics", sql("SELECT block, round(avg(g::INT), 6) AS share_on, count(*) FILTER (g <> p) AS switches, count(g) AS n FROM (SELECT block, g, lag(g) OVER (PARTITION BY block ORDER BY bar) AS p FROM gate WHERE g IS NOT NULL) GROUP BY block", MEMBERS, COMP, GATE))
def trend_gate_diagnostics(spark, sf_dir):
    g = risk.trend_gate(risk.composites(eligible(spark, sf_dir))).filter(F.col("on").isNotNull())
    p = F.lag("on").over(Window.partitionBy("block").orderBy("bar"))
    return g.withColumn("p", p).groupBy("block").agg(F.avg(F.col("on").cast("int")).alias("share_on"), F.count_if(F.col("on") != F.col("p")).alias("switches"), F.count("on").alias("n"))


FWDVOL = ("fwdvol", "SELECT bar, code, block, member, sigma, lr, CASE WHEN count(lr) OVER w = 4 THEN stddev_samp(lr) OVER w * sqrt(52.0) END AS fv FROM panel WINDOW w AS (PARTITION BY code ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)")


def forward_vols(spark, sf_dir, weeks=4):
    """The panel with fv: annualised deviation of the next log returns, all needed."""
    ahead = Window.partitionBy("code").orderBy("bar").rowsBetween(1, weeks)
    return P.panel(spark, sf_dir).withColumn("fv", F.when(F.count("lr").over(ahead) == weeks, F.stddev_samp("lr").over(ahead) * F.sqrt(F.lit(52.0))))


@query("forward_vol", sql("SELECT bar, code, round(fv, 6) AS fv FROM fwdvol", FWDVOL))
def forward_vol(spark, sf_dir):
    return forward_vols(spark, sf_dir).select("bar", "code", "fv")


@query("predictor_alignment", sql("SELECT bar, code, predictor, round(value, 6) AS value, round(fv, 6) AS realised FROM (SELECT bar, code, 'roll26' AS predictor, sigma * sqrt(52.0) AS value, fv FROM fwdvol UNION ALL SELECT bar, code, 'last', abs(lr) * sqrt(52.0), fv FROM fwdvol UNION ALL SELECT bar, code, 'lag4', lag(fv, 5) OVER (PARTITION BY code ORDER BY bar), fv FROM fwdvol) WHERE value IS NOT NULL AND fv IS NOT NULL", FWDVOL))
def predictor_alignment(spark, sf_dir):
    """Forecasts on one scale, a row each, where both they and what came are known."""
    year = F.sqrt(F.lit(52.0))
    p = forward_vols(spark, sf_dir).withColumn("lag4", F.lag("fv", 5).over(Window.partitionBy("code").orderBy("bar")))
    wide = p.select("bar", "code", F.col("fv").alias("realised"), (F.col("sigma") * year).alias("roll26"), (F.abs("lr") * year).alias("last"), "lag4")
    return wide.unpivot(["bar", "code", "realised"], ["roll26", "last", "lag4"], "predictor", "value").filter("value is not null and realised is not null")


@query("realised_percentile", sql("SELECT bar, code, round((len(list_filter(h, lambda x: x < v)) + 0.5::DOUBLE * len(list_filter(h, lambda x: x = v))) / 52, 6) AS p FROM (SELECT bar, code, abs(lr) AS v, list(abs(lr)) FILTER (lr IS NOT NULL) OVER (PARTITION BY code ORDER BY bar ROWS 51 PRECEDING) AS h FROM panel) WHERE v IS NOT NULL AND len(h) = 52"))
def realised_percentile(spark, sf_dir):
    """Mid-rank of a value among the last 52, itself included; all are needed."""
    h = F.collect_list(F.abs("lr")).over(rows("code", "bar", -51))
    p = P.panel(spark, sf_dir).select("bar", "code", F.abs("lr").alias("v"), h.alias("h")).filter((F.size("h") == 52) & F.col("v").isNotNull())
    return p.select("bar", "code", ((F.size(F.filter("h", lambda x: x < F.col("v"))) + 0.5 * F.size(F.filter("h", lambda x: x == F.col("v")))) / 52).alias("p"))


@query("risk_score_oracles", sql("SELECT bar, round(avg(sigma), 6) AS causal, round(avg(s1), 6) AS ahead1, round(avg(s4), 6) AS ahead4, count(*) AS n FROM (SELECT bar, code, member, rev4, sigma, lead(sigma) OVER w AS s1, avg(sigma) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS s4 FROM panel WINDOW w AS (PARTITION BY code ORDER BY bar)) WHERE member AND sigma > 0 AND rev4 IS NOT NULL GROUP BY bar"))
def risk_score_oracles(spark, sf_dir):
    """Mean volatility of the members: as known, and as it will be one week ahead and over the next four, known values only; by code first, then the mean."""
    w = Window.partitionBy("code").orderBy("bar")
    p = P.panel(spark, sf_dir).withColumn("s1", F.lead("sigma").over(w)).withColumn("s4", F.avg("sigma").over(w.rowsBetween(1, 4)))
    return P.members(p).groupBy("bar").agg(F.avg("sigma").alias("causal"), F.avg("s1").alias("ahead1"), F.avg("s4").alias("ahead4"), F.count("*").alias("n"))


EPISODES = ("epi", "SELECT min(bar) AS start, max(bar) AS fin FROM (SELECT *, sum((dd >= 0)::INT) OVER (ORDER BY bar) AS run FROM (SELECT bar, nav / max(nav) OVER (ORDER BY bar) - 1 AS dd FROM (SELECT bar, 1 + sum(net) OVER (ORDER BY bar) AS nav FROM net))) WHERE dd < 0 GROUP BY run HAVING min(dd) <= -0.001")
SERIES = ("series", "SELECT bar, round(avg(sigma), 9) AS pred, round(avg(fv), 9) AS real FROM fwdvol WHERE member AND fv IS NOT NULL GROUP BY bar")


@query("lead_lag_peaks", sql("SELECT start, arg_max(bar, {'v': pred, 'd': -epoch_days}) AS pred_peak, arg_max(bar, {'v': real, 'd': -epoch_days}) AS real_peak, ((arg_max(bar, {'v': pred, 'd': -epoch_days}) - arg_max(bar, {'v': real, 'd': -epoch_days})) // 7)::INTEGER AS lag_weeks, count(*) AS n FROM epi JOIN (SELECT *, (bar - DATE '1970-01-01')::INTEGER AS epoch_days FROM series) s ON s.bar BETWEEN start - 56 AND fin + 28 GROUP BY start", *BLOCK_BOOK, FWDVOL, EPISODES, SERIES))
def lead_lag_peaks(spark, sf_dir):
    """For each drawdown, from 8 weeks before to 4 after: when the forecast peaks and when what came does, the first bar on ties. A range join with a few episodes."""
    epi = metrics.episodes(block_net(spark, sf_dir), depth=-0.001).select("start", F.col("end").alias("fin"))
    s = forward_vols(spark, sf_dir).filter("member and fv is not null").groupBy("bar").agg(F.round(F.avg("sigma"), 9).alias("pred"), F.round(F.avg("fv"), 9).alias("real"))
    j = s.join(epi, F.col("bar").between(F.date_sub("start", 56), F.date_add("fin", 28)))
    g = j.groupBy("start").agg(*[F.max_by("bar", F.struct(c, -F.unix_date("bar"))).alias(f"{c}_peak") for c in ("pred", "real")], F.count("*").alias("n"))
    return g.withColumn("lag_weeks", (F.datediff("pred_peak", "real_peak") / 7).cast("int"))


@query("headline_names", sql("SELECT code, bars, mean_w FROM (SELECT code, count(*) AS bars, round(avg(w), 6) AS mean_w FROM book GROUP BY code) ORDER BY bars DESC, code LIMIT 10", *BOOK[:3]))
def headline_names(spark, sf_dir):
    """A report: the ten names held longest."""
    return long_book(spark, sf_dir).groupBy("code").agg(F.count("*").alias("bars"), F.avg("w").alias("mean_w")).orderBy(F.desc("bars"), "code").limit(10)


@query("daily_alpha", sql("SELECT date, code, round(-(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1), 6) + 0.0 AS alpha FROM daily", base="daily"))
def daily_alpha(spark, sf_dir):
    """One factor, day by day, without the weekly calendar."""
    last = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    return P.daily(spark, sf_dir).select("date", "code", (-(F.col("close") / last - 1)).alias("alpha"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("csv_panel", sql("SELECT bar, code, close, amount, n_rows FROM cells", base="cells"))
def csv_panel(spark, sf_dir):
    """The weekly table through a CSV folder: written, and read back with declared types."""
    at = store.fresh(spark, "csv")
    files.write_csv(P.cells(spark, sf_dir).select("bar", "code", "close", "amount", "n_rows"), at)
    return files.read_csv(spark, at, "bar date, code bigint, close double, amount bigint, n_rows bigint")


@query("per_code_scan", sql("SELECT replace(s_name, '#', '_') AS stub, count(*) AS n, min(date) AS first_date, max(date) AS last_date, sum(amount)::BIGINT AS amount FROM daily JOIN supplier ON code = s_suppkey GROUP BY 1", base="daily"))
def per_code_scan(spark, sf_dir):
    """The daily table split into a folder for each code, and scanned."""
    at = store.fresh(spark, "codes")
    names = P.read(spark, sf_dir, "supplier", F.col("s_suppkey").alias("code"), "s_name")
    files.split_by_code(P.daily(spark, sf_dir).join(names, "code"), at, "s_name", "date")
    return spark.read.parquet(at).groupBy("stub").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("amount").alias("amount"))


@query("picks_json", sql("SELECT bar, code, side::INTEGER AS side, round(w, 6) + 0.0 AS w FROM ls WHERE w <> 0", *BOOK[:2], ("ls", "SELECT bar, code, side, side * 0.5 * (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY bar, side) AS w FROM (SELECT *, CASE WHEN rk <= k2 THEN 1 WHEN rk > n - k2 THEN -1 END AS side FROM (SELECT *, least(k, n // 2) AS k2 FROM rkd)) WHERE side IS NOT NULL")))
def picks_json(spark, sf_dir):
    """The picks of a book of two sides through a folder of JSON lines."""
    at = store.fresh(spark, "picks")
    files.write_json(files.picks(long_book(spark, sf_dir, long_short=True)), at)
    return spark.read.json(at, schema="bar date, code bigint, side int, w double", dateFormat=files.DATES)


@query("persisted_bundle", sql("SELECT cell, count(*) AS n, round(sum(k.net), 6) + 0.0 AS total, round(any_value(st.cum_ret), 6) + 0.0 AS told FROM knet k JOIN st USING (cell) GROUP BY cell", *GRID))
def persisted_bundle(spark, sf_dir):
    """Series of all cells, a folder each, and their summary as CSV: read back and added up against what it tells."""
    at = store.fresh(spark, "bundle")
    series = keyed_net(spark, sf_dir, eligible(spark, sf_dir).crossJoin(F.broadcast(params(spark))))
    files.persist_bundle(series, metrics.window_stats(series, ["cell"]).select("cell", "n_bars", "cum_ret"), at)
    told = files.read_csv(spark, f"{at}/summary", "cell string, n_bars bigint, cum_ret double")
    return spark.read.parquet(f"{at}/series").groupBy("cell").agg(F.count("*").alias("n"), F.sum("net").alias("total")).join(F.broadcast(told), "cell").select("cell", "n", "total", F.col("cum_ret").alias("told"))
