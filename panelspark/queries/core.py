"""Panel, universe, signal and book queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import corr_distance, div, friday, lit, probit_sql, r, ramp, step
from ..functions.stats import average_rank, first_rank, full, rows
from ..operators import book, ic, metrics, universe
from ..plans import panel as P
from .sql import pearson, ranks, sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, exact: tuple[str, ...] = ("close", "px", "qty", "discount")):
    """Register a query; its doubles are rounded to six digits but for those that both engines compute exactly."""

    def keep(f):
        Q[name] = lambda spark, sf_dir: P.rounded(f(spark, sf_dir), *exact)
        if text:
            SQL[name] = text
        return f

    return keep


MEMBERS = ("mem", "SELECT bar, code, block, rev4 AS alpha, sigma, fwd FROM members")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.members(P.panel(spark, sf_dir)).select("bar", "code", "block", F.col("rev4").alias("alpha"), "sigma", "fwd")


# --- panel -----------------------------------------------------------------------------------------------------------


@query("weekly_panel", sql("SELECT bar, code, close, amount, qty, n_rows, discount, block, idx FROM cells JOIN instruments USING (code)", base="instruments"))
def weekly_panel(spark, sf_dir):
    return P.cells(spark, sf_dir).join(P.instruments(spark, sf_dir), "code")


@query("daily_bars", sql("SELECT date, code, close, amount, qty FROM daily", base="daily"))
def daily_bars(spark, sf_dir):
    return P.daily(spark, sf_dir)


@query("dense_panel", sql("SELECT bar, code, px, obs, amount FROM p1", base="p1"))
def dense_panel(spark, sf_dir):
    return P.panel(spark, sf_dir).select("bar", "code", "px", "obs", "amount")


@query("forward_return", sql("SELECT bar, code, round(fwd, 6) + 0.0 AS fwd, round(ret, 6) + 0.0 AS ret FROM panel"))
def forward_return(spark, sf_dir):
    return P.panel(spark, sf_dir).select("bar", "code", "fwd", "ret")


@query("trailing_vol", sql("SELECT bar, code, round(sigma, 6) AS sigma, member FROM panel"))
def trailing_vol(spark, sf_dir):
    return P.panel(spark, sf_dir).select("bar", "code", "sigma", "member")


@query("complete_bars", sql("SELECT date, count(*) AS n FROM daily JOIN instruments USING (code) GROUP BY date HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM daily GROUP BY date))", base="instruments"))
def complete_bars(spark, sf_dir):
    """Days on which as many codes trade as on any day."""
    n = P.daily(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.max("n").alias("most"))), F.col("n") == F.col("most")).drop("most")


@query("asof_weekly_close", sql("SELECT g.bar, g.code, d.close FROM grid g ASOF LEFT JOIN daily d ON g.code = d.code AND g.bar >= d.date", base="grid"))
def asof_weekly_close(spark, sf_dir):
    return universe.as_of(P.grid(P.cells(spark, sf_dir)), P.daily(spark, sf_dir), "close")


@query("asof_next_business_day", sql("SELECT c.bar, c.code, d.date AS next_date FROM cells c ASOF LEFT JOIN daily d ON c.code = d.code AND c.bar + 3 <= d.date", base="cells"))
def asof_next_business_day(spark, sf_dir):
    """The first trade on or after the business day that follows a Friday: a forward as-of, by negated days."""
    c = P.cells(spark, sf_dir).select("bar", "code", (-F.unix_date(F.date_add("bar", 3))).alias("at"))
    d = P.daily(spark, sf_dir).select("code", "date", (-F.unix_date("date")).alias("at_date"))
    return universe.as_of(c, d, "date", at="at", date="at_date").select("bar", "code", F.col("date").alias("next_date"))


@query("window_bars", sql("SELECT win AS \"window\", min(bar) AS first_bar, max(bar) AS last_bar, count(DISTINCT bar) AS n_bars, count(*) AS cells FROM cells JOIN windows ON bar BETWEEN lo AND hi GROUP BY win", base="cells"))
def window_bars(spark, sf_dir):
    """A bar may fall in several windows: a range join with a handful of rows."""
    return P.in_windows(P.cells(spark, sf_dir)).groupBy("window").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count_distinct("bar").alias("n_bars"), F.count("*").alias("cells"))


@query("duplicate_keys", "SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    li = P.read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate")
    return li.groupBy(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("n")).filter("n > 1")


@query("ever_members", sql("SELECT i.code, i.block FROM instruments i WHERE i.code IN (SELECT code FROM members)"))
def ever_members(spark, sf_dir):
    return P.instruments(spark, sf_dir).select("code", "block").join(eligible(spark, sf_dir), "code", "left_semi")


@query("never_members", sql("SELECT bar, code FROM cells c WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.bar = c.bar AND m.code = c.code)"))
def never_members(spark, sf_dir):
    """Bars at which a code trades and is no member."""
    return P.cells(spark, sf_dir).select("bar", "code").join(eligible(spark, sf_dir), ["bar", "code"], "left_anti")


@query("common_codes", sql("SELECT code FROM cells WHERE bar <= DATE '1998-12-31' INTERSECT SELECT code FROM cells WHERE bar > DATE '1998-12-31'", base="cells"))
def common_codes(spark, sf_dir):
    c = P.cells(spark, sf_dir).select("bar", "code")
    return c.filter("bar <= '1998-12-31'").select("code").intersect(c.filter("bar > '1998-12-31'").select("code"))


@query("bars_union", sql("SELECT bar FROM members UNION SELECT bar FROM cells JOIN windows ON bar BETWEEN lo AND hi WHERE win = 'is'"))
def bars_union(spark, sf_dir):
    """Bars with members, and bars of the first window with trades."""
    traded = P.in_windows(P.cells(spark, sf_dir)).filter(F.col("window") == "is").select("bar")
    return eligible(spark, sf_dir).select("bar").union(traded).distinct()


@query("bars_except", sql("SELECT bar FROM grid EXCEPT SELECT bar FROM members"))
def bars_except(spark, sf_dir):
    """Bars of the grid at which nothing is a member."""
    return P.grid(P.cells(spark, sf_dir)).select("bar").distinct().join(eligible(spark, sf_dir).select("bar"), "bar", "left_anti")


# --- universe --------------------------------------------------------------------------------------------------------

ADV = ("adv", "SELECT *, CASE WHEN count(amount) OVER w >= 10 THEN quantile_cont(amount, 0.5) OVER w END AS adv FROM daily WINDOW w AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING)")
ENTER, STAY = 4_000_000.0, 3_300_000.0
FLOOR = ("floors", f"SELECT *, coalesce(last_value(CASE WHEN adv >= {ENTER} THEN TRUE WHEN adv IS NULL OR adv < {STAY} THEN FALSE END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS floor_ok FROM adv")
PCTL = (
    "pctl",
    """SELECT f.*, coalesce(last_value(CASE WHEN floor_ok AND (coalesce(pool, 0) < 5 OR adv >= c20) THEN TRUE WHEN NOT floor_ok OR adv IS NULL OR (coalesce(pool, 0) >= 5 AND adv < c15) THEN FALSE END IGNORE NULLS)
       OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS pctl_ok
       FROM floors f LEFT JOIN (SELECT date, quantile_cont(adv, 0.2) AS c20, quantile_cont(adv, 0.15) AS c15, count(*) AS pool FROM floors WHERE floor_ok AND adv IS NOT NULL GROUP BY date) USING (date)""",
)


def adv_daily(spark, sf_dir):
    return universe.trailing_median(P.daily(spark, sf_dir), least=10)


def floors(spark, sf_dir):
    return universe.hysteresis_floor(adv_daily(spark, sf_dir), "adv", ENTER, STAY)


def gated(spark, sf_dir):
    return universe.percentile_gate(floors(spark, sf_dir))


@query("rolling_median_adv", sql("SELECT date, code, adv FROM adv", ADV, base="daily"), exact=("adv",))
def rolling_median_adv(spark, sf_dir):
    return adv_daily(spark, sf_dir).select("date", "code", "adv")


@query("rolling_mean_adv", sql("SELECT date, code, CASE WHEN count(amount) OVER w >= 21 THEN avg(amount) OVER w END AS adv FROM daily WINDOW w AS (PARTITION BY code ORDER BY date ROWS 62 PRECEDING)", base="daily"), exact=("adv",))
def rolling_mean_adv(spark, sf_dir):
    return universe.trailing_mean(P.daily(spark, sf_dir)).select("date", "code", "adv")


@query("hysteresis_floor", sql("SELECT date, code, floor_ok FROM floors", ADV, FLOOR, base="daily"))
def hysteresis_floor(spark, sf_dir):
    return floors(spark, sf_dir).select("date", "code", "floor_ok")


@query("percentile_gate", sql("SELECT date, code, floor_ok, pctl_ok FROM pctl", ADV, FLOOR, PCTL, base="daily"))
def percentile_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("date", "code", "floor_ok", "pctl_ok")


LISTED = ("listed", "SELECT code, min(date) AS list_date, CASE WHEN code % 5 = 0 THEN DATE '2000-06-30' END AS delist_date FROM daily GROUP BY code")


def catalogue(spark, sf_dir):
    """Listed at the first trade; every fifth code is delisted in mid 2000."""
    return P.daily(spark, sf_dir).groupBy("code").agg(F.min("date").alias("list_date")).withColumn("delist_date", F.when(F.col("code") % 5 == 0, F.to_date(F.lit("2000-06-30"))))


@query("seasoning_interval_join", sql("SELECT bar, c.code FROM cells c JOIN listed l ON c.code = l.code AND bar >= list_date + 182 AND (delist_date IS NULL OR bar < delist_date)", LISTED, base="cells"))
def seasoning_interval_join(spark, sf_dir):
    return universe.seasoned(P.cells(spark, sf_dir).select("bar", "code"), catalogue(spark, sf_dir))


MEMBERSHIP = [
    ("wk0", "SELECT g.bar, g.code, coalesce(d.floor_ok, FALSE) AS floor_ok, coalesce(d.pctl_ok, FALSE) AS pctl_ok FROM grid g ASOF LEFT JOIN pctl d ON g.code = d.code AND g.bar >= d.date"),
    ("wk1", "SELECT bar, w.code, bar >= list_date + 182 AND (delist_date IS NULL OR bar < delist_date) AS season, coalesce(lag(floor_ok) OVER p, FALSE) AS floor_ok, coalesce(lag(pctl_ok) OVER p, FALSE) AS pctl_ok FROM wk0 w JOIN listed USING (code) WINDOW p AS (PARTITION BY w.code ORDER BY bar)"),
    ("mship", "SELECT *, season AND floor_ok AND pctl_ok AS member FROM wk1"),
]


def in_season(at):
    return (F.col(at) >= F.date_add("list_date", 182)) & (F.col("delist_date").isNull() | (F.col(at) < F.col("delist_date")))


def membership(spark, sf_dir):
    """Daily state as of Friday, in force from the next bar, seasoning as it is on the bar itself."""
    g = gated(spark, sf_dir).select("code", "date", F.struct("floor_ok", "pctl_ok").alias("state"))
    wk = universe.as_of(P.grid(P.cells(spark, sf_dir)), g, "state").select("bar", "code", F.coalesce("state.floor_ok", F.lit(False)).alias("f"), F.coalesce("state.pctl_ok", F.lit(False)).alias("p"))
    wk = wk.withColumn("floor_ok", universe.next_bar(wk, "f")).withColumn("pctl_ok", universe.next_bar(wk, "p")).join(catalogue(spark, sf_dir), "code")
    return wk.withColumn("season", in_season("bar")).withColumn("member", F.col("season") & F.col("floor_ok") & F.col("pctl_ok")).select("bar", "code", "season", "floor_ok", "pctl_ok", "member")


_MS = [ADV, FLOOR, PCTL, LISTED, *MEMBERSHIP]


@query("membership", sql("SELECT bar, code FROM mship WHERE member", *_MS, base="grid"))
def membership_rows(spark, sf_dir):
    return membership(spark, sf_dir).filter("member").select("bar", "code")


@query("membership_events", sql("SELECT bar, code, event FROM (SELECT bar, code, CASE WHEN member AND NOT was THEN 'enter' WHEN was AND NOT member THEN CASE WHEN NOT season THEN 'exit_delist' WHEN NOT floor_ok THEN 'exit_floor' WHEN NOT pctl_ok THEN 'exit_pctl' ELSE 'repr_switch' END END AS event FROM (SELECT *, coalesce(lag(member) OVER (PARTITION BY code ORDER BY bar), FALSE) AS was FROM mship)) WHERE event IS NOT NULL", *_MS, base="grid"))
def membership_events(spark, sf_dir):
    return universe.events(membership(spark, sf_dir))


@query("churn_by_year", sql("SELECT year(bar) AS year, count(*) FILTER (event = 'enter') AS enter, count(*) FILTER (event = 'exit_delist') AS exit_delist, count(*) FILTER (event = 'exit_floor') AS exit_floor, count(*) FILTER (event = 'exit_pctl') AS exit_pctl FROM (SELECT bar, CASE WHEN member AND NOT was THEN 'enter' WHEN was AND NOT member THEN CASE WHEN NOT season THEN 'exit_delist' WHEN NOT floor_ok THEN 'exit_floor' ELSE 'exit_pctl' END END AS event FROM (SELECT *, coalesce(lag(member) OVER (PARTITION BY code ORDER BY bar), FALSE) AS was FROM mship)) WHERE event IS NOT NULL GROUP BY 1", *_MS, base="grid"))
def churn_by_year(spark, sf_dir):
    kinds = ["enter", "exit_delist", "exit_floor", "exit_pctl"]
    p = universe.events(membership(spark, sf_dir)).groupBy(F.year("bar").alias("year")).pivot("event", kinds).count()
    return p.na.fill(0, kinds)


@query("block_census", sql("SELECT block, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.9), 6) AS p90, avg(n) < 5 AS thin FROM (SELECT b.bar, k.block, count(m.code) AS n FROM (SELECT DISTINCT bar FROM members) b CROSS JOIN (SELECT DISTINCT block FROM instruments) k LEFT JOIN members m ON b.bar = m.bar AND k.block = m.block GROUP BY ALL) GROUP BY block"))
def block_census(spark, sf_dir):
    m = eligible(spark, sf_dir)
    every = m.select("bar").distinct().crossJoin(F.broadcast(P.instruments(spark, sf_dir).select("block").distinct()))
    n = every.join(m.groupBy("bar", "block").agg(F.count("*").alias("n")), ["bar", "block"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.groupBy("block").agg(F.avg("n").alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.percentile("n", F.lit(0.1)).alias("p10"), F.percentile("n", F.lit(0.9)).alias("p90"), (F.avg("n") < 5).alias("thin"))


@query("crosstab_cube", sql("SELECT block, ever, count(*) AS n FROM (SELECT block, i.code IN (SELECT code FROM members) AS ever FROM instruments i) GROUP BY CUBE (block, ever)"))
def crosstab_cube(spark, sf_dir):
    i = P.instruments(spark, sf_dir)
    e = i.join(eligible(spark, sf_dir).select("code").distinct().withColumn("e", F.lit(True)), "code", "left").withColumn("ever", F.coalesce("e", F.lit(False)))
    return e.cube("block", "ever").agg(F.count("*").alias("n"))


RULES = [("BRASS$", "large", "metal_l"), ("(STEEL|COPPER|NICKEL|TIN)$", None, "metal"), ("^PROMO", None, "promo"), ("ECONOMY|STANDARD", None, "plain")]


@query("rule_tagger", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS$') AND kind = 'large' THEN 'metal_l' WHEN regexp_matches(p_type, '(STEEL|COPPER|NICKEL|TIN)$') THEN 'metal' WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, 'ECONOMY|STANDARD') THEN 'plain' ELSE 'UNTAGGED' END AS tag FROM (SELECT *, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part)")
def rule_tagger(spark, sf_dir):
    p = P.read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").withColumn("kind", F.when(F.col("p_size") > 25, "large").otherwise("small"))
    return universe.tagged(p, "p_type", "kind", RULES).select("p_partkey", "tag")


@query("adv_by_year", sql("SELECT year(date) AS year, count(*) AS n, avg(adv) AS mean_adv FROM (SELECT *, row_number() OVER (PARTITION BY code, year(date) ORDER BY date DESC) AS k FROM adv WHERE adv IS NOT NULL) WHERE k = 1 GROUP BY 1", ADV, base="daily"), exact=("mean_adv",))
def adv_by_year(spark, sf_dir):
    last = adv_daily(spark, sf_dir).filter("adv is not null").groupBy("code", F.year("date").alias("year")).agg(F.max_by("adv", "date").alias("adv"))
    return last.groupBy("year").agg(F.count("*").alias("n"), F.avg("adv").alias("mean_adv"))


@query("index_representative")
def index_representative(spark, sf_dir):
    p = P.panel(spark, sf_dir).filter("member").select("bar", "idx", "code", F.col("amt").alias("adv"))
    return universe.representatives(p)


def indexed_membership(spark, sf_dir):
    """Membership with one name for each index: chosen on each trading day among names that pass, in force from the next bar.

    A name's state on a day it didn't trade is its last one. Trading days are numbered over one row a day.
    """
    days = P.daily(spark, sf_dir).select("date").distinct()
    names = catalogue(spark, sf_dir)
    numbered = days.withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    # a row for each trading day is short; names meet those since they were listed
    dense = names.join(F.broadcast(numbered), F.col("date") >= F.col("list_date"))
    g = gated(spark, sf_dir).select("code", "date", F.struct("floor_ok", "pctl_ok", "adv").alias("state"))
    state = universe.as_of(dense, g, "state", at="date").withColumn("season", in_season("date")).select("code", "date", "day", "season", F.coalesce("state.floor_ok", F.lit(False)).alias("f"), F.coalesce("state.pctl_ok", F.lit(False)).alias("p"), "state.adv")
    passing = state.filter("season and f and p and adv is not null").join(P.instruments(spark, sf_dir).select("code", "idx"), "code")
    chosen = universe.representatives(passing, order="day", step=1).select("code", "day", F.lit(True).alias("rep"))
    daily = state.join(chosen, ["code", "day"], "left").select("code", "date", F.struct("f", "p", F.coalesce("rep", F.lit(False)).alias("rep")).alias("state"))
    wk = universe.as_of(P.grid(P.cells(spark, sf_dir)), daily, "state").select("bar", "code", *[F.coalesce(f"state.{c}", F.lit(False)).alias(c) for c in ("f", "p", "rep")])
    for flag, name in (("f", "floor_ok"), ("p", "pctl_ok"), ("rep", "chosen")):
        wk = wk.withColumn(name, universe.next_bar(wk, flag))
    wk = wk.join(names, "code").withColumn("season", in_season("bar"))
    return wk.select("bar", "code", "season", "floor_ok", "pctl_ok", (F.col("season") & F.col("chosen")).alias("member"))


@query("membership_one_per_index")
def membership_one_per_index(spark, sf_dir):
    return indexed_membership(spark, sf_dir).filter("member").select("bar", "code")


@query("index_membership_events")
def index_membership_events(spark, sf_dir):
    return universe.events(indexed_membership(spark, sf_dir))


# --- signals ---------------------------------------------------------------------------------------------------------

IC = [
    ("bth", "SELECT * FROM factors WHERE value IS NOT NULL AND fwd IS NOT NULL"),
    ("rk", f"SELECT *, {ranks('value', 'factor, bar')} AS a, {ranks('fwd', 'factor, bar')} AS b FROM bth"),
    ("ics", f"SELECT factor, bar, {pearson('a', 'b', 5)} AS ic, count(*) AS n FROM rk GROUP BY factor, bar"),
]


def factors(spark, sf_dir):
    return P.long_factors(P.panel(spark, sf_dir))


def ics(spark, sf_dir):
    return ic.rank_ic(factors(spark, sf_dir))


@query("per_bar_ic", sql("SELECT factor, bar, round(ic, 6) + 0.0 AS ic, n FROM ics", *IC, base="factors"))
def per_bar_ic(spark, sf_dir):
    return ics(spark, sf_dir)


SUMMARY = ("summ", "SELECT factor, count(ic) AS n_bars, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t, avg(CASE WHEN ic IS NOT NULL THEN (ic > 0)::INT END) AS pct_pos, avg(CASE WHEN n > 1 THEN ic * sqrt(n - 1.0) END) * sqrt(count(CASE WHEN n > 1 THEN ic END)) AS z, sum(ic * (n - 1)) / nullif(sum(CASE WHEN ic IS NOT NULL THEN n - 1 END), 0) AS ic_w, min(roll) AS roll_min, max(roll) AS roll_max FROM (SELECT *, CASE WHEN count(ic) OVER w >= 39 THEN avg(ic) OVER w END AS roll FROM ics WINDOW w AS (PARTITION BY factor ORDER BY bar ROWS 51 PRECEDING)) GROUP BY factor")


@query("ic_summary", sql("SELECT factor, n_bars, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("mean", "std", "t", "pct_pos", "z", "ic_w", "roll_min", "roll_max")) + " FROM summ", *IC, SUMMARY, base="factors"))
def ic_summary(spark, sf_dir):
    return ic.ic_summary(ics(spark, sf_dir), ["factor"])


@query("screen_gate", sql("SELECT factor, CASE WHEN z >= 0 THEN 1 ELSE -1 END AS polarity, abs(z) >= 0.5 AND n_bars >= 100 AS passes FROM summ", *IC, SUMMARY, base="factors"))
def screen_gate(spark, sf_dir):
    s = ic.ic_summary(ics(spark, sf_dir), ["factor"])
    return s.select("factor", F.when(F.col("z") >= 0, 1).otherwise(-1).alias("polarity"), ((F.abs("z") >= 0.5) & (F.col("n_bars") >= 100)).alias("passes"))


@query("ic_by_window", sql("SELECT factor, win AS \"window\", round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS n FROM ics JOIN windows ON bar BETWEEN lo AND hi GROUP BY factor, win", *IC, base="factors"))
def ic_by_window(spark, sf_dir):
    return P.in_windows(ics(spark, sf_dir)).groupBy("factor", "window").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))


@query("block_ic_sweep", sql(f"SELECT factor, block, round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS n_bars FROM (SELECT factor, block, bar, {pearson('a', 'b', 5)} AS ic FROM (SELECT *, {ranks('value', 'factor, block, bar')} AS a, {ranks('fwd', 'factor, block, bar')} AS b FROM bth) GROUP BY factor, block, bar) GROUP BY factor, block", IC[0], base="factors"))
def block_ic_sweep(spark, sf_dir):
    return ic.rank_ic(factors(spark, sf_dir), by=["factor", "block", "bar"]).groupBy("factor", "block").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_bars"))


@query("half_split", sql("SELECT factor, round(z, 6) + 0.0 AS z, round(z1, 6) + 0.0 AS z1, round(z2, 6) + 0.0 AS z2, sign(z1) = sign(z) AND sign(z2) = sign(z) AND abs(z1) >= 1.5 AND abs(z2) >= 1.5 AS passes FROM (SELECT factor, avg(x) * sqrt(count(x)) AS z, avg(x) FILTER (h = 1) * sqrt(count(x) FILTER (h = 1)) AS z1, avg(x) FILTER (h = 2) * sqrt(count(x) FILTER (h = 2)) AS z2 FROM (SELECT factor, ic * sqrt(n - 1.0) AS x, CASE WHEN row_number() OVER (PARTITION BY factor ORDER BY bar) <= (count(*) OVER (PARTITION BY factor)) // 2 THEN 1 ELSE 2 END AS h FROM ics WHERE ic IS NOT NULL) GROUP BY factor)", *IC, base="factors"))
def half_split(spark, sf_dir):
    return ic.half_split(ics(spark, sf_dir), ["factor"])


@query("precision_at_q", sql("SELECT factor, bar, n, k, round(sum((ra <= k AND rb <= k)::INT) / k, 6) AS precision FROM (SELECT factor, bar, count(*) OVER (PARTITION BY factor, bar) AS n, ceil(0.2::DOUBLE * (count(*) OVER (PARTITION BY factor, bar)))::BIGINT AS k, row_number() OVER (PARTITION BY factor, bar ORDER BY value DESC, code) AS ra, row_number() OVER (PARTITION BY factor, bar ORDER BY fwd DESC, code) AS rb FROM bth) WHERE n >= 3 GROUP BY factor, bar, n, k", IC[0], base="factors"))
def precision_at_q(spark, sf_dir):
    return ic.precision_at(factors(spark, sf_dir), q=0.2)


@query("precision_at_k", sql("SELECT factor, bar, n, 5::BIGINT AS k, round(sum((ra <= 5 AND rb <= 5)::INT) / 5, 6) AS precision FROM (SELECT factor, bar, count(*) OVER (PARTITION BY factor, bar) AS n, row_number() OVER (PARTITION BY factor, bar ORDER BY value, code) AS ra, row_number() OVER (PARTITION BY factor, bar ORDER BY fwd, code) AS rb FROM bth) WHERE n >= 10 GROUP BY factor, bar, n", IC[0], base="factors"))
def precision_at_k(spark, sf_dir):
    return ic.precision_at(factors(spark, sf_dir), k=5, top=False)


TRIPLE = ("tri", "SELECT *, avg(a) OVER w AS am, avg(b) OVER w AS bm, count(*) OVER w AS size FROM rk WINDOW w AS (PARTITION BY factor, bar, block)")


@query("block_neutral_ic", sql(f"SELECT factor, bar, round({pearson('a', 'b', 5)}, 6) + 0.0 AS raw, round({pearson('ia', 'ib', 5)}, 6) + 0.0 AS within, round(CASE WHEN count(DISTINCT block) >= 2 THEN {pearson('am', 'bm')} END, 6) + 0.0 AS \"between\", count(*) AS n FROM (SELECT *, CASE WHEN size >= 2 THEN a - am END AS ia, CASE WHEN size >= 2 THEN b - bm END AS ib FROM tri) GROUP BY factor, bar", *IC[:2], TRIPLE, base="factors"))
def block_neutral_ic(spark, sf_dir):
    return ic.ic_triple(factors(spark, sf_dir))


EZ = ("ez", "SELECT *, CASE WHEN count(value) OVER w >= 26 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z FROM factors WINDOW w AS (PARTITION BY factor, code ORDER BY bar ROWS UNBOUNDED PRECEDING)")


@query("expanding_z", sql("SELECT factor, bar, code, round(z, 4) + 0.0 AS z FROM ez WHERE factor <> 'amt'", EZ, base="factors"))
def expanding_z(spark, sf_dir):
    return ic.expanding_z(factors(spark, sf_dir).filter("factor <> 'amt'")).select("factor", "bar", "code", F.round("z", 4).alias("z") + F.lit(0.0)).toDF("factor", "bar", "code", "z")


@query("avg_rank", sql(f"SELECT factor, bar, code, {ranks('value', 'factor, bar')} AS rk FROM factors", base="factors"))
def avg_rank(spark, sf_dir):
    return average_rank(factors(spark, sf_dir), "value", ["factor", "bar"], "rk").select("factor", "bar", "code", "rk")


@query("gaussian_rank", sql(f"SELECT bar, code, round(u, 6) AS g_u, round({probit_sql('u')}, 6) + 0.0 AS g FROM (SELECT bar, code, CASE WHEN count(alpha) OVER (PARTITION BY bar) >= 3 THEN ({ranks('alpha', 'bar')} - 0.5) / count(alpha) OVER (PARTITION BY bar) END AS u FROM mem)", MEMBERS))
def gaussian_rank(spark, sf_dir):
    return ic.gaussian_rank(eligible(spark, sf_dir), "alpha", ["bar"]).select("bar", "code", "g_u", "g")


@query("risk_adjusted_label", sql(f"SELECT bar, code, round({probit_sql('u')}, 6) + 0.0 AS label FROM (SELECT bar, code, CASE WHEN count(x) OVER (PARTITION BY bar) >= 3 THEN ({ranks('x', 'bar')} - 0.5) / count(x) OVER (PARTITION BY bar) END AS u FROM (SELECT *, fwd / sigma AS x FROM mem))", MEMBERS))
def risk_adjusted_label(spark, sf_dir):
    return ic.gaussian_rank(eligible(spark, sf_dir).withColumn("x", div("fwd", "sigma")), "x", ["bar"], name="label").select("bar", "code", "label")


@query("factor_corr_pairs", sql(f"SELECT a.factor AS f1, b.factor AS f2, round(coalesce({pearson('a.value', 'b.value', 100)}, 0.0), 6) + 0.0 AS rho, count(*) AS n FROM factors a JOIN factors b ON a.bar = b.bar AND a.code = b.code AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2", base="factors"))
def factor_corr_pairs(spark, sf_dir):
    return ic.correlations(factors(spark, sf_dir))


@query("correlation_distance", sql(f"SELECT a.factor AS f1, b.factor AS f2, round(sqrt(greatest(0.0, 2 * (1 - coalesce({pearson('a.value', 'b.value', 100)}, 0.0)))), 6) AS distance FROM factors a JOIN factors b ON a.bar = b.bar AND a.code = b.code AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2", base="factors"))
def correlation_distance(spark, sf_dir):
    return ic.correlations(factors(spark, sf_dir)).select("f1", "f2", corr_distance("rho").alias("distance"))


def walk_sql(threshold: float) -> list[tuple[str, str]]:
    """Steps from (block, factor, z) in `strength` and (block, f1, f2, rho) in `rhos` to what stands for what."""
    return [
        ("ord", "SELECT block, factor, row_number() OVER (PARTITION BY block ORDER BY round(abs(coalesce(z, 0.0)), 9) DESC, factor) AS i FROM strength"),
        ("near", f"SELECT block, list(f1 || '|' || f2) FILTER (abs(rho) > {threshold}) AS m FROM rhos GROUP BY block"),
        ("walk", """WITH RECURSIVE w AS (SELECT DISTINCT block, 0::BIGINT AS i, []::VARCHAR[] AS kept, NULL::VARCHAR AS factor, NULL::VARCHAR AS stands_for FROM ord UNION ALL
           SELECT block, i, CASE WHEN clash IS NULL THEN list_append(kept, factor) ELSE kept END, factor, coalesce(clash, factor)
           FROM (SELECT w.block, w.kept, o.i, o.factor, list_filter(w.kept, lambda g: list_contains(coalesce(m, []::VARCHAR[]), least(g, o.factor) || '|' || greatest(g, o.factor)))[1] AS clash
           FROM w JOIN ord o ON o.block = w.block AND o.i = w.i + 1 LEFT JOIN near n ON n.block = w.block)) SELECT block, factor, stands_for, factor = stands_for AS kept FROM w WHERE factor IS NOT NULL"""),
    ]


_RHO = pearson("a.value", "b.value", 100)
GREEDY = [*IC, SUMMARY, ("strength", "SELECT 0 AS block, factor, z FROM summ"), ("rhos", f"SELECT 0 AS block, a.factor AS f1, b.factor AS f2, coalesce({_RHO}, 0.0) AS rho FROM factors a JOIN factors b ON a.bar = b.bar AND a.code = b.code AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 2, 3")]


def by_strength(summary: DataFrame, by: list[str]) -> DataFrame:
    """(by, factor, pos): from the strongest z down."""
    strong = F.round(F.abs(F.coalesce("z", F.lit(0.0))), 9)
    return summary.select(*by, "factor", F.row_number().over(Window.partitionBy(*by).orderBy(strong.desc(), "factor")).alias("pos"))


def deduped(spark, sf_dir, threshold):
    s = ic.ic_summary(ics(spark, sf_dir), ["factor"]).withColumn("one", F.lit(0))
    return ic.dedup(by_strength(s, ["one"]), ic.correlations(factors(spark, sf_dir)).withColumn("one", F.lit(0)), threshold, ["one"]).drop("one")


@query("greedy_dedup", sql("SELECT factor, stands_for, kept FROM walk", *GREEDY, *walk_sql(0.5), base="factors"))
def greedy_dedup(spark, sf_dir):
    return deduped(spark, sf_dir, 0.5)


@query("bond_style_dedup", sql("SELECT stands_for AS factor, count(*) - 1 AS n_dropped, max(CASE WHEN NOT kept THEN factor END) AS last_dropped FROM walk GROUP BY stands_for", *GREEDY, *walk_sql(0.3), base="factors"))
def bond_style_dedup(spark, sf_dir):
    """Each kept factor drops all weaker ones that go with it: how many."""
    d = deduped(spark, sf_dir, 0.3)
    return d.groupBy(F.col("stands_for").alias("factor")).agg((F.count("*") - 1).alias("n_dropped"), F.max(F.when(~F.col("kept"), F.col("factor"))).alias("last_dropped"))


_LEAST = "(SELECT least(100, greatest(30, floor(0.4 * count(DISTINCT bar)))) FROM isf)"
BLOCK_DEDUP = [
    ("isf", "SELECT * FROM factors WHERE bar <= DATE '1998-12-31'"),
    ("bbth", "SELECT * FROM isf WHERE value IS NOT NULL AND fwd IS NOT NULL"),
    ("brk", f"SELECT *, {ranks('value', 'factor, block, bar')} AS a, {ranks('fwd', 'factor, block, bar')} AS b FROM bbth"),
    ("strength", f"SELECT block, factor, avg(CASE WHEN n > 1 THEN ic * sqrt(n - 1.0) END) * sqrt(count(CASE WHEN n > 1 THEN ic END)) AS z FROM (SELECT factor, block, bar, {pearson('a', 'b', 5)} AS ic, count(*) AS n FROM brk GROUP BY factor, block, bar) GROUP BY block, factor"),
    ("rhos", f"SELECT block, f1, f2, CASE WHEN n >= {_LEAST} THEN coalesce(rho, 0.0) ELSE 0.0 END AS rho FROM (SELECT a.block, a.factor AS f1, b.factor AS f2, {pearson('a.value', 'b.value')} AS rho, count(*) AS n FROM isf a JOIN isf b ON a.bar = b.bar AND a.code = b.code AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3)"),
    *walk_sql(0.5),
]


@query("block_dedup", sql("SELECT block, factor, stands_for, kept FROM walk", *BLOCK_DEDUP, base="factors"))
def block_dedup(spark, sf_dir):
    """Each block's factors in sample, ranked by their IC within the block; a pair needs cells: 0.4 of the bars, from 30 to 100."""
    return _block_dedup(spark, sf_dir, block_strength(spark, sf_dir))


def block_strength(spark, sf_dir):
    """Summaries of each block's factors' IC in sample."""
    f = P.long_factors_by(P.panel(spark, sf_dir).filter(F.col("bar") <= P.IS_END), "block", "bar")
    return ic.ic_summary(ic.rank_ic(f, by=["factor", "block", "bar"]), ["block", "factor"])


def _block_dedup(spark, sf_dir, s):
    f = factors(spark, sf_dir).filter(F.col("bar") <= P.IS_END)
    least = f.agg(F.least(F.lit(100), F.greatest(F.lit(30), F.floor(0.4 * F.count_distinct("bar")))).alias("least"))
    rho = ic.correlations(f, 2, by=["block"]).crossJoin(F.broadcast(least)).withColumn("rho", F.when(F.col("n") >= F.col("least"), F.col("rho")).otherwise(0.0))
    return ic.dedup(by_strength(s, ["block"]), rho, 0.5, ["block"])


ENSEMBLE = [
    ("zs", "SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM factors WINDOW w AS (PARTITION BY factor, bar)"),
    ("ens", "SELECT bar, code, avg(z * sign) AS alpha FROM zs JOIN (VALUES ('rev1', 1.0::DOUBLE), ('mom13', -1.0::DOUBLE), ('lowvol', 1.0::DOUBLE)) t(factor, sign) USING (factor) GROUP BY bar, code"),
]


def ensemble_alpha(spark, sf_dir):
    signs = spark.createDataFrame([("rev1", 1.0), ("mom13", -1.0), ("lowvol", 1.0)], "factor string, sign double")
    return ic.ensemble(factors(spark, sf_dir).filter(F.col("factor").isin("rev1", "mom13", "lowvol")), signs)


@query("rowz_ensemble", sql("SELECT bar, code, round(alpha, 6) + 0.0 AS alpha FROM ens", *ENSEMBLE, base="factors"))
def rowz_ensemble(spark, sf_dir):
    return ensemble_alpha(spark, sf_dir)


@query("rank_blend", sql(f"SELECT bar, code, round(avg(v), 6) AS alpha FROM (SELECT bar, code, 0.5 * {ranks('alpha', 'bar')} / count(*) OVER (PARTITION BY bar) AS v FROM ens WHERE alpha IS NOT NULL UNION ALL SELECT bar, code, 0.5 * {ranks('alpha', 'bar')} / count(*) OVER (PARTITION BY bar) FROM mem) GROUP BY bar, code", *ENSEMBLE, MEMBERS, base="factors"))
def rank_blend(spark, sf_dir):
    return ic.rank_blend(ensemble_alpha(spark, sf_dir), eligible(spark, sf_dir))


# --- books -----------------------------------------------------------------------------------------------------------

RK = ("rkd", "SELECT *, row_number() OVER (PARTITION BY bar ORDER BY alpha DESC, code) AS rk, count(*) OVER (PARTITION BY bar) AS n, greatest(1, ceil(0.2::DOUBLE * (count(*) OVER (PARTITION BY bar)))::BIGINT) AS k FROM mem")
LONG = ("book", "SELECT bar, code, block, alpha, sigma, 1 AS side, (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY bar) AS w, n, k FROM rkd WHERE rk <= k")
LS = ("ls", "SELECT bar, code, side, side * 0.5 * (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY bar, side) AS w, n, k2 AS k FROM (SELECT *, CASE WHEN rk <= k2 THEN 1 WHEN rk > n - k2 THEN -1 END AS side FROM (SELECT *, least(k, n // 2) AS k2 FROM rkd)) WHERE side IS NOT NULL")
CAL = ("calx", "SELECT bar, lag(bar) OVER (ORDER BY bar) AS prior, row_number() OVER (ORDER BY bar) AS seq FROM (SELECT DISTINCT bar FROM panel)")
MOVED = ("moved", "SELECT c.bar, x.code, sum(x.w) AS w, sum(x.prev) AS prev, any_value(c.seq) AS seq FROM (SELECT bar, code, w, 0.0 AS prev FROM book UNION ALL SELECT c.bar, code, 0.0, w FROM book b JOIN calx c ON b.bar = c.prior) x JOIN calx c ON x.bar = c.bar GROUP BY c.bar, x.code")
NET = ("net", "SELECT c.bar, coalesce(gross, 0.0) AS gross, coalesce(turnover, 0.0) AS turnover, coalesce(gross, 0.0) - 0.001::DOUBLE * coalesce(turnover, 0.0) AS net, coalesce(n_held, 0) AS n_held FROM calx c LEFT JOIN (SELECT m.bar, sum(w * coalesce(fwd, 0.0)) AS gross, sum(CASE WHEN seq = 1 THEN 0.0 ELSE abs(w - prev) END) AS turnover, sum((w <> 0)::INT) AS n_held FROM moved m LEFT JOIN panel p ON m.bar = p.bar AND m.code = p.code GROUP BY m.bar) USING (bar)")
BOOK = [MEMBERS, RK, LONG, CAL, MOVED, NET]


def long_book(spark, sf_dir, **kw):
    return book.static_weights(eligible(spark, sf_dir), **kw)


def net(spark, sf_dir, **kw):
    return book.run_book(long_book(spark, sf_dir, **kw), P.panel(spark, sf_dir))


@query("weekly_portfolio", sql("SELECT bar, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(net, 6) + 0.0 AS net, n_held::BIGINT AS n_held FROM net", *BOOK))
def weekly_portfolio(spark, sf_dir):
    """The flagship: a reversal book of the best fifth by inverse volatility, with costs."""
    return net(spark, sf_dir)


@query("static_long", sql("SELECT bar, code, side, round(w, 6) AS w, n, k FROM book", MEMBERS, RK, LONG))
def static_long(spark, sf_dir):
    return long_book(spark, sf_dir)


@query("static_ls", sql("SELECT bar, code, side, round(w, 6) AS w, n, k FROM ls", MEMBERS, RK, LS))
def static_ls(spark, sf_dir):
    return long_book(spark, sf_dir, long_short=True)


for _name, _raw in {"eqw": "1.0::DOUBLE", "inv_sqrt_vol": "1 / sqrt(sigma)", "rank_prop": "k - rk + 1", "alpha_prop": "alpha - min(alpha) OVER (PARTITION BY bar) + greatest((max(alpha) OVER (PARTITION BY bar) - min(alpha) OVER (PARTITION BY bar)) / k, 1e-12)"}.items():
    query(f"sizing_{_name}", sql(f"SELECT bar, code, round(raw / sum(raw) OVER (PARTITION BY bar), 6) AS w FROM (SELECT bar, code, {_raw} AS raw FROM rkd WHERE rk <= k)", MEMBERS, RK))(lambda spark, sf_dir, s=_name: long_book(spark, sf_dir, sizing=s).select("bar", "code", "w"))

PCT = ("pct", "SELECT bar, code, alpha, CASE WHEN len(h) = 26 AND sigma IS NOT NULL THEN len(list_filter(h, lambda x: x <= sigma)) / 26.0 END AS pctl, sigma, member, rev4, row_number() OVER () AS z FROM (SELECT bar, code, rev4 AS alpha, rev4, member, sigma, list(sigma) FILTER (sigma IS NOT NULL) OVER (PARTITION BY code ORDER BY bar ROWS 25 PRECEDING) AS h FROM panel)")


@query("sigma_percentile", sql("SELECT bar, code, round(pctl, 6) AS pctl FROM pct", PCT))
def sigma_percentile(spark, sf_dir):
    return P.panel(spark, sf_dir).select("bar", "code", book.trailing_percentile("sigma").alias("pctl"))


@query("sizing_inv_vol_pctl", sql("SELECT bar, code, round(raw / sum(raw) OVER (PARTITION BY bar), 6) AS w FROM (SELECT bar, code, (1 / sigma) * exp(ln(2.0) * (0.5 - coalesce(pctl, 0.5))) AS raw, row_number() OVER (PARTITION BY bar ORDER BY alpha DESC, code) AS rk, greatest(1, ceil(0.2::DOUBLE * (count(*) OVER (PARTITION BY bar)))::BIGINT) AS k FROM pct WHERE member AND rev4 IS NOT NULL) WHERE rk <= k", PCT))
def sizing_inv_vol_pctl(spark, sf_dir):
    p = P.panel(spark, sf_dir).withColumn("pctl", book.trailing_percentile("sigma"))
    return book.static_weights(P.members(p).withColumn("alpha", F.col("rev4")), sizing="inv_vol_pctl").select("bar", "code", "w")


@query("turnover_decomp", sql("SELECT bar, round(sum(CASE WHEN w <> 0 AND prev <> 0 THEN 0.0 ELSE abs(w - prev) END), 6) + 0.0 AS selection, round(sum(CASE WHEN w <> 0 AND prev <> 0 THEN abs(w - prev) ELSE 0.0 END), 6) + 0.0 AS sizing FROM moved GROUP BY bar", *BOOK[:5]))
def turnover_decomp(spark, sf_dir):
    return book.turnover_parts(book.changes(long_book(spark, sf_dir), book.calendar(P.panel(spark, sf_dir)), first="paid"))


@query("concentration", sql("SELECT bar, round(sum(s * s), 6) AS hhi, round(1 / nullif(sum(s * s), 0), 6) AS effective, round(sum(CASE WHEN r <= 1 THEN s END), 6) AS top1, round(sum(CASE WHEN r <= 3 THEN s END), 6) AS top3, round(sum(CASE WHEN r <= 5 THEN s END), 6) AS top5 FROM (SELECT bar, abs(w) / sum(abs(w)) OVER (PARTITION BY bar) AS s, row_number() OVER (PARTITION BY bar ORDER BY abs(w) DESC, code) AS r FROM book) GROUP BY bar", MEMBERS, RK, LONG))
def concentration(spark, sf_dir):
    return book.concentration(long_book(spark, sf_dir))


@query("block_alloc", sql("SELECT block, round(sum(s) / (SELECT count(DISTINCT bar) FROM book), 6) AS share FROM (SELECT bar, block, sum(abs(w)) / sum(sum(abs(w))) OVER (PARTITION BY bar) AS s FROM book GROUP BY bar, block) GROUP BY block", MEMBERS, RK, LONG))
def block_alloc(spark, sf_dir):
    return book.allocation(long_book(spark, sf_dir).join(P.instruments(spark, sf_dir), "code"))


@query("popularity", sql("SELECT side, code, count(*) AS bars, round(count(*) / (SELECT count(DISTINCT bar) FROM ls), 6) AS presence, round(avg(abs(w)), 6) AS mean_w, round(sum(abs(w)) / sum(sum(abs(w))) OVER (PARTITION BY side), 6) AS time_share FROM ls GROUP BY side, code", MEMBERS, RK, LS))
def popularity(spark, sf_dir):
    return book.popularity(long_book(spark, sf_dir, long_short=True))


@query("jaccard", sql("SELECT bar, round(sum((a + b = 2)::INT) / count(*), 6) AS jaccard FROM (SELECT bar, code, max(a) AS a, max(b) AS b FROM (SELECT bar, code, 1 AS a, 0 AS b FROM book UNION ALL SELECT bar, code, 0, 1 FROM rkd WHERE rk <= ceil(0.4::DOUBLE * n)) GROUP BY bar, code) GROUP BY bar", MEMBERS, RK, LONG))
def jaccard(spark, sf_dir):
    return book.jaccard(long_book(spark, sf_dir), long_book(spark, sf_dir, q=0.4))


@query("churn_events", sql("SELECT bar, code, event, CASE WHEN event = 'exit' AND lead(event) OVER o = 'entry' AND date_diff('day', bar, lead(bar) OVER o) / 7 <= 4 THEN (date_diff('day', bar, lead(bar) OVER o) / 7)::INTEGER END AS gap FROM (SELECT bar, code, CASE WHEN prev = 0 AND w <> 0 THEN 'entry' WHEN prev <> 0 AND w = 0 THEN 'exit' END AS event FROM moved) WHERE event IS NOT NULL WINDOW o AS (PARTITION BY code ORDER BY bar)", *BOOK[:5]))
def churn_events(spark, sf_dir):
    return book.churn(long_book(spark, sf_dir), book.calendar(P.panel(spark, sf_dir)))


@query("drawdown_attribution", sql("SELECT p.code, round(sum(b.w * coalesce(p.fwd, 0.0)), 6) + 0.0 AS contribution, count(*) AS bars FROM (SELECT bar AS trough, (SELECT max(bar) FROM dd x WHERE x.bar <= d.bar AND x.nav >= x.peak) AS peak_bar FROM dd d ORDER BY nav - peak, bar LIMIT 1) t JOIN book b ON b.bar > t.peak_bar AND b.bar <= t.trough JOIN panel p ON b.bar = p.bar AND b.code = p.code GROUP BY p.code", *BOOK, ("dd", "SELECT bar, nav, max(nav) OVER (ORDER BY bar) AS peak FROM (SELECT bar, 1 + sum(net) OVER (ORDER BY bar) AS nav FROM net)")))
def drawdown_attribution(spark, sf_dir):
    w, p = long_book(spark, sf_dir), P.panel(spark, sf_dir)
    dd = metrics.with_drawdown(book.run_book(w, p).withColumn("one", F.lit(0)), ["one"], relative=False)
    at_peak = F.last(F.when(F.col("nav") >= F.col("peak"), F.col("bar")), ignorenulls=True).over(rows("one", "bar", None, 0))
    worst = dd.withColumn("peak_bar", at_peak).agg(F.min_by(F.struct("bar", "peak_bar"), F.struct("dd", "bar")).alias("t")).select(F.col("t.bar").alias("trough"), F.col("t.peak_bar").alias("peak_bar"))
    inside = w.join(F.broadcast(worst), (F.col("bar") > F.col("peak_bar")) & (F.col("bar") <= F.col("trough")))
    return inside.join(p.select("bar", "code", "fwd"), ["bar", "code"]).groupBy("code").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("contribution"), F.count("*").alias("bars"))


# --- performance -----------------------------------------------------------------------------------------------------

STATS = "count(net) AS n_bars, round(avg(net) * 52, 6) + 0.0 AS ann_ret, round(stddev_samp(net) * sqrt(52.0), 6) AS ann_vol, round(avg(net) * 52 / nullif(stddev_samp(net) * sqrt(52.0), 0), 6) + 0.0 AS sharpe, round(sum(net), 6) + 0.0 AS cum_ret, round(pow(greatest(1 + sum(net), 1e-9), 1 / greatest(count(net) / 52.0, 1e-3)) - 1, 6) + 0.0 AS cagr, round(min(dd), 6) + 0.0 AS max_dd"


def _stats_sql(by: str, source: str) -> str:
    return f"SELECT {by}, {STATS} FROM (SELECT *, (nav - max(nav) OVER w) / nullif(max(nav) OVER w, 0) AS dd FROM (SELECT *, 1 + sum(net) OVER (PARTITION BY {by} ORDER BY bar) AS nav FROM ({source})) WINDOW w AS (PARTITION BY {by} ORDER BY bar)) GROUP BY {by} HAVING count(*) >= 2"


@query("window_stats", sql(_stats_sql('"window"', 'SELECT bar, net, win AS "window" FROM net JOIN windows ON bar BETWEEN lo AND hi'), *BOOK))
def window_stats(spark, sf_dir):
    return metrics.window_stats(P.in_windows(net(spark, sf_dir)), ["window"]).filter("n_bars >= 2")


@query("per_year", sql(_stats_sql("year", "SELECT bar, net, year(bar) AS year FROM net"), *BOOK))
def per_year(spark, sf_dir):
    return metrics.window_stats(net(spark, sf_dir).withColumn("year", F.year("bar")), ["year"]).filter("n_bars >= 2")


@query("excess_sharpe", sql('SELECT "window", round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 6) + 0.0 AS raw, round(avg(net - 0.0004::DOUBLE) / nullif(stddev_samp(net), 0) * sqrt(52.0), 6) + 0.0 AS excess FROM (SELECT net, win AS "window" FROM net JOIN windows ON bar BETWEEN lo AND hi) GROUP BY "window"', *BOOK))
def excess_sharpe(spark, sf_dir):
    return metrics.excess_sharpe(P.in_windows(net(spark, sf_dir)).withColumn("rf", F.lit(0.0004)), ["window"])


BLOCK_BOOK = [MEMBERS, RK, ("book", "SELECT bar, code, block, alpha, sigma, 1 AS side, (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY bar) AS w, n, k FROM rkd WHERE block = 0"), CAL, MOVED, NET]


def block_net(spark, sf_dir):
    """The series of a book of all of one block by inverse volatility: it has drawdowns, which the flagship hardly has."""
    return book.run_book(book.sized(eligible(spark, sf_dir).filter("block = 0"), "inv_vol", ["bar"]), P.panel(spark, sf_dir))


@query("drawdown_episodes", sql("SELECT min(bar) AS start, arg_min(bar, {'dd': dd, 'bar': bar}) AS trough, max(bar) AS \"end\", round(min(dd), 6) AS depth FROM (SELECT *, sum((dd >= 0)::INT) OVER (ORDER BY bar) AS run FROM (SELECT bar, nav / max(nav) OVER (ORDER BY bar) - 1 AS dd FROM (SELECT bar, 1 + sum(net) OVER (ORDER BY bar) AS nav FROM net))) WHERE dd < 0 GROUP BY run HAVING min(dd) <= -0.001", *BLOCK_BOOK))
def drawdown_episodes(spark, sf_dir):
    return metrics.episodes(block_net(spark, sf_dir), depth=-0.001)


@query("yearly_continuous_dd", sql("SELECT year(bar) AS year, round(min(dd), 6) + 0.0 AS dd, arg_min(bar, {'dd': dd, 'bar': bar}) AS trough, arg_min(peak_bar, {'dd': dd, 'bar': bar}) AS peak_bar FROM (SELECT bar, nav / pk - 1 AS dd, max(CASE WHEN nav >= pk THEN bar END) OVER (ORDER BY bar) AS peak_bar FROM (SELECT bar, nav, max(nav) OVER (ORDER BY bar) AS pk FROM (SELECT bar, 1 + sum(net) OVER (ORDER BY bar) AS nav FROM net))) GROUP BY 1", *BOOK))
def yearly_continuous_dd(spark, sf_dir):
    return metrics.yearly_on_continuous_nav(net(spark, sf_dir)).select("year", "dd", "trough", "peak_bar")


@query("mean_turnover_cost", sql('SELECT win AS "window", round(avg(turnover), 6) AS turnover, round(avg(turnover) * 0.001 * 52 * 10000, 6) AS drag_bp, round(avg(turnover) * 0.001 * 2 * 52 * 10000, 6) AS drag_bp_doubled FROM net JOIN windows ON bar BETWEEN lo AND hi GROUP BY win', *BOOK))
def mean_turnover_cost(spark, sf_dir):
    """Cost drag in basis points a year: as charged, and with the second factor of two that one published table has."""
    t = P.in_windows(net(spark, sf_dir)).groupBy("window").agg(F.avg("turnover").alias("turnover"))
    return t.select("window", "turnover", (F.col("turnover") * 0.001 * 52 * 10000).alias("drag_bp"), (F.col("turnover") * 0.001 * 2 * 52 * 10000).alias("drag_bp_doubled"))


@query("tracking_error", sql(f"SELECT round(stddev_samp(a.net - b.net) * sqrt(52.0), 6) AS te, count(*) AS n FROM net a JOIN net2 b USING (bar)", *BOOK, ("book2", "SELECT bar, code, 1.0 / k AS w FROM rkd WHERE rk <= k"), ("moved2", MOVED[1].replace("FROM book ", "FROM book2 ").replace("FROM book b", "FROM book2 b")), ("net2", NET[1].replace("FROM moved m", "FROM moved2 m"))))
def tracking_error(spark, sf_dir):
    a, b = net(spark, sf_dir).select("bar", "net"), net(spark, sf_dir, sizing="eqw").select("bar", F.col("net").alias("other"))
    return a.join(b, "bar").agg((F.stddev_samp(F.col("net") - F.col("other")) * F.sqrt(F.lit(52.0))).alias("te"), F.count("*").alias("n"))
