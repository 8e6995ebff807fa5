"""Sweeps of books with their costs taken apart, versions of the universe, files by code that are kept current, verdicts; standard scores against outcomes within blocks."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import div, probit_sql
from ..operators import book, files, hysteresis, ic, metrics, universe
from ..plans import panel as P
from ..plans import store
from .books import BSCORE, mixed
from .core import _MS, CAL, EZ, MEMBERS, Q, SQL, SUMMARY, _stats_sql, eligible, factors, membership, query  # noqa: F401
from .models import replace_steps
from .reports import ANCHORED, anchored
from .sql import KMOVED, KNET, pearson, ranks, sql

# --- costs taken apart -----------------------------------------------------------------------------------------------

#: Cell, share, two sides; and the window names of a summary.
CELLS = [("long_q05", 0.05, False), ("long_q10", 0.1, False), ("long_q20", 0.2, False), ("ls_q20", 0.2, True)]
WINDOWS = ("is", "oos", "full")
#: Resizing is worth a look where it is this part of turnover in at least so many cells.
GATE, GATED_CELLS = 0.3, 2

_CELLS = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {q}::DOUBLE, {str(two).upper()})" for c, q, two in CELLS) + ") t(cell, q, two)"
# From kbook(cell, bar, code, w): each cell's series with the parts of its turnover.
KATT = [
    KMOVED,
    (
        "katt",
        """SELECT *, gross - cost AS net, coalesce(abs(n_held - lag(n_held) OVER (PARTITION BY cell ORDER BY bar)), 0) AS d_held FROM (SELECT *, selection + sizing AS turnover, (selection + sizing) * 0.001::DOUBLE AS cost
        FROM (SELECT cc.cell, c.bar, coalesce(gross, 0.0) AS gross, coalesce(sel, 0.0) AS selection, coalesce(siz, 0.0) AS sizing, coalesce(n_held, 0) AS n_held FROM (SELECT DISTINCT cell FROM kbook) cc CROSS JOIN calx c
        LEFT JOIN (SELECT m.cell, m.bar, sum(w * coalesce(fwd, 0.0)) AS gross, sum(CASE WHEN w <> 0 AND prev <> 0 THEN 0.0 ELSE abs(w - prev) END) AS sel, sum(CASE WHEN w <> 0 AND prev <> 0 THEN abs(w - prev) ELSE 0.0 END) AS siz, sum((w <> 0)::INT) AS n_held
        FROM kmoved m LEFT JOIN panel p ON m.bar = p.bar AND m.code = p.code GROUP BY m.cell, m.bar) g ON g.cell = cc.cell AND g.bar = c.bar))""",
    ),
]


def _cost_sql(by: str, source: str) -> str:
    parts = ", ".join(
        f"round(coalesce(avg({s}) / nullif(stddev_samp({s}), 0) * sqrt(52.0), 0.0), 6) + 0.0 AS {s}_sharpe, round(avg({s}) * 52, 6) + 0.0 AS {s}_ann_ret, round(pow(greatest(1 + sum({s}), 1e-9), 1 / greatest(count(*) / 52.0, 1e-3)) - 1, 6) + 0.0 AS {s}_cagr"
        for s in ("gross", "net")
    )
    means = ", ".join(f"round(avg({c}), 6) + 0.0 AS {a}" for a, c in {"turnover": "turnover", "selection": "selection", "sizing": "sizing", "held": "n_held", "held_change": "d_held"}.items())
    return f"SELECT {by}, count(*) AS n_bars, {parts}, round(avg(cost) * 520000, 6) + 0.0 AS cost_bp, {means}, round(coalesce(avg(sizing) / nullif(avg(turnover), 0), 0.0), 6) + 0.0 AS sizing_share, round(CASE WHEN avg(gross) > 0 THEN avg(cost) / avg(gross) END, 6) AS cost_of_gross FROM ({source}) GROUP BY {by} HAVING count(*) >= 2"


_KATT_WINDOWS = f"SELECT katt.*, win AS \"window\" FROM katt JOIN windows ON bar BETWEEN lo AND hi WHERE win IN {WINDOWS}"
ATTRIBUTION = [
    MEMBERS,
    CAL,
    ("cells_", _CELLS),
    ("sides", "SELECT *, CASE WHEN rk <= k THEN 1 WHEN two AND rk > n - k THEN -1 END AS side FROM (SELECT *, CASE WHEN two THEN least(k1, n // 2) ELSE k1 END AS k FROM (SELECT mem.*, cell, two, row_number() OVER (PARTITION BY cell, bar ORDER BY alpha DESC, code) AS rk, count(*) OVER p AS n, greatest(1, ceil(q * (count(*) OVER p))::BIGINT) AS k1 FROM mem CROSS JOIN cells_ WINDOW p AS (PARTITION BY cell, bar)))"),
    ("kbook", "SELECT cell, bar, code, side * CASE WHEN two THEN 0.5 ELSE 1.0 END * (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY cell, bar, side) AS w FROM sides WHERE side IS NOT NULL"),
    *KATT,
    ("csum", _cost_sql('cell, "window"', _KATT_WINDOWS)),
]


def summarised(spark, sf_dir, w, by=("cell", "window")):
    """Costs taken apart for every cell and window."""
    series = store.cut(book.attributed(w, P.panel(spark, sf_dir)), "attributed")
    return metrics.cost_summary(P.in_windows(series).filter(F.col("window").isin(*WINDOWS)), list(by))


def attribution(spark, sf_dir):
    cells = F.broadcast(spark.createDataFrame(CELLS, "cell string, q double, two boolean"))
    held = book.keyed_sides(eligible(spark, sf_dir).crossJoin(cells)).withColumn("sizing", F.lit("inv_vol"))
    return summarised(spark, sf_dir, book.keyed_sized(held))


@query("cost_attribution", sql("SELECT * FROM csum", *ATTRIBUTION))
def cost_attribution(spark, sf_dir):
    """Static books of three sizes and one of two sides: gross and net by window, what trading costs, and how much of it is names that come or go and how much resizing."""
    return attribution(spark, sf_dir)


@query("cost_gate", sql(f"SELECT count(*) AS n_cells, count(*) FILTER (sizing_share >= {GATE}) AS n_over, count(*) FILTER (sizing_share >= {GATE}) >= {GATED_CELLS} AS trips FROM csum WHERE \"window\" = 'full'", *ATTRIBUTION))
def cost_gate(spark, sf_dir):
    """Whether resizing is so much of turnover, in so many cells, that equal weights are worth a try."""
    over = F.count_if(F.round("sizing_share", 6) >= GATE)
    return attribution(spark, sf_dir).filter(F.col("window") == "full").agg(F.count("*").alias("n_cells"), over.alias("n_over"), (over >= GATED_CELLS).alias("trips"))


RULE_CELLS, RULES, EPSILONS = CELLS[1:], ("buffer", "replace"), (0.0, 0.1, 0.3)


def _rule_steps(two: bool, rule: str) -> list[tuple[str, str]]:
    """The steps of a rule for the cells of one or two sides, under names of their own."""
    end = f"_{rule}{int(two)}"
    source = f"SELECT cell || '|{rule}|' || eps AS cell, bar, code, rk, n, k, eps::DOUBLE AS epsilon FROM sides CROSS JOIN (VALUES " + ", ".join(f"('{e}')" for e in EPSILONS) + f") e(eps) WHERE two = {str(two).upper()} AND cell <> 'long_q05'"
    return [(n + end, re.sub(r"\b(rsrc|rlist|rcells|rwalk|rheld)\b", rf"\g<1>{end}", q)) for n, q in replace_steps(source, long_short=two, buffer=rule == "buffer")]


_WAYS = [(two, rule) for two in (False, True) for rule in RULES]
RULE_SWEEP = [
    *ATTRIBUTION[:4],
    *[s for w in _WAYS for s in _rule_steps(*w)],
    ("rall", " UNION ALL ".join(f"SELECT *, {0.5 if two else 1.0}::DOUBLE AS half FROM rheld_{rule}{int(two)}" for two, rule in _WAYS)),
    ("kbook", "SELECT cell, bar, code, half * side * (1 / sigma) / sum(1 / sigma) OVER (PARTITION BY cell, bar, side) AS w FROM rall JOIN mem USING (bar, code)"),
    *KATT,
    ("csum", _cost_sql('cell, "window"', _KATT_WINDOWS)),
]


@query("hysteresis_rules", sql("SELECT split_part(cell, '|', 1) AS book, split_part(cell, '|', 2) AS rule, split_part(cell, '|', 3)::DOUBLE AS epsilon, * EXCLUDE (cell) FROM csum", *RULE_SWEEP))
def hysteresis_rules(spark, sf_dir):
    """Books of one and two sides by both rules of memory and by the width of the band, with costs taken apart by window: 18 books, four ordered streams."""
    # all books share the ranks
    m = store.cut(hysteresis.ranked_once(eligible(spark, sf_dir).select("bar", "code", "alpha", "sigma")), "ranked")
    held = []
    for two, rule in _WAYS:
        cells = spark.createDataFrame([(f"{c}|{rule}|{e:.1f}", q, e) for c, q, sides in RULE_CELLS if sides == two for e in EPSILONS], "cell string, q double, epsilon double")
        names = hysteresis.replace_book(m, P.panel(spark, sf_dir), F.col("q"), F.col("epsilon"), ["cell"], "buffer" if rule == "buffer" else "as_published", two, cells, ("alpha", "sigma"))
        held.append(names.withColumn("two", F.lit(two)))
    every = held[0].union(held[1]).union(held[2]).union(held[3]).withColumn("sizing", F.lit("inv_vol"))
    part = F.split("cell", r"\|")
    out = summarised(spark, sf_dir, book.keyed_sized(every))
    return out.select(part[0].alias("book"), part[1].alias("rule"), part[2].cast("double").alias("epsilon"), *out.columns[1:])


SIZINGS = ("eqw", "inv_vol", "inv_sqrt_vol", "rank_prop", "alpha_prop")
_RAW = "CASE sizing WHEN 'eqw' THEN 1.0::DOUBLE WHEN 'inv_vol' THEN 1 / sigma WHEN 'inv_sqrt_vol' THEN 1 / sqrt(sigma) WHEN 'rank_prop' THEN (m - r + 1)::DOUBLE ELSE alpha - low + greatest((high - low) / m, 1e-12) END"
SIZED = [
    *ATTRIBUTION[:4],
    *replace_steps("SELECT cell, bar, code, rk, n, k, 0.3::DOUBLE AS epsilon FROM sides WHERE cell = 'long_q20'"),
    ("kheld", "SELECT sizing AS cell, sizing, bar, code, block, alpha, sigma, count(*) OVER g AS m, min(alpha) OVER g AS low, max(alpha) OVER g AS high, row_number() OVER (PARTITION BY sizing, bar ORDER BY alpha DESC, code) AS r FROM rheld JOIN mem USING (bar, code) CROSS JOIN (VALUES " + ", ".join(f"('{s}')" for s in SIZINGS) + ") s(sizing) WINDOW g AS (PARTITION BY sizing, bar)"),
    ("kbook", f"SELECT cell, bar, code, block, raw / sum(raw) OVER (PARTITION BY cell, bar) AS w FROM (SELECT *, {_RAW} AS raw FROM kheld)"),
    *KATT,
    ("csum", _cost_sql("cell", f"SELECT * FROM katt WHERE bar <= DATE '{P.IS_END}'")),
    ("conc", f"SELECT cell, avg(hhi) AS hhi, avg(1 / hhi) AS effective, avg(top1) AS top1, avg(top3) AS top3, avg(top5) AS top5 FROM (SELECT cell, bar, sum(w * w) AS hhi, max(w) AS top1, sum(CASE WHEN r <= 3 THEN w END) AS top3, sum(CASE WHEN r <= 5 THEN w END) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY cell, bar ORDER BY w DESC, code) AS r FROM kbook WHERE bar <= DATE '{P.IS_END}') GROUP BY cell, bar) GROUP BY cell"),
]


def sized_books(spark, sf_dir):
    """(cell, bar, code, w): the best fifth under the replace rule in every sizing."""
    m = eligible(spark, sf_dir)
    held = hysteresis.replace_book(m, P.panel(spark, sf_dir), 0.2, 0.3).join(m.select("bar", "code", "alpha", "sigma"), ["bar", "code"])
    kinds = F.broadcast(spark.createDataFrame([(s,) for s in SIZINGS], "sizing string"))
    return store.cut(book.keyed_sized(held.crossJoin(kinds).withColumn("cell", F.col("sizing")).withColumn("two", F.lit(False))), "sized")


@query("sizing_summary", sql("SELECT csum.*, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("hhi", "effective", "top1", "top3", "top5")) + " FROM csum JOIN conc USING (cell)", *SIZED))
def sizing_summary(spark, sf_dir):
    """One selection with memory in five sizings, in sample: performance, costs taken apart, and how concentrated the weights are."""
    w = sized_books(spark, sf_dir)
    inside = F.col("bar") <= P.IS_END
    stats = metrics.cost_summary(book.attributed(w, P.panel(spark, sf_dir)).filter(inside), ["cell"])
    r = F.row_number().over(Window.partitionBy("cell", "bar").orderBy(F.desc("w"), "code"))
    by_bar = w.filter(inside).withColumn("r", r).groupBy("cell", "bar").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), *[F.sum(F.when(F.col("r") <= k, F.col("w"))).alias(f"top{k}") for k in (1, 3, 5)])
    conc = by_bar.withColumn("effective", div(F.lit(1.0), F.col("hhi"))).groupBy("cell").agg(*[F.avg(c).alias(c) for c in ("hhi", "effective", "top1", "top3", "top5")])
    # one row for each sizing
    return stats.join(F.broadcast(conc), "cell")


@query("sizing_allocation", sql(f"SELECT cell, block, round(sum(w) / any_value(n), 6) AS share FROM kbook JOIN (SELECT count(DISTINCT bar) AS n FROM kbook WHERE bar <= DATE '{P.IS_END}') ON TRUE WHERE bar <= DATE '{P.IS_END}' GROUP BY cell, block", *SIZED[:11]))
def sizing_allocation(spark, sf_dir):
    """The blocks' mean parts of the book in each sizing, in sample; a block that isn't held at a bar counts as zero."""
    w = sized_books(spark, sf_dir).filter(F.col("bar") <= P.IS_END).join(P.instruments(spark, sf_dir), "code")
    n = w.agg(F.count_distinct("bar").alias("n"))
    return w.groupBy("cell", "block").agg(F.sum("w").alias("t")).crossJoin(F.broadcast(n)).select("cell", "block", (F.col("t") / F.col("n")).alias("share"))


# --- standard scores -------------------------------------------------------------------------------------------------

STAGES = [EZ, ("ez7", "SELECT bar, code, block, factor, fwd / sigma AS y, round(z, 7) + 0.0 AS z FROM ez WHERE factor <> 'amt'")]


def scored(spark, sf_dir):
    """Factors with z: each name against its own past."""
    f = ic.expanding_z(factors(spark, sf_dir).filter("factor <> 'amt'"))
    return f.withColumn("z", F.round("z", 7) + 0.0).withColumn("y", div("fwd", "sigma"))


@query("stage_two_panel", sql(f"SELECT factor, bar, code, round({probit_sql('u')}, 6) + 0.0 AS g FROM (SELECT factor, bar, code, CASE WHEN count(z) OVER (PARTITION BY factor, bar) >= 3 THEN ({ranks('z', 'factor, bar')} - 0.5) / count(z) OVER (PARTITION BY factor, bar) END AS u FROM ez7)", *STAGES, base="factors"))
def stage_two_panel(spark, sf_dir):
    """Both stages of a factor: against its own past, then normal scores of the ranks across names."""
    return ic.gaussian_rank(scored(spark, sf_dir), "z", ["factor", "bar"]).select("factor", "bar", "code", "g")


_BSUMM = SUMMARY[1].replace("factor", "factor, block").replace("FROM ics", "FROM bics")
BLOCK_IC = [
    *STAGES,
    ("bics", f"SELECT factor, block, bar, {pearson('a', 'b', 5)} AS ic, count(*) AS n FROM (SELECT *, {ranks('z', 'factor, block, bar')} AS a, {ranks('y', 'factor, block, bar')} AS b FROM ez7 WHERE z IS NOT NULL AND y IS NOT NULL AND bar <= DATE '{P.IS_END}') GROUP BY factor, block, bar"),
    ("bsumm", _BSUMM),
    ("bn", "SELECT factor, block, avg(n) AS mean_n FROM bics WHERE ic IS NOT NULL GROUP BY factor, block"),
]
_BCOLS = ("mean", "std", "t", "pct_pos", "z", "ic_w", "roll_min", "roll_max")


@query("block_ic_stage_one", sql("SELECT factor, block, n_bars, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _BCOLS) + ", round(mean_n, 6) AS mean_n, CASE WHEN z >= 0 THEN 'raw' ELSE 'rev' END AS polarity, coalesce(abs(round(z, 6)) >= 2 AND n_bars >= 100, FALSE) AS strong FROM bsumm JOIN bn USING (factor, block)", *BLOCK_IC, base="factors"))
def block_ic_stage_one(spark, sf_dir):
    """Within blocks and in sample: a factor's score against its own past, not ranked across names, with the risk-adjusted outcome; its sign, and whether it is strong. Blocks without any correlation have no row."""
    per_bar = ic.rank_ic(scored(spark, sf_dir).filter(F.col("bar") <= P.IS_END), "z", "y", ["factor", "block", "bar"])
    s = ic.ic_summary(per_bar, ["factor", "block"]).filter("n_bars > 0")
    n = per_bar.filter("ic is not null").groupBy("factor", "block").agg(F.avg("n").alias("mean_n"))
    strong = F.coalesce((F.abs(F.round("z", 6)) >= 2) & (F.col("n_bars") >= 100), F.lit(False))
    return s.join(n, ["factor", "block"]).select("factor", "block", "n_bars", *_BCOLS, "mean_n", F.when(F.col("z") >= 0, "raw").otherwise("rev").alias("polarity"), strong.alias("strong"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("universe_versions", sql("SELECT 'static' AS version, code, block, NULL::BIGINT AS bars, NULL::DATE AS first_bar, NULL::DATE AS last_bar FROM instruments UNION ALL SELECT 'dynamic', code, any_value(block), count(*), min(bar), max(bar) FROM mship JOIN instruments USING (code) WHERE member GROUP BY code", *_MS, base="grid"))
def universe_versions(spark, sf_dir):
    """The universe persisted once and loaded in both versions: the fixed list of names, and the names ever admitted with the bars at which they are in."""
    at = store.fresh(spark, "universe")
    universe.persist(P.instruments(spark, sf_dir), membership(spark, sf_dir).filter("member"), at)
    static, dynamic = (universe.load(spark, v, at) for v in ("static", "dynamic"))
    times = dynamic.membership.groupBy("code").agg(F.count("*").alias("bars"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))
    fixed = static.names.select(F.lit("static").alias("version"), "code", "block", F.lit(None).cast("long").alias("bars"), F.lit(None).cast("date").alias("first_bar"), F.lit(None).cast("date").alias("last_bar"))
    return fixed.union(dynamic.names.join(times, "code").select(F.lit("dynamic"), "code", "block", "bars", "first_bar", "last_bar"))


@query("split_refresh", sql("SELECT step, state, CASE WHEN state = 'rows' THEN (SELECT count(*) FROM daily) WHEN state = 'missing' THEN 1 ELSE (SELECT count(DISTINCT code) FROM daily) END AS n FROM (VALUES ('first', 'written'), ('first', 'missing'), ('again', 'current'), ('again', 'missing'), ('forced', 'written'), ('forced', 'missing'), ('all', 'rows')) t(step, state)", base="daily"))
def split_refresh(spark, sf_dir):
    """The daily table in a folder for each code, three times: all is written, all is current and left alone, all is written anew by force; a code without rows is told. Rows are there once."""
    at, since = store.fresh(spark, "kept-codes"), files.changed(spark, f"{sf_dir}/lineitem.parquet")
    d = P.daily(spark, sf_dir)
    wanted = d.select("code").distinct().union(d.agg(F.max("code") + 1))
    out = None
    for name, force in (("first", False), ("again", False), ("forced", True)):
        states = files.refresh_by_code(d, at, "code", "date", since, wanted, force)
        n = states.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "state", "n")
        out = n if out is None else out.union(n)
    kept = spark.read.parquet(at).agg(F.count("*").alias("n"))
    return out.union(kept.select(F.lit("all"), F.lit("rows"), "n"))


_GRADES = {"sharpe": ("oos_sharpe", 0.5, 0.2), "max_dd": ("oos_dd", -0.1, -0.2), "decay": ("decay", 0.5, 0.2)}
VERDICT = [
    CAL,
    ("kmem", ANCHORED),
    ("kbook", "SELECT cell, bar, code, raw / sum(raw) OVER (PARTITION BY cell, bar) AS w FROM (SELECT *, 1 / sigma AS raw FROM (SELECT *, row_number() OVER (PARTITION BY cell, bar ORDER BY alpha DESC, code) AS rk, greatest(1, ceil(q * (count(*) OVER (PARTITION BY cell, bar)))::BIGINT) AS k FROM kmem) WHERE rk <= k)"),
    KMOVED,
    KNET,
    ("st", _stats_sql('cell, "window"', "SELECT cell, bar, net, win AS \"window\" FROM knet JOIN windows ON bar BETWEEN lo AND hi WHERE win IN ('is', 'oos')")),
    ("figs", "SELECT cell AS book, \"window\", n_bars, sharpe, cagr, max_dd, round(sharpe / nullif(max(CASE WHEN \"window\" = 'is' THEN sharpe END) OVER (PARTITION BY cell), 0), 6) + 0.0 AS decay FROM st"),
    ("one", "SELECT sharpe AS oos_sharpe, max_dd AS oos_dd, decay FROM figs WHERE book = 'solo' AND \"window\" = 'oos'"),
    ("grades", " UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN {c} >= {p} THEN 'pass' WHEN {c} >= {e} THEN 'edge' ELSE 'fail' END AS grade FROM one" for m, (c, p, e) in _GRADES.items())),
    ("verdict", "SELECT CASE WHEN bool_or(grade = 'fail') THEN 'FAIL' WHEN bool_or(grade = 'edge') THEN 'EDGE' ELSE 'PASS' END AS overall FROM grades"),
]


def written_verdict(spark, sf_dir) -> str:
    """Where the summary and the verdict on the solo book are: its figures after the sample, and how much of its Sharpe ratio it has kept."""
    s = metrics.window_stats(P.in_windows(anchored(spark, sf_dir)), ["cell", "window"]).filter("n_bars >= 2").filter(F.col("window").isin("is", "oos"))
    figures = s.select(F.col("cell").alias("book"), "window", "n_bars", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sharpe", "cagr", "max_dd")])
    inside = F.max(F.when(F.col("window") == "is", F.col("sharpe"))).over(Window.partitionBy("book"))
    figures = store.cut(figures.withColumn("decay", F.round(div(F.col("sharpe"), inside), 6) + 0.0), "figures")
    one = figures.filter((F.col("book") == "solo") & (F.col("window") == "oos")).select(F.col("sharpe").alias("oos_sharpe"), F.col("max_dd").alias("oos_dd"), "decay")
    graded = [F.struct(F.lit(m).alias("metric"), F.when(F.col(c) >= p, "pass").when(F.col(c) >= e, "edge").otherwise("fail").alias("grade")) for m, (c, p, e) in _GRADES.items()]
    at = store.fresh(spark, "verdict")
    files.write_verdict(spark, figures, one.select(F.explode(F.array(*graded)).alias("g")).select("g.*"), at)
    return at


@query("verdict_json", sql("SELECT figs.*, overall, grade AS decay_grade FROM figs CROSS JOIN verdict JOIN grades ON metric = 'decay'", *VERDICT))
def verdict_json(spark, sf_dir):
    """The nested summary of three books, read back from its JSON: a row for each book and window."""
    kinds = "overall string, per_metric map<string,string>, results map<string,map<string,struct<n_bars:bigint,sharpe:double,cagr:double,max_dd:double,decay:double>>>"
    j = spark.read.json(f"{written_verdict(spark, sf_dir)}/summary", schema=kinds)
    books = j.select("overall", F.col("per_metric")["decay"].alias("decay_grade"), F.explode("results").alias("book", "w"))
    return books.select("book", F.explode("w").alias("window", "f"), "overall", "decay_grade").select("book", "window", "f.*", "overall", "decay_grade")


@query("verdict_text", sql("SELECT 'OVERALL: ' || overall AS value FROM verdict UNION ALL SELECT metric || ': ' || grade FROM grades", *VERDICT))
def verdict_text(spark, sf_dir):
    """The verdict's lines, read back from its text."""
    return spark.read.text(f"{written_verdict(spark, sf_dir)}/verdict")


# --- years -----------------------------------------------------------------------------------------------------------

GROUP_YEARS = [
    *BSCORE,
    ("gbars", "SELECT DISTINCT bar FROM bmix WHERE w <> 0"),
    ("gret", "SELECT b.bar, b.block, sum(w) AS w, sum(w * coalesce(fwd, 0.0)) AS ret FROM bmix b JOIN panel p ON p.bar = b.bar AND p.code = b.code GROUP BY b.bar, b.block"),
    ("gall", "SELECT a.bar, k.block::VARCHAR AS grp, coalesce(w, 0.0) AS w, coalesce(ret, 0.0) AS ret FROM gbars a CROSS JOIN (SELECT DISTINCT block FROM bmix) k LEFT JOIN gret g ON g.bar = a.bar AND g.block = k.block UNION ALL SELECT bar, 'all', sum(w), sum(ret) FROM gret JOIN gbars USING (bar) GROUP BY bar"),
]


@query("group_years", sql("SELECT year(bar) AS year, grp, count(*) AS n_bars, round(avg(w), 6) + 0.0 AS mean_w, round(sum(ret), 6) + 0.0 AS ret, round(stddev_samp(ret) * sqrt(52.0), 6) + 0.0 AS ann_vol FROM gall GROUP BY 1, 2 HAVING count(*) >= 2", *GROUP_YEARS, base="factors"))
def group_years(spark, sf_dir):
    """Each block's weight, what it earned and how volatile that was, and the same of the whole book, by year over the bars that hold anything."""
    w = mixed(spark, sf_dir).join(P.panel(spark, sf_dir).select("bar", "code", "block", "fwd"), ["bar", "code"])
    g = store.cut(w.groupBy("bar", "block").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("ret"), F.max(F.col("w") != 0).alias("any")), "groups")
    bars = g.groupBy("bar").agg(F.sum("w").alias("w"), F.sum("ret").alias("ret"), F.max("any").alias("any")).filter("any").drop("any")
    # a handful of blocks
    dense = bars.select("bar").crossJoin(F.broadcast(g.select("block").distinct())).join(g.drop("any"), ["bar", "block"], "left").na.fill(0.0, ["w", "ret"])
    both = dense.select("bar", F.col("block").cast("string").alias("grp"), "w", "ret").union(bars.select("bar", F.lit("all"), "w", "ret"))
    out = both.groupBy(F.year("bar").alias("year"), "grp").agg(F.count("*").alias("n_bars"), F.avg("w").alias("mean_w"), F.sum("ret").alias("ret"), (F.stddev_samp("ret") * F.sqrt(F.lit(52.0))).alias("ann_vol"))
    return out.filter("n_bars >= 2")
