"""Books: weights, what they earn and cost, and where that comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TINY, div, k_of, kernel
from ..functions.stats import first_rank, rows
from ..plans import store
from .ic import eligible_k, near_top

COST = 0.001


def trailing_percentile(value: str, weeks: int = 26, by: str = "code") -> Column:
    """Share of the last `weeks` values, all needed, that are at most the current one."""
    w = rows(by, "bar", -(weeks - 1))
    past = F.collect_list(value).over(w)
    return F.when((F.size(past) == weeks) & F.col(value).isNotNull(), F.size(F.filter(past, lambda x: x <= F.col(value))) / float(weeks))


def sized(df: DataFrame, sizing: str, by: list[str], total: float | Column = 1.0) -> DataFrame:
    """df (held names of one side) with `w`: sizes in proportion to the sizing, adding up to total within `by`."""
    g = Window.partitionBy(*by)
    if sizing == "rank_prop":
        raw = (F.count("*").over(g) - first_rank("alpha", by) + 1).cast("double")
    elif sizing == "alpha_prop":
        low, high, held = F.min("alpha").over(g), F.max("alpha").over(g), F.count("*").over(g)
        raw = F.col("alpha") - low + F.greatest((high - low) / held, F.lit(TINY))
    else:
        raw = kernel(sizing)
    raw = df.withColumn("_raw", raw)
    return raw.withColumn("w", div(F.col("_raw"), F.sum("_raw").over(g)) * (total if isinstance(total, Column) else F.lit(total))).drop("_raw")


def static_weights(df: DataFrame, q: float = 0.2, long_short: bool = False, sizing: str = "inv_vol") -> DataFrame:
    """(bar, code, side, w, n, k): the best share q by alpha, and with two sides the worst, half the book each. df(bar, code, alpha, sigma) of eligible names."""
    ranked = eligible_k(df, q, long_short)
    side = F.when(F.col("rk") <= F.col("k"), 1)
    if long_short:
        side = side.when(F.col("rk") > F.col("n") - F.col("k"), -1)
    held = ranked.withColumn("side", side).filter("side is not null")
    return sized(held, sizing, ["bar", "side"], F.col("side") * F.lit(0.5 if long_short else 1.0)).select("bar", "code", "side", "w", "n", "k")


def changes(w: DataFrame, bars: DataFrame, by: list[str] | None = None, first: str = "free") -> DataFrame:
    """(by, bar, code, w, prev, seq, dw, and w's other columns) for every name held at a bar or the one before.

    w holds non-zero weights, one row for a name and bar of a book; bars(bar, prior, seq) the bars of all books, a row a week. A weight missing at the bar before counts as zero, an exit
    gives a row of weight zero. The first bar's change is zero (`free`) or all of it (`paid`). One window by name: the row before is the bar before's unless their
    numbers leave a gap, and a row before a gap has an exit after it.
    """
    by = by or []
    after = Window.partitionBy(F.lit(0)).orderBy("seq")
    days = F.broadcast(bars.select("bar", "seq", F.lead("bar").over(after).alias("_next")))
    order = Window.partitionBy(*by, "code").orderBy("seq")
    at = w.join(days, "bar")
    seq = F.col("seq")
    prev = F.when(F.lag("seq").over(order) == seq - 1, F.lag("w").over(order)).otherwise(0.0)
    gone = F.col("_next").isNotNull() & ~F.coalesce(F.lead("seq").over(order) == seq + 1, F.lit(False))
    at = at.withColumn("prev", prev).withColumn("_gone", gone)
    now = F.struct("bar", "w", "prev", "seq")
    exit_ = F.struct(F.col("_next").alias("bar"), F.lit(0.0).alias("w"), F.col("w").alias("prev"), (seq + 1).alias("seq"))
    both = at.withColumn("_x", F.explode(F.when(F.col("_gone"), F.array(now, exit_)).otherwise(F.array(now))))
    rest = [c for c in w.columns if c not in (*by, "bar", "code", "w")]
    out = both.select(*by, "_x.bar", "code", "_x.w", "_x.prev", "_x.seq", *rest)
    dw = F.when((F.col("seq") == 1) & F.lit(first == "free"), 0.0).otherwise(F.col("w") - F.col("prev"))
    return out.withColumn("dw", dw)


def calendar(bars: DataFrame) -> DataFrame:
    """(bar, prior, seq) of distinct bars in order."""
    w = Window.partitionBy(F.lit(0)).orderBy("bar")
    return bars.select("bar").distinct().withColumn("prior", F.lag("bar").over(w)).withColumn("seq", F.row_number().over(w))


def run_book(w: DataFrame, panel: DataFrame, by: list[str] | None = None, cost: float = COST) -> DataFrame:
    """(by, bar, gross, turnover, net, n_held): weights earn the return to the next bar; a missing one counts as zero. Costs are on the sum of absolute changes. w may bring fwd along."""
    by = by or []
    bars = calendar(panel.select("bar"))
    held = w.select(*by, "bar", "code", "w", "fwd") if "fwd" in w.columns else w.select(*by, "bar", "code", "w").join(panel.select("bar", "code", "fwd"), ["bar", "code"], "left")
    moved = changes(held, bars, by)
    g = moved.groupBy(*by, "bar").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.sum(F.abs("dw")).alias("turnover"), F.sum((F.col("w") != 0).cast("int")).alias("n_held"))
    # a row for each book and week; read for the list of books too
    g = store.cut(g, "earned") if by else g
    zero = F.lit(0.0)
    every = g.select(*by).distinct().crossJoin(F.broadcast(bars.select("bar"))) if by else bars.select("bar")
    full = every.join(g, [*by, "bar"], "left")
    full = full.withColumn("gross", F.coalesce("gross", zero)).withColumn("turnover", F.coalesce("turnover", zero)).withColumn("n_held", F.coalesce("n_held", F.lit(0)))
    return full.withColumn("net", F.col("gross") - F.lit(cost) * F.col("turnover")).select(*by, "bar", "gross", "turnover", "net", "n_held")


def run_parts(names: DataFrame, scale: DataFrame, panel: DataFrame, part: list[str], by: str = "cell", cost: float = COST) -> DataFrame:
    """What `run_book` gives for books whose weights are names' weights in a part times the part's in the book, without a row for each book and name ahead of a shuffle.

    names(part, bar, code, w, fwd): a name is in one part of a book; scale(by, part, bar, w), a row for each book, part and bar. Names are shuffled once, whatever the number of
    books; their changes meet the books' scales in tasks, where they are added up by book and bar at once. Returns and counts need parts alone.
    """
    bars = store.cut(calendar(panel.select("bar")), "bars")
    held = store.cut(names.filter("w <> 0"), "held")
    sums = held.groupBy(*part, "bar").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("_ret"), F.count("*").alias("_n"))
    now = scale.filter("w <> 0").select(by, *part, "bar", F.col("w").alias("_g"))
    after = now.join(F.broadcast(bars.filter("prior is not null").select(F.col("prior").alias("bar"), F.col("bar").alias("_to"))), "bar").select(by, *part, F.col("_to").alias("bar"), F.col("_g").alias("_h"))
    zero = F.lit(0.0)
    both = now.join(after, [by, *part, "bar"], "full").select(by, *part, "bar", F.coalesce("_g", zero).alias("_g"), F.coalesce("_h", zero).alias("_h"))
    both = store.cut(both.join(bars.select("bar", "seq"), "bar"), "scales")
    earned = both.filter("_g <> 0").join(sums, [*part, "bar"]).groupBy(by, "bar").agg(F.sum(F.col("_g") * F.col("_ret")).alias("gross"), F.sum("_n").alias("n_held"))
    # grows with books, parts and bars, not with names; a list for each part and bar
    lists = both.filter("seq > 1").groupBy(*part, "bar").agg(F.collect_list(F.struct(by, "_g", "_h")).alias("_books"))
    moved = changes(held.select(*part, "bar", "code", "w"), bars, part).select(*part, "bar", "w", "prev")
    each = moved.join(F.broadcast(lists), [*part, "bar"]).select("bar", "w", "prev", F.explode("_books").alias("_b"))
    traded = each.groupBy(F.col(f"_b.{by}").alias(by), "bar").agg(F.sum(F.abs(F.col("_b._g") * F.col("w") - F.col("_b._h") * F.col("prev"))).alias("turnover"))
    g = store.cut(earned.join(traded, [by, "bar"], "full"), "moved")
    full = g.select(by).distinct().crossJoin(F.broadcast(bars.select("bar"))).join(g, [by, "bar"], "left")
    full = full.na.fill(0.0, ["gross", "turnover"]).withColumn("n_held", F.coalesce("n_held", F.lit(0).cast("long")))
    return full.withColumn("net", F.col("gross") - F.lit(cost) * F.col("turnover")).select(by, "bar", "gross", "turnover", "net", "n_held")


def run_sizings(held: DataFrame, panel: DataFrame, by: str = "cell", cost: float = COST) -> DataFrame:
    """(by, bar, gross, turnover, net) of what `run_book` gives for the names held(by, bar, code, sigma, fwd), alike and by inverse volatility: `by` gets |eqw and |inv_vol.

    Both books hold the same names, so a name is shuffled once, with what its weights are made of; the sums that they are divided by are a row for each book and bar. held is read twice.
    """
    bars = store.cut(calendar(panel.select("bar")), "bars")
    total = held.groupBy(by, "bar").agg(F.count("*").alias("_n"), F.sum(div(F.lit(1.0), F.col("sigma"))).alias("_inv"))
    days = bars.select("bar", "seq", F.lead("bar").over(Window.partitionBy(F.lit(0)).orderBy("seq")).alias("_next"))
    at = held.select(by, "bar", "code", "sigma", "fwd").repartition(by, "code").join(F.broadcast(total), [by, "bar"]).join(F.broadcast(days), "bar")
    sizings = {"eqw": 1 / F.col("_n").cast("double"), "inv_vol": div(div(F.lit(1.0), F.col("sigma")), F.col("_inv"))}
    order = Window.partitionBy(by, "code").orderBy("seq")
    follows, stays = F.lag("seq").over(order) == F.col("seq") - 1, F.coalesce(F.lead("seq").over(order) == F.col("seq") + 1, F.lit(False))
    at = at.withColumns({f"_w_{n}": w for n, w in sizings.items()})
    at = at.withColumns({f"_p_{n}": F.when(follows, F.lag(f"_w_{n}").over(order)).otherwise(0.0) for n in sizings} | {"_gone": F.col("_next").isNotNull() & ~stays})
    zero = F.lit(0.0)
    now = F.struct("bar", "seq", "fwd", *[c for n in sizings for c in (F.col(f"_w_{n}").alias(f"w_{n}"), F.col(f"_p_{n}").alias(f"p_{n}"))])
    exit_ = F.struct(F.col("_next").alias("bar"), (F.col("seq") + 1).alias("seq"), "fwd", *[c for n in sizings for c in (zero.alias(f"w_{n}"), F.col(f"_w_{n}").alias(f"p_{n}"))])
    both = at.select(by, F.explode(F.when(F.col("_gone"), F.array(now, exit_)).otherwise(F.array(now))).alias("_x")).select(by, "_x.*")
    earned = [F.sum(F.col(f"w_{n}") * F.coalesce("fwd", zero)).alias(f"g_{n}") for n in sizings]
    traded = [F.sum(F.when(F.col("seq") == 1, 0.0).otherwise(F.abs(F.col(f"w_{n}") - F.col(f"p_{n}")))).alias(f"t_{n}") for n in sizings]
    # a row for each book and week
    g = store.cut(both.groupBy(by, "bar").agg(*earned, *traded), "earned")
    full = g.select(by).distinct().crossJoin(F.broadcast(bars.select("bar"))).join(g, [by, "bar"], "left").na.fill(0.0)
    each = F.explode(F.array(*[F.struct(F.concat_ws("|", by, F.lit(n)).alias(by), F.col(f"g_{n}").alias("gross"), F.col(f"t_{n}").alias("turnover")) for n in sizings]))
    out = full.select("bar", each.alias("_x")).select(f"_x.{by}", "bar", "_x.gross", "_x.turnover")
    return out.withColumn("net", F.col("gross") - F.lit(cost) * F.col("turnover"))


def turnover_parts(moved: DataFrame) -> DataFrame:
    """(bar, selection, sizing): changes of names that come or go, and of names that stay; the first bar is all selection."""
    held, was = F.col("w") != 0, F.col("prev") != 0
    size = F.abs(F.col("w") - F.col("prev"))
    return moved.groupBy("bar").agg(F.sum(F.when(held & was, 0.0).otherwise(size)).alias("selection"), F.sum(F.when(held & was, size).otherwise(0.0)).alias("sizing"))


def concentration(w: DataFrame) -> DataFrame:
    """(bar, hhi, effective, top1, top3, top5) of absolute shares."""
    share = div(F.abs("w"), F.sum(F.abs("w")).over(Window.partitionBy("bar")))
    s = w.withColumn("s", share).withColumn("r", F.row_number().over(Window.partitionBy("bar").orderBy(F.desc(F.abs("w")), "code")))
    g = s.groupBy("bar").agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), *[F.sum(F.when(F.col("r") <= k, F.col("s"))).alias(f"top{k}") for k in (1, 3, 5)])
    return g.withColumn("effective", div(F.lit(1.0), F.col("hhi")))


def allocation(w: DataFrame, group: str = "block") -> DataFrame:
    """(group, share): mean over bars of the group's part of the absolute weights; absent groups count as zero."""
    by_bar = w.groupBy("bar", group).agg(F.sum(F.abs("w")).alias("a")).withColumn("s", div(F.col("a"), F.sum("a").over(Window.partitionBy("bar"))))
    n = w.select("bar").distinct().agg(F.count("*").alias("n"))
    return by_bar.groupBy(group).agg(F.sum("s").alias("t")).crossJoin(F.broadcast(n)).select(group, (F.col("t") / F.col("n")).alias("share"))


def popularity(w: DataFrame) -> DataFrame:
    """(side, code, bars, presence, mean_w, time_share): how often and how much a name is held."""
    n = w.agg(F.count_distinct("bar").alias("n_bars"))
    g = w.groupBy("side", "code").agg(F.count("*").alias("bars"), F.avg(F.abs("w")).alias("mean_w"), F.sum(F.abs("w")).alias("t"))
    share = div(F.col("t"), F.sum("t").over(Window.partitionBy("side")))
    return g.crossJoin(F.broadcast(n)).select("side", "code", "bars", (F.col("bars") / F.col("n_bars")).alias("presence"), "mean_w", share.alias("time_share"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bar, jaccard) of two books' names."""
    both = a.select("bar", "code", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("bar", "code", F.lit(0), F.lit(1))).groupBy("bar", "code").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.groupBy("bar").agg((F.sum((F.col("a") + F.col("b") == 2).cast("int")) / F.count("*")).alias("jaccard"))


def churn(w: DataFrame, bars: DataFrame, within: int = 4) -> DataFrame:
    """(bar, code, event, gap): entries and exits, and after an exit the weeks to the next entry if at most `within`."""
    moved = changes(w, bars, first="paid")
    event = F.when((F.col("prev") == 0) & (F.col("w") != 0), "entry").when((F.col("prev") != 0) & (F.col("w") == 0), "exit")
    log = moved.withColumn("event", event).filter("event is not null")
    order = Window.partitionBy("code").orderBy("bar")
    weeks = (F.datediff(F.lead("bar").over(order), F.col("bar")) / 7).cast("int")
    gap = F.when((F.col("event") == "exit") & (F.lead("event").over(order) == "entry") & (weeks <= within), weeks)
    return log.select("bar", "code", "event", gap.alias("gap"))


def blend(a: DataFrame, b: DataFrame, share: DataFrame) -> DataFrame:
    """(bar, code, w): share of book a, the rest of book b; a bar without a share is all a."""
    both = a.select("bar", "code", F.col("w").alias("wa"), F.lit(0.0).alias("wb")).union(b.select("bar", "code", F.lit(0.0), F.col("w"))).groupBy("bar", "code").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    s = F.coalesce("share", F.lit(1.0))
    return both.join(share, "bar", "left").select("bar", "code", (s * F.col("wa") + (1 - s) * F.col("wb")).alias("w"))


def keyed_weights(df: DataFrame, by: str = "cell", cheap: bool = False) -> DataFrame:
    """(by, bar, code, w, and fwd where df has it): long books of all cells in one plan. df(by, bar, code, alpha, sigma, q, sizing): in each bar the best share q by alpha, `eqw` or `inv_vol`.

    cheap: df is cheap to read again, see `near_top`.
    """
    if cheap:
        keys = [by, "bar"]
        ranked = near_top(df, keys, k_of("n", F.col("q")), also=("q",)).withColumn("k", k_of("n", F.col("q"))).withColumn("rk", first_rank("alpha", keys)).filter(F.col("rk") <= F.col("k"))
    else:
        ranked = eligible_k(df, F.col("q"), by=[by]).filter(F.col("rk") <= F.col("k"))
    raw = ranked.withColumn("raw", F.when(F.col("sizing") == "eqw", 1.0).otherwise(div(F.lit(1.0), F.col("sigma"))))
    return raw.select(by, "bar", "code", div(F.col("raw"), F.sum("raw").over(Window.partitionBy(by, "bar"))).alias("w"), *[c for c in ("fwd",) if c in df.columns])


def at_refreshes(series: DataFrame, refreshes: DataFrame) -> DataFrame:
    """(refresh, n, mean_turnover, max_turnover): turnover of the bars at which a book is made anew, and of the others. refreshes(refresh): a few dates."""
    marked = series.join(F.broadcast(refreshes.select(F.col("refresh").alias("bar"), F.lit(True).alias("refresh"))), "bar", "left")
    return marked.groupBy(F.coalesce("refresh", F.lit(False)).alias("refresh")).agg(F.count("*").alias("n"), F.avg("turnover").alias("mean_turnover"), F.max("turnover").alias("max_turnover"))


def group_mixed(sub: DataFrame, groups: DataFrame, ever: DataFrame) -> DataFrame:
    """(bar, code, w): weights within blocks times their group's share and N_b / N_g, the counts of names that were ever members of the block and of all blocks of the group; what a block leaves is cash.

    sub(bar, block, code, w), groups(block, grp, share), ever(code, block): the counts are fixed, so weights are not renormalised when a block has no names.
    """
    n = ever.groupBy("block").agg(F.count_distinct("code").alias("nb"))
    g = groups.join(n, "block").withColumn("ng", F.sum("nb").over(Window.partitionBy("grp")))
    return sub.join(F.broadcast(g), "block").select("bar", "code", (F.col("w") * F.col("share") * F.col("nb") / F.col("ng")).alias("w"))


def picked(scored: DataFrame, eligible: DataFrame, q: float, group: str = "block", cell: str = "factor") -> DataFrame:
    """(cell, bar, code, group, k): each cell's best names of each group, a share q of those that are eligible in it. scored(cell, bar, code, group, score), eligible(bar, code, group)."""
    n = eligible.groupBy("bar", group).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(cell, "bar", group).orderBy(F.desc("score"), "code"))
    ranked = scored.withColumn("_r", rank).join(n, ["bar", group]).withColumn("k", F.ceil(F.lit(q) * F.col("_n").cast("double")).cast("long"))
    return ranked.filter("_r <= k").select(cell, "bar", "code", group, "k")


def popularity_verdict(picks: DataFrame, eligible: DataFrame, null: str, group: str = "block", cell: str = "factor", like: float = 0.7, near: float = 0.2, apart: float = 0.5, rotates: float = 0.15) -> DataFrame:
    """(cell, group, eff_n, null_n, top_presence, turnover, overlap, verdict) of every cell but `null`; null_n is the eff_n of `null`.

    presence of a name: bars at which it is picked over bars at which it is eligible; eff_n: effective number of names by presence; turnover: names that come or go over twice k, at
    every bar of the group, the first counting zero; overlap: mean Jaccard index with the picks of the cell `null`. INV_VOL_LIKE from an overlap of `like` on with an effective number
    within `near` of the null's, ROTATIONAL up to `apart` when it turns over, else MIXED.
    """
    keys = [cell, group]
    cells = picks.select(cell).distinct()
    held = picks.groupBy(cell, "code").agg(F.count("*").alias("_h"))
    could = eligible.groupBy(group, "code").agg(F.count("*").alias("_m"))
    # cells are a short list
    p = F.coalesce("_h", F.lit(0)) / F.col("_m")
    presence = could.crossJoin(F.broadcast(cells)).join(held, [cell, "code"], "left").withColumn("p", p)
    effective = presence.groupBy(*keys).agg(div(F.sum("p") * F.sum("p"), F.sum(F.col("p") * F.col("p"))).alias("eff_n"), F.max("p").alias("top_presence"))

    bars = eligible.groupBy("bar", group).agg(F.count("*").alias("_n")).withColumn("_seq", F.row_number().over(Window.partitionBy(group).orderBy("bar")))
    at = picks.join(bars.select("bar", group, "_seq"), ["bar", group])
    order = Window.partitionBy(*keys, "code").orderBy("_seq")
    comes = F.when(F.lag("_seq").over(order) == F.col("_seq") - 1, 0).otherwise(1)
    goes = F.when(F.lead("_seq").over(order) == F.col("_seq") + 1, 0).otherwise(1)
    steps = at.withColumn("_in", comes).withColumn("_out", goes)
    moved = steps.select(*keys, F.col("_seq"), F.col("_in").alias("d")).union(steps.select(*keys, F.col("_seq") + 1, "_out")).groupBy(*keys, "_seq").agg(F.sum("d").alias("d"))
    every = picks.select(*keys).distinct().join(bars, group).join(moved, [*keys, "_seq"], "left")
    ks = picks.groupBy("bar", group).agg(F.max("k").alias("k"))
    every = every.join(ks, ["bar", group], "left")
    turn = F.when(F.col("_seq") == 1, 0.0).otherwise(F.coalesce("d", F.lit(0))) / (2.0 * F.col("k"))
    turnover = every.groupBy(*keys).agg(F.avg(turn).alias("turnover"))

    base = picks.filter(F.col(cell) == null).select("bar", "code", F.lit(1).alias("_z"))
    sizes = picks.filter(F.col(cell) == null).groupBy("bar", group).agg(F.count("*").alias("_nz"))
    both = picks.filter(F.col(cell) != null).join(base, ["bar", "code"], "left").groupBy(*keys, "bar").agg(F.count("*").alias("_a"), F.sum(F.coalesce("_z", F.lit(0))).alias("_b"))
    overlap = both.join(sizes, ["bar", group]).groupBy(*keys).agg(F.avg(F.col("_b") / (F.col("_a") + F.col("_nz") - F.col("_b"))).alias("overlap"))
    nulls = effective.filter(F.col(cell) == null).select(group, F.col("eff_n").alias("null_n"))
    alike = F.abs(F.col("eff_n") - F.col("null_n")) / F.greatest("null_n", F.lit(1e-9)) <= near
    verdict = F.when((F.col("overlap") >= like) & alike, "INV_VOL_LIKE").when((F.col("overlap") <= apart) & (F.col("turnover") >= rotates), "ROTATIONAL").otherwise("MIXED")
    # one row for each group
    return effective.join(turnover, keys).join(overlap, keys).join(F.broadcast(nulls), group, "left").select(*keys, "eff_n", "null_n", "top_presence", "turnover", "overlap", verdict.alias("verdict"))


def marginal_churn(w: DataFrame, ranked: DataFrame, bars: DataFrame, band: int = 2) -> DataFrame:
    """(bar, code, event, distance, marginal): entries and exits with how far the name's rank at the bar is from the last place held, inside positive; a name that is no longer eligible has none.

    w(bar, code, w), ranked(bar, code, rk, k) of eligible names. marginal: within `band` places.
    """
    log = churn(w, bars).select("bar", "code", "event").join(ranked.select("bar", "code", "rk", "k"), ["bar", "code"], "left")
    d = F.col("k") - F.col("rk")
    return log.select("bar", "code", "event", d.cast("int").alias("distance"), F.coalesce(F.abs(d) <= band, F.lit(False)).alias("marginal"))


def top_turnover(series: DataFrame, refreshes: DataFrame, top: int = 5, cost: float = COST) -> DataFrame:
    """(bar, turnover, share, drag_bp, refresh): the bars that trade most, their part of all turnover, what they cost, and whether a book is made anew there. A report of `top` rows."""
    marked = series.join(F.broadcast(refreshes.select(F.col("refresh").alias("bar"), F.lit(True).alias("refresh"))), "bar", "left")
    total = series.agg(F.sum("turnover").alias("_t"))
    best = marked.orderBy(F.desc(F.round("turnover", 9)), "bar").limit(top)
    # one row of totals
    return best.crossJoin(F.broadcast(total)).select("bar", "turnover", div("turnover", "_t").alias("share"), (F.col("turnover") * cost * 1e4).alias("drag_bp"), F.coalesce("refresh", F.lit(False)).alias("refresh"))


def transition_costs(share: DataFrame, series: DataFrame, cost: float = COST) -> DataFrame:
    """(moved, n, mean_step, mean_turnover, cost_bp): bars at which the share of a blend moves against those at which it stays: turnover, and its cost in basis points a year. share(bar, share), a row a bar."""
    w = Window.partitionBy(F.lit(0)).orderBy("bar")
    step = F.abs(F.col("share") - F.lag("share").over(w))
    s = share.withColumn("step", F.coalesce(step, F.lit(0.0))).join(series, "bar")
    return s.groupBy((F.col("step") > 0).alias("moved")).agg(F.count("*").alias("n"), F.avg("step").alias("mean_step"), F.avg("turnover").alias("mean_turnover"), (F.avg("turnover") * cost * 52 * 1e4).alias("cost_bp"))


def keyed_sides(df: DataFrame, by: str = "cell") -> DataFrame:
    """df(by, bar, code, alpha, q, two) with `side`: static books of all cells in one plan, the best share q by alpha, and where `two` is true the worst as well."""
    ranked = eligible_k(df, F.col("q"), F.col("two"), [by])
    side = F.when(F.col("rk") <= F.col("k"), 1).when(F.col("two") & (F.col("rk") > F.col("n") - F.col("k")), -1)
    return ranked.withColumn("side", side).filter("side is not null")


def keyed_sized(held: DataFrame, by: str = "cell") -> DataFrame:
    """(by, bar, code, w) of held(by, bar, code, side, alpha, sigma, sizing, two): each cell's own sizing, a side adding up to one, or to a half where there are two."""
    g = Window.partitionBy(by, "bar", "side")
    n, low, high = F.count("*").over(g), F.min("alpha").over(g), F.max("alpha").over(g)
    s = F.col("sizing")
    raw = F.when(s == "eqw", F.lit(1.0)).when(s == "inv_vol", 1 / F.col("sigma")).when(s == "inv_sqrt_vol", 1 / F.sqrt("sigma"))
    raw = raw.when(s == "rank_prop", (n - first_rank("alpha", [by, "bar", "side"]) + 1).cast("double"))
    raw = raw.when(s == "alpha_prop", F.col("alpha") - low + F.greatest((high - low) / n, F.lit(TINY)))
    total = F.col("side") * F.when(F.col("two"), 0.5).otherwise(1.0)
    return held.withColumn("_raw", raw).select(by, "bar", "code", (total * div(F.col("_raw"), F.sum("_raw").over(g))).alias("w"))


def attributed(w: DataFrame, panel: DataFrame, by: str = "cell", cost: float = COST) -> DataFrame:
    """(by, bar, gross, selection, sizing, turnover, cost, net, n_held, d_held): each cell's series with turnover by names that come or go and by names that stay.

    Every bar of the panel has a row in every cell; the first deployment is paid. d_held: by how many the number of names held has moved.
    """
    bars = calendar(panel.select("bar"))
    held = w.select(by, "bar", "code", "w").join(panel.select("bar", "code", "fwd"), ["bar", "code"], "left")
    moved = changes(held, bars, [by], first="paid")
    both = (F.col("w") != 0) & (F.col("prev") != 0)
    size, zero = F.abs("dw"), F.lit(0.0)
    g = moved.groupBy(by, "bar").agg(
        F.sum(F.col("w") * F.coalesce("fwd", zero)).alias("gross"), F.sum(F.when(both, zero).otherwise(size)).alias("selection"), F.sum(F.when(both, size).otherwise(zero)).alias("sizing"), F.sum((F.col("w") != 0).cast("long")).alias("n_held")
    )
    # a row for each cell and week; read for the list of cells too
    g = store.cut(g, "earned")
    every = g.select(by).distinct().crossJoin(F.broadcast(bars.select("bar"))).join(g, [by, "bar"], "left").na.fill(0.0, ["gross", "selection", "sizing"]).na.fill(0, ["n_held"])
    every = every.withColumn("turnover", F.col("selection") + F.col("sizing")).withColumn("cost", F.col("turnover") * cost).withColumn("net", F.col("gross") - F.col("cost"))
    before = F.lag("n_held").over(Window.partitionBy(by).orderBy("bar"))
    return every.withColumn("d_held", F.coalesce(F.abs(F.col("n_held") - before), F.lit(0)))
