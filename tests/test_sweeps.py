"""Keyed books, costs taken apart and the buffer rule against plain versions; files kept current; versions of the universe; verdicts."""

import datetime
import json
import math
import random
import statistics
from collections import defaultdict
from pathlib import Path

import pytest
from panelspark.operators import book, files, hysteresis, metrics, universe

BAR = [datetime.date(1990, 1, 5) + datetime.timedelta(weeks=i) for i in range(8)]
LONG_AGO, LATER = datetime.datetime(1990, 1, 1), datetime.datetime(2100, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- books -----------------------------------------------------------------------------------------------------------


def test_sides_of_cells(spark):
    rows = [(c, BAR[0], i, float(-i), 0.1, q, two) for c, q, two in (("a", 0.2, False), ("b", 0.2, True), ("c", 0.9, True)) for i in range(5)]
    rows += [("b", BAR[1], 7, 1.0, 0.1, 0.2, True)]  # one name: none of it is half of two sides
    got = defaultdict(list)
    for r in book.keyed_sides(frame(spark, rows, "cell string, bar date, code long, alpha double, sigma double, q double, two boolean")).collect():
        got[r.cell, r.bar, r.side].append(r.code)
    assert {k: sorted(v) for k, v in got.items()} == {("a", BAR[0], 1): [0], ("b", BAR[0], 1): [0], ("b", BAR[0], -1): [4], ("c", BAR[0], 1): [0, 1], ("c", BAR[0], -1): [3, 4]}


def test_sizings_of_cells(spark):
    names = [(1, 3.0, 0.1), (2, 1.0, 0.4), (3, 1.0, 0.2)]
    rows = [(s, BAR[0], c, 1, a, v, s, False) for s in ("eqw", "inv_vol", "inv_sqrt_vol", "rank_prop", "alpha_prop") for c, a, v in names]
    rows += [("alike", BAR[0], c, 1, 5.0, 0.1, "alpha_prop", False) for c in (1, 2)] + [("two", BAR[0], c, s, 1.0, v, "inv_vol", True) for c, s, v in ((1, 1, 0.1), (2, 1, 0.3), (3, -1, 0.2))]
    got = defaultdict(dict)
    for r in book.keyed_sized(frame(spark, rows, "cell string, bar date, code long, side int, alpha double, sigma double, sizing string, two boolean")).collect():
        got[r.cell][r.code] = r.w
    step = 2 / 3  # a third of the range
    raw = {"eqw": (1, 1, 1), "inv_vol": (10, 2.5, 5), "inv_sqrt_vol": tuple(1 / math.sqrt(v) for _, _, v in names), "rank_prop": (3, 2, 1), "alpha_prop": (2 + step, step, step)}
    for s, x in raw.items():
        assert [got[s][c] for c in (1, 2, 3)] == pytest.approx([v / sum(x) for v in x])
    assert got["alike"] == pytest.approx({1: 0.5, 2: 0.5}) and got["two"] == pytest.approx({1: 0.375, 2: 0.125, 3: -0.5})


def test_costs_are_those_of_a_replay(spark):
    rng = random.Random(3)
    weights = {(c, b, n): rng.choice([0.25, 0.5, -0.5]) for c in "xy" for b in BAR for n in range(6) if rng.random() < (0.5 if c == "x" else 0.2)}
    fwd = {(b, n): rng.uniform(-0.1, 0.1) if rng.random() < 0.9 else None for b in BAR for n in range(6)}
    w = frame(spark, [(*k, v) for k, v in weights.items()], "cell string, bar date, code long, w double")
    panel = frame(spark, [(*k, v) for k, v in fwd.items()], "bar date, code long, fwd double")
    series = book.attributed(w, panel).cache()
    got = {(r.cell, r.bar): r for r in series.collect()}
    assert len(got) == 2 * len(BAR)
    for c in "xy":
        prev, n_prev, net = {}, None, []
        for b in BAR:
            now = {n: weights[c, b, n] for n in range(6) if (c, b, n) in weights}
            stay = sum(abs(now[n] - prev[n]) for n in now.keys() & prev.keys())
            move = sum(abs(now.get(n, 0) - prev.get(n, 0)) for n in now.keys() ^ prev.keys())
            gross = sum(x * (fwd[b, n] or 0) for n, x in now.items())
            r = got[c, b]
            assert (r.gross, r.selection, r.sizing, r.turnover, r.net) == pytest.approx((gross, move, stay, move + stay, gross - 0.001 * (move + stay)))
            assert (r.n_held, r.d_held) == (len(now), 0 if n_prev is None else abs(len(now) - n_prev))
            prev, n_prev = now, len(now)
            net.append(r.net)
        s = metrics.cost_summary(series.filter(series.cell == c), ["cell"]).first()
        assert s.net_sharpe == pytest.approx(statistics.mean(net) / statistics.stdev(net) * math.sqrt(52)) and s.n_bars == len(BAR)
        assert s.cost_bp == pytest.approx(0.001 * s.turnover * 52 * 1e4) and s.selection + s.sizing == pytest.approx(s.turnover)


def test_costs_of_a_book_that_never_holds_anything(spark):
    w = frame(spark, [("x", BAR[0], 1, 0.0)], "cell string, bar date, code long, w double")
    panel = frame(spark, [(b, 1, 0.1) for b in BAR], "bar date, code long, fwd double")
    s = metrics.cost_summary(book.attributed(w, panel), ["cell"]).first()
    assert (s.net_sharpe, s.turnover, s.sizing_share, s.cost_of_gross, s.held) == (0, 0, 0, None, 0)
    assert metrics.cost_summary(book.attributed(w, panel).limit(1), ["cell"]).collect() == []


@pytest.mark.parametrize("two", [False, True])
def test_the_buffer_rule_is_a_replay(spark, two):
    rng = random.Random(5)
    rows = [("b", bar, c, round(rng.uniform(0, 1), 1)) for i, bar in enumerate(BAR) for c in range(rng.randint(4, 9)) if i != 4]  # a bar without names
    got = defaultdict(set)
    held = hysteresis.replace_book(frame(spark, rows, "cell string, bar date, code long, alpha double"), frame(spark, [(b,) for b in BAR], "bar date"), 0.3, 0.5, ["cell"], "buffer", two)
    for r in held.collect():
        got[r.bar, r.side].add(r.code)
    long, short = set(), set()
    for bar in BAR:
        order = [c for _, c in sorted((-a, c) for _, b, c, a in rows if b == bar)]
        n = len(order)
        k = max(1, math.ceil(0.3 * n)) if n else 0
        k = min(k, n // 2) if two else k
        if not k:
            long, short = set(), set()
            continue
        x = min(n, math.ceil(1.5 * k))
        long = {c for i, c in enumerate(order) if i < k or (i < x and c in long)}
        short = {c for i, c in enumerate(reversed(order)) if i < k or (i < x and c in short)} if two else set()
        both = long & short
        long, short = long - both, short - both
        assert (got[bar, 1], got[bar, -1]) == (long, short)
    assert not got[BAR[4], 1]


def test_both_forms_of_the_buffer_rule_agree(spark):
    rng = random.Random(8)
    df = frame(spark, [("b", bar, c, round(rng.uniform(0, 1), 1)) for i, bar in enumerate(BAR) for c in range(10) if i != 4 and rng.random() < 0.8], "cell string, bar date, code long, alpha double")
    bars = frame(spark, [(b,) for b in BAR], "bar date")
    stream = hysteresis.replace_book(df, bars, 0.3, 0.5, ["cell"], "buffer")
    window = hysteresis.buffer_book(df.drop("cell"), 0.3, 0.5, bars)
    assert sorted((r.bar, r.code) for r in stream.collect()) == sorted((r.bar, r.code) for r in window.collect())


# --- files -----------------------------------------------------------------------------------------------------------


def states(df):
    return {r.code: r.state for r in df.collect()}


def test_files_by_code_are_kept_current(spark, tmp_path):
    at = str(tmp_path / "codes")
    d = frame(spark, [("a#1", BAR[1], 1.0), ("a#1", BAR[0], 2.0), ("007", BAR[0], 3.0)], "code string, date date, x double")
    wanted = frame(spark, [("a#1",), ("007",), ("none",)], "code string")
    assert states(files.refresh_by_code(d, at, "code", "date", LONG_AGO, wanted)) == {"a#1": "written", "007": "written", "none": "missing"}
    made = {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}
    assert states(files.refresh_by_code(d, at, "code", "date", LONG_AGO, wanted)) == {"a#1": "current", "007": "current", "none": "missing"}
    assert made == {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}
    # a new code alone is written, without those that were not asked for; then all of them, as the source is later
    more = d.union(frame(spark, [("new", BAR[0], 4.0), ("unasked", BAR[0], 5.0)], d.schema))
    assert states(files.refresh_by_code(more, at, "code", "date", LONG_AGO, wanted.union(frame(spark, [("new",)], "code string")))) == {"a#1": "current", "007": "current", "none": "missing", "new": "written"}
    assert made.items() <= {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}.items()
    assert states(files.refresh_by_code(d.withColumn("x", d.x * 10), at, "code", "date", LATER)) == {"a#1": "written", "007": "written"}
    rows = spark.read.schema("code string, date date, x double, stub string").parquet(at).collect()
    assert sorted((r.stub, r.x) for r in rows) == [("007", 30.0), ("a_1", 10.0), ("a_1", 20.0), ("new", 4.0)]
    assert states(files.refresh_by_code(d, at, "code", "date", LONG_AGO, force=True)) == {"a#1": "written", "007": "written"}
    assert states(files.refresh_by_code(d.limit(0), at, "code", "date", LATER, wanted)) == {"a#1": "missing", "007": "missing", "none": "missing"}
    assert spark.read.parquet(at).count() == 4


def test_when_a_table_changed(spark, tmp_path):
    (tmp_path / "t").mkdir()
    assert files.changed(spark, str(tmp_path / "t")) is None
    before = datetime.datetime.now(datetime.UTC).replace(tzinfo=None) - datetime.timedelta(seconds=2)
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert files.changed(spark, str(tmp_path / "t")).astimezone(datetime.UTC).replace(tzinfo=None) >= before


def test_versions_of_the_universe(spark, tmp_path):
    names = frame(spark, [(1, 0), (2, 0), (3, 1)], "code long, block int")
    universe.persist(names, frame(spark, [(BAR[0], 1), (BAR[1], 1), (BAR[1], 3)], "bar date, code long"), f"{tmp_path}/u")
    fixed, moving = (universe.load(spark, v, f"{tmp_path}/u") for v in ("static", "dynamic"))
    assert fixed.membership is None and sorted(map(tuple, fixed.names.collect())) == [(1, 0), (2, 0), (3, 1)]
    assert sorted(map(tuple, moving.names.collect())) == [(1, 0), (3, 1)] and moving.membership.count() == 3
    with pytest.raises(ValueError, match="no version 'v9'"):
        universe.load(spark, "v9", f"{tmp_path}/u")
    with pytest.raises(FileNotFoundError):
        universe.load(spark, "dynamic", f"{tmp_path}/nowhere")
    universe.persist(names, frame(spark, [(BAR[0], 9)], "bar date, code long"), f"{tmp_path}/untagged")
    universe.persist(names.union(frame(spark, [(1, 5)], names.schema)), frame(spark, [(BAR[0], 1)], "bar date, code long"), f"{tmp_path}/twice")
    for where, n in (("untagged", "9 has 0 blocks"), ("twice", "1 has 2 blocks")):
        with pytest.raises(ValueError, match=n):
            universe.load(spark, "dynamic", f"{tmp_path}/{where}")
        assert universe.load(spark, "static", f"{tmp_path}/{where}").membership is None


@pytest.mark.parametrize("kinds,overall", [(("pass", "pass"), "PASS"), (("pass", "edge"), "EDGE"), (("edge", "fail"), "FAIL")])
def test_verdict_files(spark, tmp_path, kinds, overall):
    results = frame(spark, [("b", "oos", 1.5, None), ("b", "is", 2.0, 1.0), ("a", "is", None, 1.0)], "book string, window string, sharpe double, decay double")
    files.write_verdict(spark, results, frame(spark, list(zip(("sharpe", "decay"), kinds, strict=True)), "metric string, grade string"), str(tmp_path))
    (text,) = [json.loads(line) for p in (tmp_path / "summary").glob("*.json") for line in p.read_text().splitlines()]
    grades = dict(zip(("sharpe", "decay"), kinds, strict=True))
    assert text == {"overall": overall, "per_metric": grades, "results": {"a": {"is": {"decay": 1.0}}, "b": {"is": {"sharpe": 2.0, "decay": 1.0}, "oos": {"sharpe": 1.5}}}}
    lines = [line for p in (tmp_path / "verdict").glob("*.txt") for line in p.read_text().splitlines()]
    assert lines[0] == f"OVERALL: {overall}" and sorted(lines[1:]) == sorted(f"{m}: {g}" for m, g in grades.items())
