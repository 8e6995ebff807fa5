"""The replace rule as a stream against a plain replay, over bars without names, both sides and both trims."""

import datetime
import math
import random

import pytest
from panelspark.operators import hysteresis as H

DAY = datetime.date(1990, 1, 5)


def replay(rows, bars, q, epsilon, trim, long_short):
    by = {}
    for bar, code, alpha in rows:
        by.setdefault(bar, []).append((-alpha, code))
    sides, out = (set(), set()), set()
    for bar in bars:
        order = [c for _, c in sorted(by.get(bar, []))]
        n = len(order)
        k = max(1, math.ceil(q * n)) if n else 0
        if long_short:
            k = min(k, n // 2)
        if not k:
            sides = (set(), set())
            continue
        x = min(n, math.ceil((1.0 + epsilon) * k))
        new = []
        for held, ranked in zip(sides, (order, order[::-1])):
            kept = [c for c in ranked[:x] if c in held]
            if trim == "worst_rank":
                kept = kept[:k]
            for c in ranked:
                if len(kept) >= k:
                    break
                if c not in kept:
                    kept.append(c)
            new.append(set(kept))
        both = new[0] & new[1] if long_short else set()
        sides = (new[0] - both, new[1] - both) if long_short else (new[0], set())
        out |= {(bar, c, 1) for c in sides[0]} | {(bar, c, -1) for c in sides[1]}
    return out


def ragged(seed, names=14, weeks=40):
    rnd = random.Random(seed)
    bars = [DAY + datetime.timedelta(weeks=i) for i in range(weeks)]
    rows = []
    for i, bar in enumerate(bars):
        some = [] if i % 9 == 4 else rnd.sample(range(names), rnd.choice([1, 2, 3, names // 2, names]))
        rows += [(bar, c, float(rnd.randrange(6))) for c in some]  # ties
    return bars, rows


@pytest.mark.parametrize("trim", ["as_published", "worst_rank"])
@pytest.mark.parametrize("long_short", [False, True])
@pytest.mark.parametrize("epsilon", [0.0, 0.5, 2.0])
def test_equals_replay(spark, trim, long_short, epsilon):
    sets = {b: ragged(b) for b in (1, 2, 3)}
    bars = spark.createDataFrame([(x,) for x in sets[1][0]], "bar date")
    df = spark.createDataFrame([(b, *r) for b, (_, rows) in sets.items() for r in rows], "book int, bar date, code long, alpha double")
    got = H.replace_book(df, bars, 0.3, epsilon, ["book"], trim, long_short).collect()
    assert len(got) == len(set(got))
    want = {(b, *r) for b, (every, rows) in sets.items() for r in replay(rows, every, 0.3, epsilon, trim, long_short)}
    assert {tuple(r) for r in got} == want and want
    alone = H.replace_book(df.filter("book = 2").drop("book"), bars, 0.3, epsilon, None, trim, long_short).collect()
    assert {tuple(r) for r in alone} == {r[1:] for r in want if r[0] == 2}


def test_a_bar_without_names_empties_the_book(spark):
    bars = [DAY + datetime.timedelta(weeks=i) for i in range(3)]
    rows = [(bars[0], c, -float(i)) for i, c in enumerate("abcdef")] + [(bars[2], c, -float(i)) for i, c in enumerate("cadbef")]
    df = spark.createDataFrame(rows, "bar date, code string, alpha double")
    got = {(r.bar, r.code) for r in H.replace_book(df, spark.createDataFrame([(b,) for b in bars], "bar date"), 1 / 3, 1.0).collect()}
    assert got == {(bars[0], "a"), (bars[0], "b"), (bars[2], "c"), (bars[2], "a")}


def test_batches_cut_bars(spark):
    bars, rows = ragged(5, names=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = H.replace_book(spark.createDataFrame(rows, "bar date, code long, alpha double"), spark.createDataFrame([(b,) for b in bars], "bar date"), 0.4, 0.5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == replay(rows, bars, 0.4, 0.5, "as_published", False)


def test_no_rows(spark):
    df = spark.createDataFrame([], "bar date, code long, alpha double")
    assert H.replace_book(df, df.select("bar"), 0.2, 0.3).collect() == []
