"""Ranks of names near the top alone, scores without a shuffle, and two sizings of one book."""

import datetime

import numpy as np
import pytest
from panelspark.functions.scalars import k_of
from panelspark.operators import book, hysteresis, ic
from panelspark.plans import panel as P
from panelspark.queries import studies
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def made(spark, odd=()):
    rng = np.random.default_rng(11)
    day, rows = datetime.date(1999, 1, 1), []
    for t in range(12):
        for c in range(80):
            if rng.random() > 0.1:
                a = float(np.round(rng.normal(), 1)) if c % 9 else None
                rows.append(("x" if c % 2 else "y", day + datetime.timedelta(weeks=t), c, a, float(rng.uniform(0.1, 1)), float(rng.normal()) if c % 7 else None))
        rows += [("odd", day + datetime.timedelta(weeks=t), 1000 + i, v, 0.5, 0.01) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "cell string, bar date, code int, alpha double, sigma double, fwd double").repartition(5)


@pytest.mark.parametrize("odd", [(1.0, 1.0, 1.0), (float("nan"), 1.0, 2.0, None), (float("inf"), -1.0, 3.0, 0.0), (None, None), (1e300, 1.0, 2.0, 3.0)])
def test_ranks_near_the_top_are_those_of_all(spark, odd):
    df = made(spark, odd)
    q = df.withColumn("q", F.when(F.col("cell") == "x", 0.1).otherwise(0.3)).withColumn("sizing", F.lit("inv_vol"))
    near = ic.near_top(q, ["cell", "bar"], k_of("n", F.col("q")), also=("q",))
    assert near.filter("cell = 'x'").count() < 0.5 * q.filter("cell = 'x'").count()
    key = lambda df: sorted((r.cell, r.bar, r.code, round(r.w, 12)) for r in df.collect())
    assert key(book.keyed_weights(q, cheap=True)) == key(book.keyed_weights(q))
    bands = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "band string, epsilon double")
    held = [hysteresis.replace_book(df, df, 0.2, F.col("epsilon"), ["cell", "band"], cells=bands, keep=("sigma",), cheap=c) for c in (True, False)]
    assert len({tuple(sorted(map(str, h.collect()))) for h in held}) == 1


def test_two_sizings_of_one_book(spark):
    df = made(spark).filter("not (cell = 'x' and bar = DATE'1999-02-05')")
    both = df.crossJoin(spark.createDataFrame([("eqw",), ("inv_vol",)], "sizing string")).withColumn("cell", F.concat_ws("|", "cell", "sizing"))
    raw = both.withColumn("alpha", F.lit(1.0)).withColumn("q", F.lit(1.0))
    want = book.run_book(book.keyed_weights(raw), df, ["cell"])
    got = {(r.cell, r.bar): r for r in book.run_sizings(df, df).collect()}
    rows = want.collect()
    assert len(rows) == len(got) == 4 * 12
    for r in rows:
        for c in ("gross", "turnover", "net"):
            assert got[r.cell, r.bar][c] == pytest.approx(r[c], abs=1e-12), (r.cell, r.bar, c)


def test_scores_shuffle_no_rows(spark):
    f = P.long_factors(P.panel(spark, SMALL))
    one = {(r.factor, r.bar, r.code): r.z for r in f.withColumn("z", ic.row_z(f)).collect()}
    two = ic.with_row_z(f)
    assert {(r.factor, r.bar, r.code): r.z is None and r.z or r.z for r in two.collect()} == pytest.approx(one, abs=1e-9, nan_ok=True)
    plan = studies.kept_within(spark, SMALL)[1]._jdf.queryExecution().toString()
    assert "Expand" not in plan
