"""One name for each index as an ordered stream, and the dense panel without a join."""

import datetime

import numpy as np
from panelspark.operators import universe
from panelspark.plans import panel as P
from pyspark.sql import functions as F


def test_representatives_are_a_replay_by_streams(spark):
    rng = np.random.default_rng(8)
    rows = [(t, i, 10 * i + c, float(rng.integers(1, 9)) if rng.random() > 0.1 else None) for t in range(60) for i in range(3) for c in range(6) if rng.random() > 0.4 and (t, i) not in ((20, 1), (21, 1), (40, 2))]
    found = universe.representatives(spark.createDataFrame(rows, "day int, idx int, code int, adv double"), order="day", step=1)
    # an index isn't gathered as one group of all its rows
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want, held, last = {}, {}, {}
    for t, i in sorted({r[:2] for r in rows}):
        volume = {c: v or 0.0 for d, x, c, v in rows if (d, x) == (t, i)}
        best = max(volume, key=lambda c: (volume[c], -c))
        if t - last.get(i, t) > 1 or held.get(i) not in volume or volume[best] >= 1.25 * volume[held[i]]:
            held[i] = best
        last[i], want[t, i] = t, held[i]
    assert {(r.day, r.idx): r.code for r in found.collect()} == want


def test_dense_panel_is_the_grid(spark):
    sf_dir = "/root/testdata/sf0.001"
    c = P.cells(spark, sf_dir)
    dense = P.grid(c).join(c, ["bar", "code"], "left").select("bar", "code", F.col("n_rows").isNotNull().alias("obs"), F.coalesce("amount", F.lit(0).cast("long")).alias("amount"))
    got = P._panel(spark, sf_dir)
    assert sorted(map(tuple, got.select("bar", "code", "obs", "amount").collect())) == sorted(map(tuple, dense.collect()))
    assert got.agg(F.min("bar")).first()[0].weekday() == datetime.date(1995, 1, 6).weekday()
