"""Books over shared parts against the same books name by name."""

import datetime

import numpy as np
import pytest
from panelspark.operators import book


def test_parts_earn_and_trade_what_their_names_do(spark):
    rng = np.random.default_rng(5)
    bars = [datetime.date(1995, 1, 6) + datetime.timedelta(weeks=i) for i in range(12)]
    panel = [(b, c, float(rng.normal(0, 0.02)) if rng.random() > 0.1 else None) for b in bars for c in range(8)]
    fwd = {(b, c): x for b, c, x in panel}
    # names come and go, part 1 is empty at a bar
    names = [(c % 2, b, c, float(rng.random()), fwd[b, c]) for b in bars for c in range(8) if rng.random() > 0.3 and not (c % 2 and b == bars[5])]
    # books leave parts and come back; one holds nothing at all
    scale = [(p, g, b, float(rng.random()) if rng.random() > 0.25 else 0.0) for p in ("x", "y", "z") for g in (0, 1) for b in bars if (p, b) != ("z", bars[7])]
    scale += [("none", g, b, 0.0) for g in (0, 1) for b in bars]
    panel = spark.createDataFrame(panel, "bar date, code int, fwd double")
    n, s = spark.createDataFrame(names, "part int, bar date, code int, w double, fwd double"), spark.createDataFrame(scale, "cell string, part int, bar date, w double")
    w = n.withColumnRenamed("w", "v").join(s, ["part", "bar"]).selectExpr("cell", "bar", "code", "v * w AS w").filter("w <> 0")
    want = {(r.cell, r.bar): r for r in book.run_book(w, panel, ["cell"]).collect()}
    got = {(r.cell, r.bar): r for r in book.run_parts(n, s, panel, ["part"]).collect()}
    assert got.keys() == want.keys() and len(got) == 36
    for k, r in want.items():
        assert (got[k].gross, got[k].turnover, got[k].net, got[k].n_held) == (pytest.approx(r.gross, abs=1e-12), pytest.approx(r.turnover, abs=1e-12), pytest.approx(r.net, abs=1e-12), r.n_held)
