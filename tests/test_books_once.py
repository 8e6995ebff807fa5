"""Books of many cells share what they have in common: ranks by cells, and a series that is worked out once."""

import datetime

import pytest
from panelspark.operators import book
from panelspark.operators import hysteresis as H
from pyspark.sql import functions as F

from .test_hysteresis import ragged, replay


@pytest.mark.parametrize("trim", ["as_published", "worst_rank", "buffer"])
@pytest.mark.parametrize("long_short", [False, True])
@pytest.mark.parametrize("batch", ["2", "10000"])
def test_cells_share_ranks(spark, trim, long_short, batch):
    bars, rows = ragged(7)
    days = spark.createDataFrame([(b,) for b in bars], "bar date")
    df = spark.createDataFrame([(*r, f"x{r[1]}") for r in rows], "bar date, code long, alpha double, extra string")
    grid = [("a", 0.2, 0.0), ("b", 0.3, 0.5), ("c", 0.5, 2.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = H.replace_book(df, days, F.col("q"), F.col("epsilon"), ["cell"], trim, long_short, spark.createDataFrame(grid, "cell string, q double, epsilon double"), ("extra",))
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and all(r.extra == f"x{r.code}" for r in got)
    for cell, q, epsilon in grid:
        mine = {(r.bar, r.code, r.side) for r in got if r.cell == cell}
        if trim == "buffer":
            alone = H.replace_book(df, days, q, epsilon, None, trim, long_short).collect()
            assert mine == {tuple(r) for r in alone} and mine
        else:
            assert mine == replay(rows, bars, q, epsilon, trim, long_short) and mine


def test_series_are_worked_out_once(spark):
    bars = [datetime.date(1996, 1, 5) + datetime.timedelta(7 * i) for i in range(4)]
    p = spark.createDataFrame([(b, c, 0.01 * c) for b in bars for c in range(3)], "bar date, code long, fwd double")
    w = spark.createDataFrame([("a", bars[0], 1, 1.0), ("a", bars[1], 2, 1.0), ("b", bars[2], 1, 0.5)], "cell string, bar date, code long, w double")
    series, parts = book.run_book(w, p, ["cell"]), book.attributed(w, p)
    for df in (series, parts):
        # what names earn is in a table by then: neither side of the last join goes over their changes again
        assert "explode" not in df._jdf.queryExecution().toString() and df.count() == 8
    got = {(r.cell, r.bar): (round(r.gross, 6), r.turnover, r.n_held) for r in series.collect()}
    assert [got["a", b] for b in bars] == [(0.01, 0.0, 1), (0.02, 2.0, 1), (0.0, 1.0, 0), (0.0, 0.0, 0)]
    assert [got["b", b] for b in bars] == [(0.0, 0.0, 0), (0.0, 0.0, 0), (0.005, 0.5, 1), (0.0, 0.5, 0)]
