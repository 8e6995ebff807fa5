"""Exact medians without a group's values in one aggregate."""

import numpy as np
import pytest
from panelspark.functions.stats import medians
from panelspark.plans import panel as P
from panelspark.queries import models
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("total", [False, True])
def test_medians_are_those_of_percentile(spark, total):
    rng = np.random.default_rng(9)
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -1e300, 1.0, 1.0 + 2**-52]
    rows = [(None if g == 3 else f"g{g}", float(v)) for g in range(4) for v in np.round(rng.normal(size=100 + g), 1 + g)]
    rows += [("odd", v) for v in odd] + [("one", -2.5), ("none", None), ("none", None), ("two", 1.0), ("two", None), ("two", 2.0), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = df.groupingSets([["g"], []] if total else [["g"]], "g").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.5)).alias("median"))
    got = medians(df, ["g"], "v", total)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_group_is_one_aggregate_of_its_values(spark):
    got = models.grouping_sets_median(spark, SMALL)
    assert "percentile" not in got._jdf.queryExecution().toString()
    j = models.rv_panel(spark, SMALL).join(P.instruments(spark, SMALL), "code")
    want = j.groupingSets([["block"], []], "block").agg(F.count("*").alias("n"), F.percentile("rv", F.lit(0.5)).alias("median"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
