"""The probit in columns of its own against the one expression, and that a rank's score doesn't repeat its rank with every coefficient."""

from panelspark.functions.scalars import probit, with_probit
from panelspark.operators import ic
from pyspark.sql import functions as F


def test_same_bits(spark):
    u = spark.createDataFrame([(x,) for x in [None, -1.0, 0.0, 1.0, 2.0, 1e-300, 1e-9, 0.02425, 0.5, 0.97575, 1 - 0.02425, 1 - 1e-9, *[i / 997 for i in range(998)]]], "u double")
    both = with_probit(u, "u", "got").withColumn("want", probit("u"))
    assert both.columns == ["u", "got", "want"]
    assert all(r.got == r.want for r in both.collect())
    assert both.filter("got is not null").count() == 7 + 996


def test_a_score_uses_its_rank_once(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("bar"), "id", F.when(F.col("id") % 7 > 0, F.col("id") % 11).cast("double").alias("value"))
    scored = ic.gaussian_rank(df, "value", ["bar"])
    assert scored.columns == ["bar", "id", "value", "g_u", "g"]
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 6000
    assert all(r.same == r.g for r in scored.withColumn("same", probit("g_u")).collect())
