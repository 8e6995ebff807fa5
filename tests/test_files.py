"""Frozen tables that are checked, earlier books, replays; overwritten inputs."""

import datetime

import pytest
from panelspark.operators import cluster, files, metrics
from panelspark.plans import store
from panelspark.queries import models, reports

SMALL = "/root/testdata/sf0.001"
SCHEMA = "code bigint, year int, block int, rep bigint"
DAY = datetime.date(1990, 1, 5)


def written(tmp_path, text, name="t"):
    (tmp_path / name).mkdir()
    (tmp_path / name / "part.csv").write_text(text)
    return str(tmp_path / name)


def load(spark, path):
    return files.frozen(spark, path, SCHEMA, ["code", "year"], within=("rep", ["year", "block"]))


def test_a_frozen_table_is_taken_by_name(spark, tmp_path):
    at = written(tmp_path, "year,extra,code,rep,block\n1996,x,1,2,0\n1996,y,2,2,0\n1997,z,1,1,0\n")
    assert sorted(tuple(r) for r in load(spark, at).collect()) == [(1, 1996, 0, 2), (1, 1997, 0, 1), (2, 1996, 0, 2)]


@pytest.mark.parametrize(
    "text,error",
    [
        ("code,year,block\n1,1996,0\n", "no column rep"),
        ("code,year,block,rep\n", "no rows"),
        ("code,year,block,rep\n1,1996,,1\n", "nulls"),
        ("code,year,block,rep\n1,1996,0,1\n1,1996,1,1\n", "2 times"),
        ("code,year,block,rep\n1,1996,0,1\n2,1996,1,1\n", "a rep that is no code"),
    ],
)
def test_a_frozen_table_fails_loudly(spark, tmp_path, text, error):
    with pytest.raises(ValueError, match=error):
        load(spark, written(tmp_path, text))


def test_a_missing_frozen_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "nowhere"))


def test_frozen_books_are_those_of_the_clusters(spark):
    want = cluster.reps_only(models.eligible(spark, SMALL), cluster.refresh(models.cluster_rows(spark, SMALL)))
    got = reports.frozen_representatives(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_replay_finds_what_differs(spark):
    bars = [DAY + datetime.timedelta(weeks=i) for i in range(3)]
    a = [("x", bars[0], 0.1), ("x", bars[1], 0.2), ("y", bars[0], 0.1), ("z", bars[0], 1.0)]
    b = [("x", bars[0], 0.1), ("x", bars[1], 0.2), ("y", bars[0], 0.1), ("y", bars[1], 0.5), ("z", bars[0], 1.1)]
    x, y = (spark.createDataFrame(r, "cell string, bar date, net double") for r in (a, b))
    got = {r.cell: (r.n, r.missing, round(r.max_gap, 9), r.same) for r in files.replayed(x, y, "cell").collect()}
    assert got == {"x": (2, 0, 0.0, True), "y": (2, 1, 0.0, False), "z": (1, 0, 0.1, False)}


def test_anchors_that_are_not_there(spark, tmp_path):
    assert files.anchors(spark, {"a": str(tmp_path / "a")}).collect() == []


def test_stored_tables_notice_an_overwritten_file(spark, tmp_path):
    def write(n):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")

    def read():
        return store.stored(spark, str(tmp_path), "doubled", ("t",), lambda: spark.read.parquet(f"{tmp_path}/t.parquet").selectExpr("id * 2 as id")).count()

    write(3)
    assert read() == 3
    one = tmp_path / "one.parquet"
    spark.range(2).toPandas().to_parquet(one)
    at = {"n": 0}

    def again():
        at["n"] += 1
        return spark.read.parquet(str(one))

    assert store.stored(spark, str(tmp_path), "one", ("one",), again).count() == 2 == store.stored(spark, str(tmp_path), "one", ("one",), again).count()
    assert at["n"] == 1
    spark.range(5).toPandas().to_parquet(one)  # the same name, another length
    assert store.stored(spark, str(tmp_path), "one", ("one",), again).count() == 5 and at["n"] == 2


def test_strips(spark):
    df = spark.createDataFrame([(DAY + datetime.timedelta(weeks=i), float(i)) for i in range(4)], "bar date, net double")
    strips = [("a", "1990-01-05", "1990-01-06"), ("b", "1990-01-12", "1990-01-19")]
    got = {}
    for r in metrics.without(df, strips).collect():
        got.setdefault(r.strip, set()).add(r.net)
    assert got == {"none": {0, 1, 2, 3}, "a": {1, 2, 3}, "b": {0, 3}, "all": {3}}
