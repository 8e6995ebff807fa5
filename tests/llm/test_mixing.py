import duckdb
import pytest
from panelspark.llm import mixing as M


def rows(spark, sizes, clash=True):
    made, d = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            made.append((d, s, "t", 5))
            d += 1
    return spark.createDataFrame(made, "doc_id long, source string, q string, slot int")


@pytest.mark.parametrize("sizes", [{"a": 500, "b": 100, None: 40, "c": 7}, {"a": 33}, {str(i): 10 + i for i in range(30)}])
@pytest.mark.parametrize("temper", [0.0, 0.5, 1.0])
def test_less_than_one_block_off(spark, sizes, temper):
    df = rows(spark, sizes)
    block, slots = 4, 60
    out = M.schedule(df, block_rows=block, slots=slots, temper=temper).collect()
    assert len(out) == sum(sizes.values()) and {r.doc_id for r in out} == {r.doc_id for r in df.collect()}
    share = {r.source: r.q / r.total for r in M.targets(M.tempered(df, temper), slots).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9
    taken = sorted({(r.mix_slot, r.source) for r in out if r.in_mix}, key=lambda x: x[0])
    assert [t for t, _ in taken] == list(range(len(taken)))
    done = dict.fromkeys(sizes, 0)
    for t, s in taken:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * share[x]) < 1 for x in sizes)
    # the horizon is where a source has run out
    assert taken and any(done[s] == -(-n // block) for s, n in sizes.items())
    for s, n in sizes.items():
        places = sorted((r.mix_block, r.mix_place) for r in out if r.source == s)
        assert places == [(k // block, k % block) for k in range(n)]


def test_given_weights(spark):
    df = rows(spark, {"a": 50, "b": 50, "c": 50})
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("zz", 0.0)], "source string, weight double")
    out = M.schedule(df, w, block_rows=2, slots=8).collect()
    assert all(r.mix_slot is None and not r.in_mix for r in out if r.source == "c")
    # 3 of 4 go to a, 1 of 4 to b, one slot each before the rest is shared out
    taken = sorted({(r.mix_slot, r.source) for r in out if r.in_mix})
    assert sum(s == "a" for _, s in taken[:8]) in (5, 6)


def test_equals_sql(spark, tmp_path):
    df = rows(spark, {"a": 700, "b": 90, None: 300, "d": 1}).unionByName(rows(spark, {"a": 3}))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(M.OP10_SQL).fetchall()
    got = [tuple(r) for r in M.op10_mixing(spark, str(tmp_path)).select("doc_id", "source", "mix_block", "mix_place", "mix_slot", "in_mix").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_no_rows(spark):
    assert M.schedule(rows(spark, {"a": 3}).limit(0)).collect() == []
    assert M.select(rows(spark, {"a": 3})).columns == ["doc_id", "source", "q", "slot"]
