"""Every query of the panel engine runs; those with SQL give DuckDB's rows."""

import importlib
import sys

import pytest
from panelspark.queries import books, core, layers, models, reports, studies, sweeps

from .compare import connect, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"
MODULES = (core, models, books, layers, reports, studies, sweeps)
QUERIES, SQL = ({k: v for m in MODULES for k, v in getattr(m, n).items()} for n in ("Q", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


class Missing:
    """As if panelspark.llm and the pipeline were not there."""

    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("panelspark.llm"):
            raise ModuleNotFoundError(name, name=name)


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__

    try:
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("panelspark.llm")]:
                m.delitem(sys.modules, name)
            m.delattr("panelspark.llm", raising=False)
            m.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
            entry = importlib.reload(__spark_entry__)
            assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    finally:
        entry = importlib.reload(__spark_entry__)
    assert set(QUERIES) <= set(entry.queries())
    assert entry.oracle_sql().keys() <= entry.queries().keys()
