"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from siltlog.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    expected = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_range_is_in_order_and_limited(spark):
    got = [r["key"] for r in registry.queries()["range_limit"](spark, DATA).collect()]
    assert got == sorted(got) and len(got) == 25


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_filter_reaches_the_scan_side_of_the_last_writer(spark, tmp_path):
    from siltlog.operators import state

    spark.createDataFrame([(1, 0, 1, f"k{i}", "v", False) for i in range(10)], "seq long, pos int, ts long, key string, value string, deleted boolean").write.parquet(f"{tmp_path}/e")
    plan = state.live(spark.read.parquet(f"{tmp_path}/e").where("key = 'k3'"))._jdf.queryExecution().toString()
    assert "EqualTo(key,k3)" in plan


@pytest.mark.filterwarnings("ignore:.*is left out")
def test_entry_without_an_optional_library(monkeypatch):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("siltlog.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    found = __spark_entry__.queries()
    assert set(registry.queries()) <= set(found) and not [n for n in found if n.startswith("op3")]
    assert set(__spark_entry__.oracle_sql()) <= set(found)
