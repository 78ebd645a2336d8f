import duckdb
import pytest

import __spark_entry__ as entry_module
from maskwell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cursor_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), names)


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    df = entry_module.entry(spark)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
