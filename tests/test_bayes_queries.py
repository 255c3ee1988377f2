"""nb_accuracy against its SQL; grams of rows are no longer generated one by one."""

import duckdb

from sievework.plans import catalog


def test_accuracy_is_sql_without_a_row_for_each_gram(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = catalog.queries()["nb_accuracy"](spark, sf)
    assert sorted(map(tuple, got.select("lang", "n", "hits").collect())) == sorted(con.execute(f"SELECT lang, n, hits FROM ({catalog.oracle_sql()['nb_accuracy']})").fetchall())
    assert "posexplode(concat" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "explode(concat" not in plan
