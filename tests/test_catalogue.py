"""Every query with SQL gives the SQL's rows; the plans hold no product of tables."""

import math

import duckdb
import pytest

from docketlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(df):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "NaT":
            return "null"
        return f"{x:.5f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, db, sf_dir, name):
    ours, sql = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns) and shown(ours) == shown(sql)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_product_of_tables(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
