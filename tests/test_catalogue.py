"""Every query against its DuckDB oracle, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__
from stratabar.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR)
    names = sorted(got.columns)
    mine = sorted(tuple(shown(r[c]) for c in names) for r in got.collect())
    cursor = duck.execute(catalogue.ORACLES[name])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    assert mine == sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_feature_plan_has_one_exchange_on_symbol(spark):
    df = catalogue.frame(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # bars by (symbol, date), then windows by symbol
    assert "BatchEvalPython" not in plan and "ReadSchema" in plan


def test_stream_cusum_equals_batch(spark):
    rows = catalogue.QUERIES["stream_cusum"](spark, SF_DIR).toPandas()
    from stratabar.operators.online import cusum_run

    for _, g in rows.groupby("key"):
        g = g.sort_values("ts", kind="stable")
        declared, _ = cusum_run(g["z"].to_numpy(), 0.5, 5.0)
        assert (declared == g["declared"].to_numpy()).all()
