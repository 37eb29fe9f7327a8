import os

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, rows_by_name
from workload.more import ORACLES as MORE_ORACLES
from workload.oracles import ORACLES
from workload.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(SMALL, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, db, name):
    df = REGISTRY[name](spark, SMALL)
    cursor = db.execute({**ORACLES, **MORE_ORACLES}[name])
    want = rows_by_name([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_by_name(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry(spark).count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expansion_with_a_small_mapping_takes_few_shuffles(spark):
    plan = plan_of(REGISTRY["ge_compare"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") <= 6
    assert plan.count("BroadcastHashJoin") >= 4


def test_row_numbers_leave_the_compare_distributed(spark):
    plan = plan_of(REGISTRY["compare_keyed"](spark, SMALL))
    assert "Exchange hashpartitioning" in plan
    assert plan.count("SinglePartition") == plan.count("row-number-blocks")  # one row per written part
