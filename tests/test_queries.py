"""Every core query against its SQL on the small tables; those without SQL must run with a stable schema."""

import glob
import os

import duckdb
import pytest
from compare import differences

from spindrift import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, data, name):
    columns, ours, theirs, _ = differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], data)
    assert columns and not ours and not theirs, (name, list(ours)[:3], list(theirs)[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_flagship_reads_only_what_it_needs(spark, data):
    plan = catalog.QUERIES[catalog.FLAGSHIP](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "ReadSchema: struct<item_id:bigint,text:string>" in plan
