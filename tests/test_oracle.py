"""Every registered query with an oracle must equal DuckDB at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.oracle import canon_duck, compare, duck
from tests.conftest import SF01

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF01)
    got = sdf.toPandas()
    rel = con.sql(ORACLES[name])
    exp = rel.df()
    problems = compare(got, exp)
    assert not problems, f"{name}: {problems}"
    duck_types = {c: canon_duck(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {c: {"timestamp_ntz": "timestamp"}.get(t, t) for c, t in sdf.dtypes}
    assert duck_types == spark_types, f"{name}: types differ"
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, f"{name}: cross join in plan"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns
