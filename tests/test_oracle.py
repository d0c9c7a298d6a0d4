"""Every registered proxy against its DuckDB SQL on sf0.001 (same compare as the driver's t2)."""

import pytest

import __spark_entry__ as E
from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"partition_roundtrip"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in E._proxies.REGISTRY if n not in SLOW])
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SF, name)
    assert res["status"] in ("OK", "rows-only"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E._proxies.REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())  # every query of the library has oracle SQL
