"""Plan-shape checks: no window or shuffle collapses to one partition, filters reach the scan."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# global top-k reports (limit is the feature) end in a single-partition take
TOP_K = {"text_search", "catalog_stats"}
WRITES = {"partition_roundtrip", "partition_scan", "year_range_scan", "stream_upsert"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _unreduced_single_partition(plan: str) -> list[str]:
    """Single-partition exchanges not fed by a partial aggregate (a global
    aggregate ships one pre-reduced row per task, which is fine)."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if "partial_" not in child and "keys=[]" not in child:
                bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", [n for n in E._proxies.REGISTRY if n not in WRITES])
def test_no_single_partition_exchange(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    if name not in TOP_K:
        assert not _unreduced_single_partition(plan), plan


def test_planting_plan_shape(spark):
    df = E.queries()["planting_window"](spark, SF)
    plan = _plan(df)
    assert "Window" in plan and "SinglePartition" not in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_scan_pruning(spark):
    plan = _plan(E.queries()["sentinel_null"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    plan = _plan(E.queries()["price_unpivot"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
