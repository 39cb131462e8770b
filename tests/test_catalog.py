"""Catalog queries against their SQL on the sample, and the entry points.

``compare.py`` does the same for every query; here a cross-section keeps the suite
quick.
"""

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from conftest import SAMPLE
from gatherline.plans.catalog import catalog
from oracles.queries import oracle

QUICK = [
    "s1_parse_crowd", "s4_quarantine", "s5_append_crowd", "s16_snapshot", "p6_unresolved_alerts", "p18_fan_zones",
    "j1_heatmap_stands", "j2_gate_density", "j3_nearby", "j6_exit_plans", "j9_zones_with_bands", "a1_crowd_buckets",
    "a8_order_totals", "w7_smoothed_density", "w8_run_means", "g2_all_routes", "g4_flow_forecasts", "r5_stream_buckets",
    "r11_orders", "r12_outcomes",
]


@pytest.fixture(scope="module")
def db():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    good, note = compare(spark, db, name, SAMPLE)
    assert good, note


def test_every_query_has_sql():
    assert catalog().keys() == oracle().keys()


def test_entry_points_hold_the_catalog():
    assert catalog().keys() <= entry_points.queries().keys()
    assert oracle().keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 1000 and "predicted_wait_5min" in df.columns


def test_parquet_scan_is_pruned(spark, data):
    """Two columns of a reading cost the source columns they come from, no more."""
    plan = data.queues.select("time", "stand_id")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema: "):].splitlines()[0]
    assert "value" not in schema and "props" not in schema


def test_history_pushes_its_time_bound(spark, data):
    from gatherline.operators import rollup
    from gatherline.plans.catalog import AS_OF

    raw = rollup.readings_for_history(data.crowd, AS_OF, 60)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "ts" in plan
