"""Scale guard: no registered query may plan a cartesian product, a nested-loop join, Python
evaluation or a single-partition exchange (everything through one task)."""

import pytest

from wattlens import catalog, session
from wattlens.sources import driver
from wattlens.sources.driver import DriverSymbols

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "Exchange SinglePartition"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_has_no_forbidden_operators(spark, name):
    plan = catalog.run(spark, name, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, f"{name}: {found}"


def _leaves(df):
    """The base relations of the optimised plan, by a column that only they have."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n")
    key = {"lineitem": "l_orderkey", "part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}
    return {t: sum(c in leaf for leaf in leaves) for t, c in key.items()}


ONE_PASS = ["ca_capacity", "capacity_by_region", "capacity_dense", "investment_by_region", "ca_investment", "capcosts_wide",
            "fom_costs_wide", "marginal_costs", "generation_report", "capacity_report", "dispatch_by_segment", "dispatch_clean",
            "storage_charge", "dispatch_hour_profile", "dispatch_window", "dispatch_deciles", "trade_by_segment", "trade_net",
            "fig_generation", "fig_capacity", "fig_peak_load", "fig_investment", "fig_investment_scenarios",
            "fig_cumulative_investment", "fig_capacity_scenarios", "fig_peak_load_scenarios", "map_long_name",
            "dispatch_deciles_scenarios", "trade_net_scenarios", "class_code_capacity"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_fact_tables_are_scanned_once(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if broadcast else "-1")
    try:
        for name in ONE_PASS:
            n = _leaves(catalog.run(spark, name, "/root/testdata/sf0.001"))
            assert n["lineitem"] == 1 and n["part"] <= 1 and n["orders"] <= 1, (name, n)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_storage_and_scenario_names_read_no_more_than_they_need(spark):
    sf = "/root/testdata/sf0.001"
    assert _leaves(catalog.run(spark, "storage_charge", sf))["part"] == 0
    assert _leaves(catalog.run(spark, "list_scenarios", sf)) == {"lineitem": 0, "part": 0, "orders": 0, "customer": 1, "events": 0}
    assert _leaves(catalog.run(spark, "emissions_rollup", sf))["orders"] == 1
    sym = DriverSymbols(spark, sf)
    for name in ("GC", "GR", "IGC", "IGR", "icg", "irg", "G", "GD"):
        assert _leaves(sym.get(name))["part"] == 0, name


HOURLY = [n for n in catalog.QUERIES if n in ("hydrogen_load", "ca_loads", "loads_filtered", "af_hour", "af_segment", "ca_hourly_mapping",
                                              "hourly_long", "net_load_hourly", "peak_capacity_factors", "duration_curve_load",
                                              "peak_capacity_factors_scenarios")]


@pytest.mark.parametrize("name", HOURLY)
def test_events_and_lines_are_scanned_once(spark, monkeypatch, name):
    """The checkpoints of the event cells and of their capacity read them; the rest of the plan doesn't."""
    cuts = []
    monkeypatch.setattr(driver, "cut_lineage", lambda df: cuts.append(_leaves(df)) or session.cut_lineage(df))
    n = _leaves(catalog.run(spark, name, "/root/testdata/sf0.001"))
    assert n["events"] == n["lineitem"] == 0
    assert sum(c["events"] for c in cuts) == 1 and sum(c["lineitem"] for c in cuts) <= 1


def test_years_outside_the_binding_are_an_error(spark):
    df = spark.createDataFrame([("1994-12-31",), ("1995-01-01",), (None,)], "d string").selectExpr("cast(d as timestamp) AS d")
    assert [r.y for r in df.where("d IS NULL OR year(d) = 1995").select(driver.model_year("d").alias("y")).collect()] == [1995, None]
    with pytest.raises(Exception, match="no model year"):
        df.select(driver.model_year("d")).collect()


def test_factors_and_capacity_have_unmatched_keys(spark):
    """The capacity join drops rows on both sides, as with real results."""
    sym = driver.DriverSymbols(spark, "/root/testdata/sf0.01")
    keys = ["tech_class", "vintage", "region", "year"]
    factors, capacity = sym.get("vrsc_8760").select(*keys).distinct(), sym.hourly_capacity().select(*keys)
    assert factors.join(capacity, keys).count() > 0
    assert factors.join(capacity, keys, "left_anti").count() > 0 and capacity.join(factors, keys, "left_anti").count() > 0
