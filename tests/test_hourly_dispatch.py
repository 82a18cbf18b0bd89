import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import dispatch_symbols, hourly_symbols
from wattlens.plans import dispatch, hourly
from wattlens.plans.params import Params

P = Params()


@pytest.fixture(scope="module")
def mapping(spark):
    return hourly.ca_hourly_mapping(hourly_symbols(spark), P).cache()


def test_loads_dense_on_hour_map(spark):
    sym = hourly_symbols(spark)
    assert rows(hourly.hydrogen_load(sym, P)) == [(2025, "s1", 1.0)]
    assert rows(hourly.ca_loads(sym, P)) == [(2025, 1, "s1", 15.0, 12.0, 1.0), (2025, 2, "s1", 3.0, 12.0, 1.0),
                                             (2025, 3, "s2", 20.0, 30.0, 0.0)]
    strict = hourly.ca_loads(sym, P.with_(dense=False))
    assert rows(strict.select("hour")) == [(1,), (2,)]


def test_availability_factors(spark):
    sym = hourly_symbols(spark)
    af = {(r.tech, r.hour): r for r in hourly.af_hour(sym, P).collect()}
    assert len(af) == 9
    assert (af["Solar", 1].generation_h, af["Solar", 1].capacity, af["Solar", 1].af_h) == (1.0, 2.0, 0.5)
    assert af["Solar", 2].af_h == pytest.approx(0.3)
    # zero capacity: the capacity-weighted factor falls back to the plain mean
    assert (af["Wind", 1].capacity, af["Wind", 1].af_h) == (0.0, 0.8)
    assert (af["Offshore Wind", 3].generation_h, af["Offshore Wind", 3].af_h) == (0.2, 0.2)
    assert af["Offshore Wind", 1].af_h is None and af["Offshore Wind", 1].generation_h == 0.0
    seg = {(r.tech, r.segment): r for r in hourly.af_segment(sym, P).collect()}
    assert seg["Solar", "s1"].af_s == 0.4 and seg["Wind", "s2"].af_s == 0.6 and len(seg) == 6


def test_hourly_mapping(mapping):
    assert mapping.columns == ["tech", "year", "hour", "generation_h", "capacity", "af_h", "segment",
                               "generation_s", "af_s", "load_h", "load_s", "hydrogen_load"]
    got = {(r.tech, r.hour): tuple(r) for r in mapping.collect()}
    assert len(got) == 9  # duplicated hour-map row removed
    assert got["Solar", 1] == ("Solar", 2025, 1, 1.0, 2.0, 0.5, "s1", 0.8, 0.4, 15.0, 12.0, 1.0)
    assert got["Wind", 3] == ("Wind", 2025, 3, 0.0, 0.0, 0.0, "s2", 0.0, 0.6, 20.0, 30.0, 0.0)


def test_hourly_long(mapping):
    long = hourly.hourly_long(mapping)
    assert long.columns == ["tech", "year", "hour", "segment", "hydrogen_load", "type", "aggregation", "value"]
    assert long.count() == 8 * 9
    got = {(r.tech, r.hour, r.type, r.aggregation): r.value for r in long.collect()}
    assert got["Solar", 1, "load", "hour"] == 16.0 and got["Solar", 1, "load", "segment"] == 13.0
    assert got["Solar", 1, "capacity", "segment"] == 2.0


def test_net_load_rank_and_peak_factors(mapping):
    net = hourly.net_load_hourly(mapping, P)
    g = {r.hour: r for r in net.where(F.col("type") == "generation").collect()}
    assert (g[1].load, g[1].net_load, g[2].net_load, g[3].net_load) == (16.0, 15.0, pytest.approx(3.4), 19.8)
    assert (g[3].order_id, g[1].order_id, g[2].order_id) == (1.0, 2.0, 3.0)
    assert net.count() == 9 and {r.type for r in net.collect()} == {"generation", "capacity", "af"}
    peak = {r.type: r for r in hourly.peak_capacity_factors(net, P.with_(top_k=2)).collect()}
    gen = peak["generation"]
    assert (gen.load, gen.net_load, gen.solar, gen.wind) == (18.0, pytest.approx(17.4), 0.5, 0.0)
    assert gen.offshore_wind == pytest.approx(0.1)
    assert peak["af"].solar == 0.25


def test_normalized_profile(mapping):
    prof = hourly.normalized_profile(hourly.net_load_hourly(mapping, P), P)
    got = {(r.hour_of_day, r.type): r.value for r in prof.collect()}
    assert got[0, "Load"] == 16.0 / 20.0 and got[2, "Net Load"] == pytest.approx(19.8 / 20.0)
    assert got[1, "Net Load"] == pytest.approx(3.4 / 20.0)


def test_hour_vs_segment_and_duration_curves(mapping):
    ts = hourly.hour_vs_segment(mapping, P)
    got = {(r.hour, r.aggregation): r for r in ts.collect()}
    assert len(got) == 6
    h1 = got[1, "hour"]
    assert (h1.Solar, h1.Wind, h1["Offshore Wind"], h1.Load, h1.month_name, h1.hour_of_day) == (0.5, 0.8, 0.0, 16.0, "Jan", 0)
    assert got[1, "segment"].Load == 13.0 and got[1, "segment"].Solar == 0.4
    curve = hourly.duration_curve_load(ts, P).where(F.col("aggregation") == "hour")
    # hour 2 (load 4 <= 5) removed after numbering: positions 1, 2 stay, 3 is gone
    assert rows(curve.select("hour", "order_hour")) == [(1, 2), (3, 1)]
    monthly = hourly.monthly_comparison(ts, P)
    assert {(r.aggregation, r.month_name) for r in monthly.collect()} == {("hour", "Jan"), ("segment", "Jan")}


def test_dispatch_and_trade(spark):
    sym = dispatch_symbols(spark)
    d = dispatch.dispatch_by_segment(sym, P).cache()
    assert d.columns == ["tech", "year", "segment", "level", "hour"]
    assert d.count() == 6 * 2  # six technologies on segment s1, which has two hours
    clean = dispatch.dispatch_clean(d, P)
    assert rows(clean.select("tech", "tech_order").distinct()) == [("Nuclear", 14), ("Solar", 2), ("Storage", 1),
                                                                  ("Wind", 3)]
    assert rows(dispatch.storage_charge(d, P)) == [(2025, "s1", 1, 0.5), (2025, "s1", 2, 0.5)]
    assert dispatch.dispatch_hour_profile(clean, P).count() == 8
    assert dispatch.dispatch_window(clean, P.with_(window_year=2025, window_hours=1)).count() == 4
    dec = {(r.tech, r.gen_ntile): r for r in dispatch.dispatch_deciles(d, P).collect()}
    assert dec["Solar", 1].pct_gen == pytest.approx(2.0 / 6.7) and dec["Storage", 2].generation == 0.7
    shares = {}
    for (t, n), r in dec.items():
        shares[n] = shares.get(n, 0.0) + r.pct_gen
    assert all(v == pytest.approx(1.0) for v in shares.values())
    tr = dispatch.trade_by_segment(sym, P)
    assert rows(tr.where(F.col("hour") == 1)) == [(2025, "s1", "ca", "ca", 2.0, 1), (2025, "s1", "ca", "rest_of_wecc", 1.0, 1),
                                                  (2025, "s1", "rest_of_wecc", "ca", 8.0, 1)]
    assert rows(dispatch.trade_net(tr, P)) == [(2025, 1, 8.0, 1.0, 7.0), (2025, 2, 8.0, 1.0, 7.0)]


def test_scenarios_with_shared_hour_map_loads_and_factors(spark):
    """Capacity and hydrogen per scenario; hour map, loads and factors shared: every scenario
    gets its own dense hourly mapping (no rows with a NULL scenario, no mixing)."""
    from wattlens.sources.symbols import FrameSymbols
    base = hourly_symbols(spark).frames
    frames = dict(base)
    frames["XC"] = (base["XC"].withColumn("scenario", F.lit("a"))
                    .unionByName(base["XC"].withColumn("level", F.col("level") * 2).withColumn("scenario", F.lit("b"))))
    frames["dspsrpt_r"] = base["dspsrpt_r"].withColumn("scenario", F.lit("a"))
    sym = FrameSymbols(spark, frames)
    m = hourly.ca_hourly_mapping(sym, P)
    got = {(r.scenario, r.tech, r.hour): r for r in m.collect()}
    assert len(got) == 18 and all(k[0] in ("a", "b") for k in got)
    assert (got["a", "Solar", 1].generation_h, got["b", "Solar", 1].generation_h) == (1.0, 2.0)
    assert (got["a", "Solar", 1].hydrogen_load, got["b", "Solar", 1].hydrogen_load) == (1.0, 0.0)
    assert got["b", "Wind", 3].load_h == 20.0
    loads = hourly.ca_loads(sym, P)
    assert rows(loads.select("scenario").distinct()) == [("a",), ("b",)] and loads.count() == 6


def test_mart_layouts_match_registry(spark):
    from fixtures import capacity_symbols
    from wattlens.plans import marts
    from wattlens.schemas import MARTS
    cap, hs, ds = capacity_symbols(spark), hourly_symbols(spark), dispatch_symbols(spark)
    jobs = {
        "capacity_by_region_gw": marts.capacity_by_region(cap, P),
        "ca_capacity": marts.ca_capacity(cap, P),
        "investment_by_region_gw": marts.investment_by_region(cap, P),
        "ca_investment": marts.ca_investment(cap, P),
        "marginal_costs_usd2024": marts.marginal_costs(cap, P),
        "generation_twh": marts.generation_report(cap, P),
        "capacity_gw": marts.capacity_report(cap, P),
        "ca_loads": hourly.ca_loads(hs, P),
        "ca_hourly_mapping": hourly.ca_hourly_mapping(hs, P),
        "dispatch_by_segment_gwh": dispatch.dispatch_by_segment(ds, P),
        "trade_gw": dispatch.trade_by_segment(ds, P),
        "capacity_factors_top_25": hourly.peak_capacity_factors(
            hourly.net_load_hourly(hourly.ca_hourly_mapping(hs, P), P), P),
    }
    assert set(jobs) == set(MARTS)
    for name, df in jobs.items():
        assert df.columns == [c for c, _ in MARTS[name]], name
        assert [f.dataType for f in df.schema.fields] == [t for _, t in MARTS[name]], name


def test_strict_mode_missing_generation_ranks_last(spark):
    """dense=False: without Offshore Wind rows the net load is missing (R arithmetic); the
    missing values are ranked after all others, one rank each, in hour order."""
    sp = P.with_(dense=False)
    net = hourly.net_load_hourly(hourly.ca_hourly_mapping(hourly_symbols(spark), sp), sp)
    g = rows(net.where(F.col("type") == "generation").select("hour", "net_load", "order_id"))
    assert g == [(1, None, 1.0), (2, None, 2.0)]


def test_dense_grid_only_for_observed_technologies(spark):
    """A renewable technology with no hourly availability/capacity rows gets no hourly rows
    (pandas emits only observed values of a text key); the mapping keeps techs present in both
    the hourly and the segment factors."""
    from wattlens.sources.symbols import FrameSymbols
    frames = dict(hourly_symbols(spark).frames)
    frames["vrsc_8760"] = frames["vrsc_8760"].where(~F.col("uni").startswith("wnos"))
    sym = FrameSymbols(spark, frames)
    assert {r.tech for r in hourly.af_hour(sym, P).collect()} == {"Solar", "Wind"}
    assert {r.tech for r in hourly.af_segment(sym, P).collect()} == {"Solar", "Wind", "Offshore Wind"}
    assert {r.tech for r in hourly.ca_hourly_mapping(sym, P).collect()} == {"Solar", "Wind"}


def test_hour_map_is_a_set(spark):
    """A repeated row of the hour map counts once in every job."""
    from wattlens.sources.symbols import FrameSymbols
    frames = dict(dispatch_symbols(spark).frames)
    frames["hrep"] = frames["hrep"].unionByName(frames["hrep"])
    twice = FrameSymbols(spark, frames)
    assert rows(dispatch.dispatch_by_segment(twice, P)) == rows(dispatch.dispatch_by_segment(dispatch_symbols(spark), P))
    assert rows(dispatch.trade_by_segment(twice, P)) == rows(dispatch.trade_by_segment(dispatch_symbols(spark), P))


def test_a_missing_flow_makes_its_sum_missing(spark):
    t = spark.createDataFrame([(2025, "s1", "rest", "ca", None, 1), (2025, "s1", "ca", "rest", 2.0, 1), (2025, "s1", "rest", "ca", 3.0, 2)],
                              "year int, segment string, region_exp string, region_imp string, trade_gw double, hour int")
    assert rows(dispatch.trade_net(t, P)) == [(2025, 1, None, 2.0, None), (2025, 2, 3.0, 0.0, 3.0)]


def test_storage_charge_needs_its_symbol_only(spark):
    from wattlens.sources.symbols import FrameSymbols
    frames = {k: v for k, v in dispatch_symbols(spark).frames.items() if k in ("G", "cal_r", "hrep")}
    d = dispatch.dispatch_by_segment(FrameSymbols(spark, frames), P, symbols=["G"])
    assert rows(dispatch.storage_charge(d, P)) == [(2025, "s1", 1, 0.5), (2025, "s1", 2, 0.5)]
