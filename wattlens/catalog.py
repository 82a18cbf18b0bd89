"""Registry of the jobs bound to the driver tables, used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import oracle
from .plans import dispatch, figures, hourly, marts, pipeline
from .session import scratch_path
from .sources.driver import DriverSymbols, driver_params
from .sources.sinks import plain, read_mart
from .sources.symbols import ParquetSymbols, scan_multi_file, write_symbols

#: Digits kept of the columns in ``oracle.ROUNDED``; all others are exact.
ROUND_DIGITS = 6


def _marts(fn, with_scenario: bool = False, codes: bool = False):
    def run(spark, sf_dir):
        sym = DriverSymbols(spark, sf_dir, with_scenario=with_scenario, codes=codes)
        return fn(sym, driver_params(sym))
    return run


def _hourly_symbols(spark, sf_dir, with_scenario: bool = False):
    sym = DriverSymbols(spark, sf_dir, with_scenario=with_scenario)
    return sym.override(XC=sym.hourly_capacity), driver_params(sym)


def _hourly(fn):
    def run(spark, sf_dir):
        return fn(*_hourly_symbols(spark, sf_dir))
    return run


def _folder(spark, kind: str) -> str:
    return scratch_path(spark, f"{kind}-{uuid.uuid4().hex}")


def _stored(fn, names, scenarios=oracle.STORED_SCENARIOS):
    """Jobs on symbols that are first stored in raw form, with a folder for each scenario, and scanned from there."""
    def run(spark, sf_dir):
        source = DriverSymbols(spark, sf_dir, with_scenario=True)
        root = _folder(spark, "symbols")
        write_symbols(source, names, root)
        return fn(ParquetSymbols(spark, root, scenarios).override(hrep=lambda: source.get("hrep")), driver_params(source))
    return run


def _scan_multi_file(spark, sf_dir):
    """Loads on an hour map of one stored file for each year, whose year only the file's name gives."""
    sym, p = _hourly_symbols(spark, sf_dir)
    root = _folder(spark, "hours")
    paths = [os.path.join(root, f"hour_map_{year}") for year in p.years]
    for year, path in zip(p.years, paths, strict=True):
        sym.base.raw_hrep(year).drop("t").write.parquet(path)
    hours = scan_multi_file(spark, paths, "hrep", key="year", pattern=r"hour_map_(\d{4})")
    return hourly.ca_loads(sym.override(hrep=lambda: hours), p)


def _mart_round_trip(name: str, fmt: str):
    """A mart of all scenarios, its labels found in the data, written by the sink and read back."""
    def run(spark, sf_dir):
        sym = DriverSymbols(spark, sf_dir, with_scenario=True)
        root = _folder(spark, "marts")
        pipeline.build_marts(sym, driver_params(sym).with_(vintages=None, pivot_years=None), root, [name], fmt=fmt)
        return read_mart(spark, os.path.join(root, name), name, fmt)
    return run


def _statistics_round_trip(spark, sf_dir):
    """Peak-hour factors computed from a written mapping mart, written as CSV in their order and read back."""
    sym, p = _hourly_symbols(spark, sf_dir)
    root, out, name = _folder(spark, "marts"), _folder(spark, "statistics"), "capacity_factors_top_25"
    pipeline.build_marts(sym, p, root, ["ca_hourly_mapping"])
    pipeline.write_statistics(spark, root, p, out, fmt="parquet", out_fmt="csv", names=[name])
    return read_mart(spark, os.path.join(out, name), name, "csv")


def _mapping(fn):
    """Statistics on the hourly mapping mart."""
    def run(spark, sf_dir):
        sym, p = _hourly_symbols(spark, sf_dir)
        return fn(hourly.ca_hourly_mapping(sym, p), p)
    return run


def _net(fn, with_scenario: bool = False):
    def run(spark, sf_dir):
        sym, p = _hourly_symbols(spark, sf_dir, with_scenario)
        return fn(hourly.net_load_hourly(hourly.ca_hourly_mapping(sym, p), p), p)
    return run


def _peak(with_scenario: bool = False):
    def run(spark, sf_dir):
        sym, p = _hourly_symbols(spark, sf_dir, with_scenario)
        return hourly.peak_capacity_factors(hourly.peak_hours(hourly.ca_hourly_mapping(sym, p), p), p)
    return run


def _ts(fn):
    def run(spark, sf_dir):
        sym, p = _hourly_symbols(spark, sf_dir)
        return fn(hourly.hour_vs_segment(hourly.ca_hourly_mapping(sym, p), p), p)
    return run


def _dispatch(fn, clean: bool = False, with_scenario: bool = False, symbols=dispatch.DISPATCH_SYMBOLS):
    def run(spark, sf_dir):
        sym = DriverSymbols(spark, sf_dir, with_scenario=with_scenario)
        p = driver_params(sym)
        d = dispatch.dispatch_by_segment(sym, p, symbols)
        return fn(dispatch.dispatch_clean(d, p) if clean else d, p)
    return run


def _trade(fn, with_scenario: bool = False):
    def run(spark, sf_dir):
        sym = DriverSymbols(spark, sf_dir, with_scenario=with_scenario)
        p = driver_params(sym)
        return fn(dispatch.trade_by_segment(sym, p), p)
    return run


def _loads_filtered(sym, p):
    return hourly.ca_loads(sym, p).where(F.col("year") != p.base_year)


def _long_names(spark, sf_dir):
    sym = DriverSymbols(spark, sf_dir)
    return figures.map_long_name(sym.report_labels(), driver_params(sym))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ca_capacity": _marts(marts.ca_capacity),
    "capacity_by_region": _marts(marts.capacity_by_region),
    "capacity_dense": _marts(marts.capacity_dense),
    "investment_by_region": _marts(marts.investment_by_region),
    "ca_investment": _marts(marts.ca_investment),
    "capcosts_wide": _marts(marts.capcosts_wide),
    "fom_costs_wide": _marts(marts.fom_costs_wide),
    "marginal_costs": _marts(marts.marginal_costs),
    "emissions_rollup": _marts(marts.emissions_rollup),
    "generation_report": _marts(marts.generation_report),
    "capacity_report": _marts(marts.capacity_report),
    # hourly marts and statistics
    "hydrogen_load": _hourly(hourly.hydrogen_load),
    "ca_loads": _hourly(hourly.ca_loads),
    "loads_filtered": _hourly(_loads_filtered),
    "af_hour": _hourly(hourly.af_hour),
    "af_segment": _hourly(hourly.af_segment),
    "ca_hourly_mapping": _hourly(hourly.ca_hourly_mapping),
    "hourly_long": _mapping(lambda m, p: hourly.hourly_long(m)),
    "net_load_hourly": _mapping(hourly.net_load_hourly),
    "normalized_profile": _net(hourly.normalized_profile),
    "peak_capacity_factors": _peak(),
    "hour_vs_segment": _mapping(hourly.hour_vs_segment),
    "monthly_comparison": _ts(hourly.monthly_comparison),
    "duration_curve_load": _ts(hourly.duration_curve_load),
    "duration_curve_solar": _ts(hourly.duration_curve_solar),
    "duration_curve_wind": _ts(hourly.duration_curve_wind),
    # dispatch and trade
    "dispatch_by_segment": _dispatch(lambda d, p: d),
    "dispatch_clean": _dispatch(lambda d, p: d, clean=True),
    "storage_charge": _dispatch(dispatch.storage_charge, symbols=("G",)),
    "dispatch_hour_profile": _dispatch(dispatch.dispatch_hour_profile, clean=True),
    "dispatch_window": _dispatch(dispatch.dispatch_window, clean=True),
    "dispatch_deciles": _dispatch(dispatch.dispatch_deciles),
    "trade_by_segment": _trade(lambda t, p: t),
    "trade_net": _trade(dispatch.trade_net),
    # figure tables
    "fig_generation": _marts(figures.fig_generation),
    "fig_capacity": _marts(figures.fig_capacity),
    "fig_peak_load": _marts(figures.fig_peak_load),
    "fig_investment": _marts(figures.fig_investment),
    "fig_investment_scenarios": _marts(figures.fig_investment, with_scenario=True),
    "fig_cumulative_investment": _marts(figures.fig_cumulative_investment, with_scenario=True),
    "fig_capacity_scenarios": _marts(figures.fig_capacity_scenarios, with_scenario=True),
    "fig_peak_load_scenarios": _marts(figures.fig_peak_load_scenarios, with_scenario=True),
    "list_scenarios": _marts(lambda sym, p: figures.list_scenarios(sym), with_scenario=True),
    "map_long_name": _long_names,
    # the model's own class codes, report classes and labels
    "class_code_capacity": _marts(marts.ca_capacity, codes=True),
    "report_code_generation": _marts(marts.generation_report, codes=True),
    "long_label_value": _marts(lambda sym, p: figures.map_long_name(sym.report_labels(), p), codes=True),
    # hourly, dispatch and trade statistics of every scenario at once
    "normalized_profile_scenarios": _net(hourly.normalized_profile, with_scenario=True),
    "peak_capacity_factors_scenarios": _peak(with_scenario=True),
    "dispatch_deciles_scenarios": _dispatch(dispatch.dispatch_deciles, with_scenario=True),
    "trade_net_scenarios": _trade(dispatch.trade_net, with_scenario=True),
    # stored symbols, marts and statistics
    "scan_symbol": _stored(lambda sym, p: sym.get("XC"), ["XC"]),
    "stored_ca_capacity": _stored(marts.ca_capacity, ["cal_r", "XC", "GC", "GR"]),
    "stored_dispatch_without_optional": _stored(dispatch.dispatch_by_segment, ["cal_r", "X", "G", "GD"]),
    "stored_list_scenarios": _stored(lambda sym, p: figures.list_scenarios(sym), ["IX"], None),
    "scan_multi_file": _scan_multi_file,
    "mart_csv_fom_costs": _mart_round_trip("fom_costs_usd2024", "csv"),
    "mart_csv_capcosts": _mart_round_trip("capcosts_usd2024", "csv"),
    "mart_parquet_capacity": _mart_round_trip("capacity_by_region_gw", "parquet"),
    "statistics_csv_peak_factors": _statistics_round_trip,
}


def result(name: str, df: DataFrame) -> DataFrame:
    """The job's result: exact sums as DOUBLE, and rounded means and shares of inexact numbers (-0.0 is 0.0)."""
    rounded = oracle.ROUNDED.get(name, [])
    cols = []
    for f in plain(df).schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = ((F.round(c, ROUND_DIGITS) if f.name in rounded else c) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return plain(df).select(*cols)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return result(name, QUERIES[name](spark, sf_dir))


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in QUERIES:
        sql = oracle.QUERIES[name]()
        rounded = oracle.ROUNDED.get(name, [])
        columns = [f'round("{c}", {ROUND_DIGITS}) + 0.0 AS "{c}"' if c in rounded else f'CAST("{c}" AS DOUBLE) + 0.0 AS "{c}"'
                   for c in oracle.DOUBLE_COLUMNS.get(name, [])]
        out[name] = f"SELECT * REPLACE ({', '.join(columns)}) FROM (\n{sql}\n)" if columns else sql
    return out
