"""End-to-end runs: symbol tables -> written marts -> statistics read back from the marts.

Writing the marts is also the lineage cut of the workflow (like the CSV hand-over between the
extraction and the statistics stages): the statistics jobs start from the written tables, which
survive executor loss, instead of from a long in-memory lineage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MART_ORDER
from ..sources.sinks import read_mart, write_mart
from ..sources.symbols import SymbolSource
from . import dispatch, hourly, marts
from .params import Params

# mart name -> job
MART_JOBS = {
    "capcosts_usd2024": marts.capcosts,
    "fom_costs_usd2024": marts.fom_costs,
    "marginal_costs_usd2024": marts.marginal_costs,
    "regional_emissions_mtco2": marts.emissions,
    "capacity_by_region_gw": marts.capacity_by_region,
    "ca_capacity": marts.ca_capacity,
    "investment_by_region_gw": marts.investment_by_region,
    "ca_investment": marts.ca_investment,
    "ca_loads": hourly.ca_loads,
    "ca_hourly_mapping": hourly.ca_hourly_mapping,
    "generation_twh": marts.generation_report,
    "capacity_gw": marts.capacity_report,
    "dispatch_by_segment_gwh": dispatch.dispatch_by_segment,
    "trade_gw": dispatch.trade_by_segment,
}


def build_marts(sym: SymbolSource, p: Params, out_root: str, names=None, fmt: str = "parquet") -> list[str]:
    """Write the marts (all, or ``names``) under ``out_root/<mart>``, each in the order of its keys
    (``schemas.MART_ORDER``); returns the paths. A source limited to some scenarios rewrites those only."""
    paths = []
    for name in (names or MART_JOBS):
        path = os.path.join(out_root, name)
        write_mart(MART_JOBS[name](sym, p), path, fmt=fmt, order_by=MART_ORDER[name], scenarios=getattr(sym, "selected", None))
        paths.append(path)
    return paths


def write_statistics(spark: SparkSession, mart_root: str, p: Params, out_root: str,
                     fmt: str = "parquet", out_fmt: str | None = None, names=None) -> list[str]:
    """Compute the statistics (all, or ``names``) from written marts and write each one (the peak-hour capacity
    factors in one order by type and year, as in the original output), in the marts' format or ``out_fmt``."""
    paths = []
    for name, df in statistics(spark, mart_root, p, fmt=fmt, names=names).items():
        path = os.path.join(out_root, name)
        write_mart(df, path, fmt=out_fmt or fmt, order_by=MART_ORDER.get(name))
        paths.append(path)
    return paths


#: Statistics on the hourly mapping, on its hour-by-segment table, on dispatch, on clean dispatch, and on trade.
_ON_MAPPING = {
    "capacity_factors_top_25": lambda m, p: hourly.peak_capacity_factors(hourly.peak_hours(m, p), p),
    "normalized_profile": lambda m, p: hourly.normalized_profile(hourly.net_load_hourly(m, p), p),
}
_ON_HOURS = {
    "monthly_comparison": hourly.monthly_comparison,
    "duration_curve_load": hourly.duration_curve_load,
    "duration_curve_solar": hourly.duration_curve_solar,
    "duration_curve_wind": hourly.duration_curve_wind,
}
_ON_DISPATCH = {
    "dispatch_hour_profile": lambda d, p: dispatch.dispatch_hour_profile(dispatch.dispatch_clean(d, p), p),
    "dispatch_deciles": dispatch.dispatch_deciles,
}
_ON_TRADE = {"trade_net": dispatch.trade_net}


def statistics(spark: SparkSession, mart_root: str, p: Params, fmt: str = "parquet", names=None) -> dict[str, DataFrame]:
    """Statistics jobs (all, or ``names``) over written marts (lazy DataFrames). Only the marts that they need are read."""
    def run(jobs, mart, table=lambda m: m):
        wanted = {n: fn for n, fn in jobs.items() if names is None or n in names}
        if not wanted:
            return {}
        source = table(read_mart(spark, os.path.join(mart_root, mart), mart, fmt=fmt))
        return {n: fn(source, p) for n, fn in wanted.items()}

    return (run(_ON_MAPPING, "ca_hourly_mapping")
            | run(_ON_HOURS, "ca_hourly_mapping", lambda m: hourly.hour_vs_segment(m, p))
            | run(_ON_DISPATCH, "dispatch_by_segment_gwh") | run(_ON_TRADE, "trade_gw"))
