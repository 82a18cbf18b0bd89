"""Figure tables: the data behind the generation, capacity and investment figures, for one or
many scenarios (scenario is a column; selecting scenarios is a partition filter)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import na_sum
from ..functions.scalar import ordered_tech, recode_if, tech_order
from ..lookups import storage_label
from ..operators.aggregate import scen_keys, sum_by
from ..operators.filters import not_in_keep_null
from ..operators.lookup import apply_lookup
from ..sources.symbols import SymbolSource
from . import marts
from .params import Params


def _ordered(df: DataFrame, p: Params) -> DataFrame:
    return df.withColumns({"tech_order": tech_order("tech", p.tech_order),
                           "tech": ordered_tech("tech", p.tech_order)})


def select_scenarios(df: DataFrame, p: Params) -> DataFrame:
    if p.scenarios is None or "scenario" not in df.columns:
        return df
    return df.where(F.col("scenario").isin(p.scenarios))


def fig_generation(sym: SymbolSource, p: Params) -> DataFrame:
    """Aggregate-region generation without Storage and Peak Load, ordered technology."""
    g = marts.generation_report(sym, p).where(F.col("region") == p.report_region)
    return _ordered(g.where(not_in_keep_null("tech", ["Storage", "Peak Load"])), p)


def fig_capacity(sym: SymbolSource, p: Params) -> DataFrame:
    c = marts.capacity_report(sym, p).where(F.col("region") == p.report_region)
    return _ordered(c.where(not_in_keep_null("tech", ["Peak Load"])), p)


def fig_peak_load(sym: SymbolSource, p: Params) -> DataFrame:
    c = marts.capacity_report(sym, p)
    return c.where((F.col("region") == p.report_region) & (F.col("tech") == "Peak Load"))


def fig_investment(sym: SymbolSource, p: Params) -> DataFrame:
    """year, tech, tech_order, investment: aggregate-region investment, storage power shown as
    Storage, unlisted technologies and the base year removed (per scenario when present)."""
    ci = select_scenarios(marts.ca_investment(sym, p), p)
    ci = ci.withColumn("tech", recode_if("tech", [storage_label("capacity")], "Storage"))
    ci = _ordered(ci.where(F.col("year") != p.base_year), p).where(F.col("tech").isNotNull())
    keys = scen_keys(ci) + ["year", "tech", "tech_order"]
    return ci.groupBy(*keys).agg(na_sum("investment").alias("investment"))


def fig_cumulative_investment(sym: SymbolSource, p: Params) -> DataFrame:
    """scenario, tech, tech_order, investment: investment summed through the cutoff year."""
    inv = fig_investment(sym, p).where(F.col("year") <= p.cumulative_cutoff)
    keys = scen_keys(inv) + ["tech", "tech_order"]
    return inv.groupBy(*keys).agg(na_sum("investment").alias("investment"))


def fig_capacity_scenarios(sym: SymbolSource, p: Params) -> DataFrame:
    """Aggregate-region capacity per scenario in the comparison years, without Peak Load."""
    c = select_scenarios(marts.capacity_report(sym, p), p).where(F.col("region") == p.report_region)
    c = _ordered(c.where(not_in_keep_null("tech", ["Peak Load"])), p)
    return c.where(F.col("year").isin(p.comparison_years))


def fig_peak_load_scenarios(sym: SymbolSource, p: Params) -> DataFrame:
    c = select_scenarios(marts.capacity_report(sym, p), p).where(F.col("region") == p.report_region)
    return c.where((F.col("tech") == "Peak Load") & F.col("year").isin(p.comparison_years))


def list_scenarios(sym: SymbolSource) -> DataFrame:
    return sym.scenarios()


def map_long_name(labels: DataFrame, p: Params) -> DataFrame:
    """tech, year, value: long technology labels mapped with the long-name taxonomy; labels
    mapped to ``DROP`` and unknown labels removed."""
    df = apply_lookup(labels, "label", "tech", p.long_name_taxonomy)
    df = df.where(F.col("tech").isNotNull() & (F.col("tech") != "DROP"))
    return sum_by(df, ["tech", "year"], "value")
