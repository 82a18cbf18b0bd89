"""Mart jobs: symbol tables -> tidy marts (capacity, investment, costs, emissions, reports).

Every job is lazy ``(symbols, params) -> DataFrame``; aggregation keys include ``scenario``
whenever the symbols carry it, so one run covers all scenarios.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import mean
from ..functions.scalar import current_dollars, strip_digits, tech_prefix
from ..lookups import storage_label
from ..operators.aggregate import dense_over_values, partial_rollup, scen_keys, sum_by
from ..operators.filters import drop_null_keys, flag_region, subset_region
from ..operators.lookup import apply_lookup
from ..operators.reshape import pivot_lazy, pivot_values
from ..sources.symbols import Part, SymbolSource
from .params import Params


def with_tech(df: DataFrame, p: Params) -> DataFrame:
    """``tech`` = class taxonomy of the class prefix (text before the first ``-``)."""
    return apply_lookup(df, tech_prefix("tech_class"), "tech", p.class_taxonomy)


def _plants_and_storage(sym: SymbolSource, p: Params, plants: str, power: str, energy: str, measure: str,
                        drop_year: int | None = None) -> DataFrame:
    """One aggregate over three symbols: plants by technology, and the two storage totals (without ``drop_year``)."""
    counted = None if drop_year is None else F.col("year") != drop_year
    parts = [Part(plants, F.col("tech")), Part(power, F.lit(storage_label("capacity")), counted), Part(energy, F.lit(storage_label("energy")), counted)]
    rows = sym.summed(parts, ["region", "year"], prepare=lambda df: with_tech(df, p))
    return rows.withColumnRenamed("level", measure)


# -- capacity --------------------------------------------------------------------------------------

def capacity_by_region(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, region, year, capacity: generator capacity by technology plus the two storage
    totals (power and energy)."""
    return _plants_and_storage(sym, p, "XC", "GC", "GR", "capacity")


def ca_capacity(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, year, capacity summed over the region set (the set filter lands below the
    aggregates, right after the scans)."""
    regional = subset_region(capacity_by_region(sym, p), sym.get("cal_r"))
    return sum_by(regional, ["tech", "year"], "capacity")


def capacity_dense(sym: SymbolSource, p: Params) -> DataFrame:
    """``ca_capacity`` with every technology x model year present (0 where nothing is built)."""
    regional = subset_region(capacity_by_region(sym, p), sym.get("cal_r"))
    return dense_over_values(regional, ["tech"], "year", p.years, "capacity")


# -- investment ------------------------------------------------------------------------------------

def investment_by_region(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, region, year, investment. Summing by class then by technology equals one sum by
    technology, so a single aggregate is used. Storage leaves out the base year."""
    return _plants_and_storage(sym, p, "IX", "IGC", "IGR", "investment", p.base_year if p.drop_base_year else None)


def ca_investment(sym: SymbolSource, p: Params) -> DataFrame:
    regional = subset_region(investment_by_region(sym, p), sym.get("cal_r"))
    return sum_by(regional, ["tech", "year"], "investment")


# -- costs -----------------------------------------------------------------------------------------

def _pivot(df: DataFrame, idx: list, column: str, labels: list | None, value: str) -> DataFrame:
    """Mean pivot over explicit labels (a label outside them is an error), or over the labels found
    in the data when None."""
    if labels is None:
        return df.groupBy(*idx).pivot(column).agg(mean(value))
    return pivot_values(df, idx, column, labels, value, names=[str(v) for v in labels])


def _cost_rows(sym: SymbolSource, p: Params, symbol: str) -> DataFrame:
    """Regional costs by (tech, vintage) without the base-year vintage."""
    df = with_tech(subset_region(sym.get(symbol), sym.get("cal_r")), p)
    return drop_null_keys(df, scen_keys(df) + ["tech", "vintage"]).where(F.col("vintage") != str(p.base_year))


def _deflated(p: Params):
    return lambda value: current_dollars(mean(value), p.deflator)


def _cost_wide(sym: SymbolSource, p: Params, symbol: str) -> DataFrame:
    """Regional mean cost by (tech, vintage), deflated, one column per vintage; the base-year
    vintage is left out. The mean is taken by the pivot itself (one aggregation)."""
    df = _cost_rows(sym, p, symbol)
    idx = scen_keys(df) + ["tech"]
    labels = None if p.vintages is None else [v for v in p.vintages if v != str(p.base_year)]
    wide = _pivot(df, idx, "vintage", labels, "value")
    return wide.select(*idx, *[current_dollars(F.col(f"`{c}`"), p.deflator).alias(c) for c in wide.columns if c not in idx])


def _capcost_rows(sym: SymbolSource, p: Params) -> tuple[DataFrame, list[str]]:
    """Rows (index, label, value, plant) of the capital costs. Vintages (the open one under the last year's name) and
    years are the same labels."""
    rows = with_tech(sym.stacked(["capcost", "icg", "irg"]), p)
    plant = F.col("symbol") == "capcost"
    rows = flag_region(rows, sym.get("cal_r"), "__in")
    storage = F.col("tech_class") == p.storage_class
    if p.storage_cost_region_filter:
        storage = storage & F.col("__in")
    rows = rows.where(F.when(plant, F.col("__in") & (F.col("vintage") != str(p.base_year))).otherwise(storage))
    label = (F.when(~plant, F.col("year").cast("string"))
             .when(F.col("vintage") == p.open_vintage, str(p.last_year)).otherwise(F.col("vintage")))
    name = (F.when(F.col("symbol") == "icg", f"{p.storage_class}-power")
            .when(F.col("symbol") == "irg", f"{p.storage_class}-energy").otherwise(F.col("tech")))
    idx = scen_keys(rows) + ["tech"]
    return drop_null_keys(rows.withColumns({"tech": name, "label": label, "plant": plant}), idx + ["label"]), idx


def capcosts_wide(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, <vintage...>: capital costs, plus the storage power/energy rows (all regions, by
    year); year columns that only storage has come last. One pass and one pivot."""
    rows, idx = _capcost_rows(sym, p)
    if p.vintages is None or p.pivot_years is None:
        # the labels present: a small job over the cost symbols' keys
        found = rows.select("plant", "label").distinct().collect()
        own = sorted({r.label for r in found if r.plant})
        labels = own + sorted({r.label for r in found} - set(own))
    else:
        own = [str(p.last_year) if v == p.open_vintage else v for v in p.vintages if v != str(p.base_year)]
        labels = own + [str(y) for y in p.pivot_years if str(y) not in own]
    wide = pivot_values(rows, idx, "label", labels, "value")
    return wide.select(*idx, *[current_dollars(F.col(f"`{c}`"), p.deflator).alias(c) for c in labels])


def fom_costs_wide(sym: SymbolSource, p: Params) -> DataFrame:
    return _cost_wide(sym, p, "fomcost")


def capcosts(sym: SymbolSource, p: Params) -> DataFrame:
    """The capital-cost mart: wide over listed labels, else a lazy pivot that the sink makes wide. Never runs a job."""
    if p.vintages is not None and p.pivot_years is not None:
        return capcosts_wide(sym, p)
    rows, idx = _capcost_rows(sym, p)
    rows = rows.withColumn("place", F.when(F.col("plant"), 0).otherwise(1))
    return pivot_lazy(rows, idx, "label", "value", _deflated(p), place="place")


def fom_costs(sym: SymbolSource, p: Params) -> DataFrame:
    """The fixed-cost mart, like ``capcosts``."""
    if p.vintages is not None:
        return fom_costs_wide(sym, p)
    rows = _cost_rows(sym, p, "fomcost")
    return pivot_lazy(rows, scen_keys(rows) + ["tech"], "vintage", "value", _deflated(p))


def marginal_costs(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, vintage, marginal_cost: regional mean variable cost, deflated."""
    df = with_tech(subset_region(sym.get("icost"), sym.get("cal_r")), p)
    keys = scen_keys(df) + ["tech", "vintage"]
    return (drop_null_keys(df, keys).groupBy(*keys)
            .agg(current_dollars(mean("value"), p.deflator).alias("marginal_cost")))


# -- emissions -------------------------------------------------------------------------------------

def _emission_rows(sym: SymbolSource, p: Params) -> tuple[DataFrame, list[str]]:
    df = sym.get("CO2_ELEC").select(*scen_keys(sym.get("CO2_ELEC")), "region", "year",
                                    (F.col("level") * 1000).alias("emissions"))
    both = partial_rollup(df, sym.get("cal_r"), p.aggregate_region, ["year"], "emissions")
    idx = scen_keys(both) + ["region"]
    return drop_null_keys(both, idx), idx


def emissions_rollup(sym: SymbolSource, p: Params) -> DataFrame:
    """region, <year...>: emissions x 1000 by region plus the aggregate region row."""
    rows, idx = _emission_rows(sym, p)
    return _pivot(rows, idx, "year", p.pivot_years, "emissions")


def emissions(sym: SymbolSource, p: Params) -> DataFrame:
    """The emissions mart, like ``capcosts``."""
    if p.pivot_years is not None:
        return emissions_rollup(sym, p)
    rows, idx = _emission_rows(sym, p)
    return pivot_lazy(drop_null_keys(rows, ["year"]), idx, "year", "emissions")


# -- generation & capacity report ------------------------------------------------------------------

def report_by_tech(sym: SymbolSource, p: Params, unit: str | None = None) -> DataFrame:
    """tech, region, unit, year, value: report classes with digits removed, mapped, summed."""
    df = sym.get("gencaprpt")
    if unit is not None:
        df = df.where(F.col("unit") == unit)
    taxonomy = p.report_taxonomy
    if p.normalize_report_keys and isinstance(taxonomy, dict):
        # the lookup sees digit-free classes, so make the keys digit-free too (first key wins)
        norm: dict = {}
        for k, v in taxonomy.items():
            norm.setdefault(re.sub(r"[0-9]+", "", k), v)
        taxonomy = norm
    df = apply_lookup(df, strip_digits("type"), "tech", taxonomy)
    return sum_by(df.where(F.col("tech").isNotNull()), ["tech", "region", "unit", "year"], "value")


def generation_report(sym: SymbolSource, p: Params) -> DataFrame:
    return report_by_tech(sym, p, "TWh")


def capacity_report(sym: SymbolSource, p: Params) -> DataFrame:
    return report_by_tech(sym, p, "gw")
