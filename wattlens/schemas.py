"""Schema registry of the model's result symbols and of the marts.

Each symbol is stored as its own Parquet table (``<root>/<symbol>/scenario=<name>/...``) so a
job reads exactly the symbols it needs, pruned to its columns and scenarios. The registry fixes
the canonical column names and types; marts are read back with typed schemas.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

from . import lookups

S, I, D = StringType(), IntegerType(), DoubleType()

# Attribute columns dropped from variables and sets (only the level / the keys are used).
DROPPED_ATTRIBUTES = ["marginal", "lower", "upper", "scale", "element_text"]


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str                     # "set" | "parameter" | "variable"
    columns: tuple                # canonical (name, type) pairs, measure last
    rename: dict = field(default_factory=dict)   # per-symbol raw -> canonical, beyond COLUMN_NAMES

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, t, True) for n, t in self.columns])

    @property
    def measure(self) -> str | None:
        return {"parameter": "value", "variable": "level"}.get(self.kind)

    def renames(self) -> dict:
        out = dict(lookups.COLUMN_NAMES)
        out.update(self.rename)
        return out


def _sym(name, kind, cols, rename=None):
    return Symbol(name, kind, tuple(cols), rename or {})


_TVRY = [("tech_class", S), ("vintage", S), ("region", S), ("year", I)]
_TRY = [("tech_class", S), ("region", S), ("year", I)]

SYMBOLS = {s.name: s for s in [
    _sym("cal_r", "set", [("region", S)]),
    _sym("capcost", "parameter", [("tech_class", S), ("vintage", S), ("region", S), ("value", D)]),
    _sym("fomcost", "parameter", [("tech_class", S), ("vintage", S), ("region", S), ("value", D)]),
    _sym("icost", "parameter", [("tech_class", S), ("vintage", S), ("region", S), ("year", I), ("value", D)]),
    _sym("icg", "parameter", [("tech_class", S), ("year", I), ("region", S), ("value", D)]),
    _sym("irg", "parameter", [("tech_class", S), ("year", I), ("region", S), ("value", D)]),
    _sym("CO2_ELEC", "variable", [("region", S), ("year", I), ("level", D)]),
    _sym("GC", "variable", _TRY + [("level", D)]),
    _sym("GR", "variable", _TRY + [("level", D)]),
    _sym("IGC", "variable", _TRY + [("level", D)]),
    _sym("IGR", "variable", _TRY + [("level", D)]),
    _sym("XC", "variable", _TVRY + [("level", D)]),
    _sym("IX", "variable", _TVRY + [("level", D)]),
    _sym("G", "variable", _TRY + [("segment", S), ("level", D)]),
    _sym("GD", "variable", _TRY + [("segment", S), ("level", D)]),
    _sym("X", "variable", _TVRY + [("segment", S), ("level", D)]),
    _sym("X_45V", "variable", _TVRY + [("segment", S), ("level", D)]),
    _sym("E", "variable", [("segment", S), ("region_exp", S), ("region_imp", S), ("year", I), ("level", D)],
         {"s_0": "segment", "r_1": "region_exp", "r_2": "region_imp", "t_3": "year"}),
    _sym("dspsrpt_r", "parameter", [("group", S), ("segment", S), ("region", S), ("type", S), ("year", I), ("value", D)],
         {"uni_0": "group", "s_1": "segment", "r_2": "region", "uni_3": "type", "t_4": "year"}),
    _sym("gencaprpt", "parameter", [("region", S), ("type", S), ("year", I), ("unit", S), ("value", D)],
         {"uni_0": "region", "grc_1": "type", "t_2": "year", "uni_3": "unit"}),
    _sym("hrep", "set", [("year", I), ("hour", I), ("segment", S)]),
    _sym("load_8760", "parameter", [("region", S), ("year", I), ("hour", I), ("value", D)]),
    _sym("load_100", "parameter", [("region", S), ("year", I), ("segment", S), ("value", D)]),
    _sym("vrsc_8760", "parameter", _TVRY + [("hour", I), ("value", D)], {"uni": "tech_class"}),
    _sym("vrsc_100", "parameter", _TVRY + [("segment", S), ("value", D)], {"uni": "tech_class"}),
]}

# Marts: canonical output layouts. Wide marts list their keys; the label columns that follow are DOUBLE.
_MAPPING = [("tech", S), ("year", I), ("hour", I), ("generation_h", D), ("capacity", D), ("af_h", D), ("segment", S),
            ("generation_s", D), ("af_s", D), ("load_h", D), ("load_s", D), ("hydrogen_load", D)]
_REPORT = [("tech", S), ("region", S), ("unit", S), ("year", I), ("value", D)]
MARTS = {
    "capacity_by_region_gw": [("tech", S), ("region", S), ("year", I), ("capacity", D)],
    "ca_capacity": [("tech", S), ("year", I), ("capacity", D)],
    "investment_by_region_gw": [("tech", S), ("region", S), ("year", I), ("investment", D)],
    "ca_investment": [("tech", S), ("year", I), ("investment", D)],
    "marginal_costs_usd2024": [("tech", S), ("vintage", S), ("marginal_cost", D)],
    "ca_loads": [("year", I), ("hour", I), ("segment", S), ("load_hour", D), ("load_segment", D), ("hydrogen_load", D)],
    "ca_hourly_mapping": _MAPPING,
    "generation_twh": _REPORT,
    "capacity_gw": _REPORT,
    "dispatch_by_segment_gwh": [("tech", S), ("year", I), ("segment", S), ("level", D), ("hour", I)],
    "trade_gw": [("year", I), ("segment", S), ("region_exp", S), ("region_imp", S), ("trade_gw", D), ("hour", I)],
    "capacity_factors_top_25": [("year", I), ("type", S), ("load", D), ("net_load", D), ("solar", D), ("wind", D),
                                ("offshore_wind", D)],
}
WIDE_MARTS = {
    "capcosts_usd2024": [("tech", S)],
    "fom_costs_usd2024": [("tech", S)],
    "regional_emissions_mtco2": [("region", S)],
}

#: The order in which a mart's rows are stored: the keys that its job groups or pivots by.
MART_ORDER = {
    "capcosts_usd2024": ["tech"],
    "fom_costs_usd2024": ["tech"],
    "marginal_costs_usd2024": ["tech", "vintage"],
    "regional_emissions_mtco2": ["region"],
    "capacity_by_region_gw": ["tech", "region", "year"],
    "ca_capacity": ["tech", "year"],
    "investment_by_region_gw": ["tech", "region", "year"],
    "ca_investment": ["tech", "year"],
    "ca_loads": ["year", "hour", "segment"],
    "ca_hourly_mapping": ["tech", "year", "hour"],
    "generation_twh": ["tech", "region", "unit", "year"],
    "capacity_gw": ["tech", "region", "unit", "year"],
    "dispatch_by_segment_gwh": ["tech", "year", "segment", "hour"],
    "trade_gw": ["year", "segment", "region_exp", "region_imp", "hour"],
    "capacity_factors_top_25": ["type", "year"],
}


def mart_schema(name: str, columns: list[str]) -> StructType:
    """Types of a stored mart's columns, in their order there."""
    keys = dict(MARTS.get(name) or WIDE_MARTS[name]) | {"scenario": S}
    unknown = [c for c in columns if c not in keys] if name in MARTS else []
    if unknown:
        raise ValueError(f"mart {name!r} has unknown columns {unknown}")
    return StructType([StructField(c, keys.get(c, D), True) for c in columns])
