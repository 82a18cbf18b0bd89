"""Parameters of the mart and analytics jobs, with the reporting model's values as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from .. import lookups


def _l(x):
    return field(default_factory=lambda: list(x))


def _d(x):
    return field(default_factory=lambda: dict(x))


@dataclass(frozen=True)
class Params:
    # taxonomies: a dict fixed in code, or a (key, value) DataFrame derived from data (or a
    # zero-argument callable returning one, built on first use)
    class_taxonomy: Any = _d(lookups.TECH_SET)
    report_taxonomy: Any = _d(lookups.TYPE_TO_TECH)
    area_map: Any = _d(lookups.STATE_MAPPING)
    long_name_taxonomy: Any = _d(lookups.TECH_SUB)
    tech_order: list = _l(lookups.TECH_ORDER)

    deflator: float = lookups.DEFLATOR_2010_TO_2024
    re_tech: list = _l(lookups.RE_TECH)
    years: list = _l(lookups.YEAR_LIST)
    # pivot labels of the wide cost/emission marts: vintage labels for the cost marts, the model
    # years for storage costs and emissions. None (default) takes the labels present in the data,
    # found by Spark's pivot (one small distinct job), as the original pivot tables do.
    vintages: list | None = None
    pivot_years: list | None = None
    open_vintage: str = "2050+"          # label of the open-ended last vintage
    storage_class: str = "li-ion"
    aggregate_region: str = "California"  # label of the appended regional total
    report_region: str = "CA"             # aggregate region of the reporting symbols
    home_area: str = "ca"
    hydrogen_group: str = lookups.HYDROGEN_GROUP
    hydrogen_types: list = _l(lookups.HYDROGEN_TYPES)
    dispatch_excluded: list = _l(lookups.DISPATCH_EXCLUDED)
    top_k: int = lookups.TOP_K_HOURS
    load_floor: float = lookups.LOAD_FLOOR
    cumulative_cutoff: int = lookups.CUMULATIVE_CUTOFF
    comparison_years: list = _l(lookups.COMPARISON_YEARS)
    window_year: int = 2025
    window_hours: int = 120
    scenarios: list | None = None         # None: every scenario present
    dense: bool = True                    # hourly marts: every tech x calendar hour (see README)
    drop_base_year: bool = True           # storage investments leave out the base year
    normalize_report_keys: bool = False   # also strip digits from the report taxonomy keys
    storage_cost_region_filter: bool = False  # restrict storage capital costs to the region set

    @property
    def base_year(self) -> int:
        return self.years[0]

    @property
    def last_year(self) -> int:
        return self.years[-1]

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
