"""Column-level functions (scalar and aggregate)."""

from .aggregates import (floor0, mean, na_mean, na_propagating, na_sum, sum0,  # noqa: F401
                         weighted_mean_fallback)
from .scalar import (calendar_parts, checked, current_dollars, hour_to_timestamp,  # noqa: F401
                     literal_map, map_lookup, ordered_tech, recode_if,
                     safe_ratio, strip_digits, tech_order, tech_prefix)
