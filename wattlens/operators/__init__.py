"""DataFrame -> DataFrame operators shared by the mart and analytics jobs."""

from .aggregate import dense_over_values, partial_rollup, scen_keys, sum_by  # noqa: F401
from .expand import expand_to_hours, rep_hours  # noqa: F401
from .filters import (drop_null_keys, flag_region, not_in_keep_null, subset_data,  # noqa: F401
                      subset_region)
from .lookup import apply_lookup  # noqa: F401
from .partitioning import cluster_by_year  # noqa: F401
from .reshape import pivot_values, separate  # noqa: F401
from .windows import (avg_rank, group_total, ntile_nonnull, position_desc,  # noqa: F401
                      ratio_to_group_max, share_of_group)
