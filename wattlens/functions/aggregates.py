"""Aggregate expressions with the missing-value rules of the two source languages.

* pandas-style (``skipna``): NULLs ignored; a sum over no values is 0.
* R-style (no ``na.rm``): any NULL in the group makes the result NULL.

All are compositions of built-in aggregates, so Spark still runs them as partial (map-side)
plus final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, safe_ratio


def mean(c: str | Column) -> Column:
    """Mean as one division of the sum (exact for DECIMAL) by the count of values; NULL for none."""
    col = _c(c)
    return safe_ratio(F.sum(col), F.count(col))


def sum0(c: str | Column) -> Column:
    """pandas ``sum``: NULLs skipped, empty or all-NULL group gives 0."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def na_propagating(agg, c: str | Column) -> Column:
    """Wrap a built-in aggregate so that one NULL input makes the result NULL (R semantics)."""
    col = _c(c)
    return F.when(F.count(F.lit(1)) == F.count(col), agg(col))


def na_mean(c: str | Column) -> Column:
    return na_propagating(mean, c)


def na_sum(c: str | Column) -> Column:
    return na_propagating(F.sum, c)


def floor0(c: Column) -> Column:
    """``pmax(0, x)`` keeping NULL as NULL (``greatest`` alone would skip the NULL)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def weighted_mean_fallback(weighted_sum: str | Column, weight_sum: str | Column,
                           plain_mean: str | Column) -> Column:
    """Σ(w·x)/Σw, or the plain mean of x where the ratio is undefined (Σw = 0 or NULL)."""
    return F.coalesce(safe_ratio(weighted_sum, weight_sum), _c(plain_mean))
