"""Grouped aggregates. Every aggregate groups by ``scenario`` too when the input carries it, so
one run serves any number of scenarios. Spark plans each as partial (map-side) + final
aggregation, which also absorbs hot keys before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import mean, sum0
from ..functions.scalar import checked
from .filters import drop_null_keys, flag_region


def scen_keys(df: DataFrame) -> list[str]:
    return ["scenario"] if "scenario" in df.columns else []


def sum_by(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """pandas ``groupby(keys).agg(sum)``: rows with a NULL key are dropped, NULLs skipped."""
    keys = scen_keys(df) + list(keys)
    return drop_null_keys(df, keys).groupBy(*keys).agg(sum0(value).alias(out or value))


def partial_rollup(df: DataFrame, regions: DataFrame, label: str, keys: Sequence[str],
                   value: str) -> DataFrame:
    """The mean of each region's rows per ``keys``, and one aggregate region: the sum over the region set.

    One pass: a row of the region set also becomes a row of the aggregate region, then both are
    summed together (map-side first)."""
    rows = flag_region(df, regions, "__in")
    names = F.array_compact(F.array(F.struct(F.col("region"), F.lit(False).alias("__total")),
                                    F.when(F.col("__in"), F.struct(F.lit(label).alias("region"), F.lit(True).alias("__total")))))
    others = scen_keys(df) + list(keys)
    rows = rows.select(*others, value, F.inline(names))
    ids = others + ["region", "__total"]
    out = drop_null_keys(rows, ids).groupBy(*ids).agg(sum0(value).alias("__sum"), mean(value).alias("__mean"))
    return out.select(*scen_keys(df), "region", *keys, F.when(F.col("__total"), F.col("__sum").cast("double")).otherwise(F.col("__mean")).alias(value))


def dense_over_values(df: DataFrame, keys: Sequence[str], column: str, values: Sequence,
                      value: str) -> DataFrame:
    """Emit every (keys, column-value) combination for a fixed value list, summing ``value``
    and writing 0 where there is nothing (the categorical-groupby behaviour). A value outside the
    list is an error.

    Done as pivot over the explicit list (one wide row per key) followed by an unpivot: a
    single aggregation, no cross join and no discovery job."""
    keys = scen_keys(df) + list(keys)
    rows = drop_null_keys(df, keys).withColumn(column, checked(column, values, column))
    wide = rows.groupBy(*keys).pivot(column, list(values)).agg(F.sum(value))
    names = [str(v) for v in values]
    long = wide.unpivot(keys, names, "__k", value)
    col_type = df.schema[column].dataType
    return long.select(*keys, F.col("__k").cast(col_type).alias(column),
                       F.coalesce(F.col(value), F.lit(0)).alias(value))
