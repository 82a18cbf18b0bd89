"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subset_data(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose ``col`` is in a literal list (pushed to the Parquet scan as ``In``)."""
    return df.where(F.col(col).isin(list(values)))


def subset_region(df: DataFrame, regions: DataFrame, col: str = "region") -> DataFrame:
    """Keep rows whose region belongs to the region set (a one-column DataFrame ``region``).

    A left-semi join: the set stays distributed (no ``collect``). It is a handful of rows, so
    AQE plans a broadcast from its runtime size; were it large, the planner would fall back to
    a shuffled semi join instead of failing. When both sides carry ``scenario``, the set is
    matched per scenario.
    """
    use_scen = "scenario" in df.columns and "scenario" in regions.columns
    right = regions.select(F.col("region").alias(col), *(["scenario"] if use_scen else []))
    keys = [col] + (["scenario"] if use_scen else [])
    return df.join(right, on=keys, how="left_semi")


def flag_region(df: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """Add a column that is true for rows of the region set (per scenario where both sides have it)."""
    use_scen = "scenario" in df.columns and "scenario" in regions.columns
    keys = ["region"] + (["scenario"] if use_scen else [])
    right = regions.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(right, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def not_in_keep_null(col: str | Column, values: Sequence) -> Column:
    """``!(x %in% values)``: unlike SQL ``NOT IN``, a NULL ``x`` is kept."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.isin(list(values))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` drops rows with a missing key; Spark keeps a NULL group."""
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df if cond is None else df.where(cond)
