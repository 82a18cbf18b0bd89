"""Lookups of a key column against a taxonomy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import map_lookup


def apply_lookup(df: DataFrame, key: str | Column, out: str,
                 mapping: Mapping[str, object] | DataFrame) -> DataFrame:
    """Add ``out`` = mapping[key]; unknown keys give NULL.

    ``mapping`` is either a dict fixed in code (applied as a literal map expression, no join) or a
    two-column DataFrame ``(key, value)`` derived from data (a left join; AQE broadcasts it when
    its runtime size is under the broadcast threshold, otherwise it is shuffled).
    """
    key_col = F.col(key) if isinstance(key, str) else key
    if not isinstance(mapping, DataFrame):
        return df.withColumn(out, map_lookup(key_col, mapping))
    k, v = mapping.columns[:2]
    tmp = f"__lookup_{out}"
    m = mapping.select(F.col(k).alias(tmp), F.col(v).alias(f"{tmp}_v"))
    joined = df.withColumn(tmp, key_col).join(m, on=tmp, how="left")
    return joined.withColumn(out, F.col(f"{tmp}_v")).drop(tmp, f"{tmp}_v")
