"""Segment -> hour fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def rep_hours(sym) -> DataFrame:
    """The hour map (year, hour, segment): a set, so a repeated row counts once. All jobs use this one rule."""
    return sym.get("hrep").dropDuplicates()


def expand_to_hours(df: DataFrame, rep_hours: DataFrame,
                    keys: Sequence[str] = ("year", "segment")) -> DataFrame:
    """Each segment row fans out to every hour mapped to it (inner join on year, segment).

    Callers aggregate *before* the fan-out, so the left side is already reduced to
    (scenario, tech, year, segment); the hour map is bounded by years x 8760 per scenario."""
    keys = list(keys) + (["scenario"] if "scenario" in df.columns and "scenario" in rep_hours.columns else [])
    return df.join(rep_hours, on=keys, how="inner")
