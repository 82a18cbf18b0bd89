"""Row-level column expressions. All built-in Spark functions: they stay inside whole-stage
codegen and never leave the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: Mapping[str, object]) -> Column:
    """A literal ``map<k, v>`` built from a small dict fixed in code."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def map_lookup(c: str | Column, mapping: Mapping[str, object]) -> Column:
    """Dictionary lookup; unknown keys and NULL give NULL (like ``Series.map``)."""
    return F.try_element_at(literal_map(mapping), _c(c))


def tech_prefix(c: str | Column = "tech_class") -> Column:
    """Text before the first ``-`` (the whole text when there is none)."""
    return F.substring_index(_c(c), "-", 1)


def strip_digits(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"[0-9]+", "")


def current_dollars(c: str | Column, deflator: float = lookups.DEFLATOR_2010_TO_2024) -> Column:
    return _c(c) * F.lit(deflator)


def recode_if(c: str | Column, from_values: Sequence[str], to_value: str) -> Column:
    """``if_else(x %in% from_values, to_value, x)``."""
    col = _c(c)
    return F.when(col.isin(list(from_values)), F.lit(to_value)).otherwise(col)


def tech_order(c: str | Column = "tech", order: Sequence[str] = lookups.TECH_ORDER) -> Column:
    """Position (1-based) of a technology in the display order; NULL when not listed."""
    return map_lookup(c, {t: i + 1 for i, t in enumerate(order)}).cast("int")


def ordered_tech(c: str | Column = "tech", order: Sequence[str] = lookups.TECH_ORDER) -> Column:
    """An ordered category: the label itself when listed, NULL otherwise."""
    col = _c(c)
    return F.when(col.isin(list(order)), col)


def hour_to_timestamp(hour: str | Column = "hour", start: str = lookups.CALENDAR_START,
                      hours_per_year: int = lookups.HOURS_PER_YEAR) -> Column:
    """Hour of year (1-based) -> wall-clock time in the fixed calendar year, as
    ``timestamp_ntz`` (no time zone, no daylight saving). Hours outside 1..8760 give NULL."""
    h = _c(hour)
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (h - 1).cast("int"), F.lit(0), F.lit(0))
    return F.when((h >= 1) & (h <= hours_per_year), ts)


def calendar_parts(time: str | Column = "time") -> dict[str, Column]:
    t = _c(time)
    return {"month": F.month(t), "day": F.dayofmonth(t), "hour_of_day": F.hour(t),
            "month_name": F.date_format(t, "MMM")}


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as DOUBLE; NULL instead of an error or NaN when ``den`` is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def checked(c: str | Column, allowed: Sequence, what: str) -> Column:
    """The value itself, or an error if it is none of ``allowed`` (NULL passes): fixed label lists
    must not make rows vanish."""
    col = _c(c)
    error = F.raise_error(F.concat(F.lit(f"{what} outside {list(allowed)}: "), col.cast("string")))
    return F.when(col.isNull() | col.isin(list(allowed)), col).otherwise(error)
