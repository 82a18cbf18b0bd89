"""Long <-> wide reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import mean
from ..functions.scalar import checked


def pivot_values(df: DataFrame, index: Sequence[str], column: str, values: Sequence,
                 value: str, agg=mean, names: Sequence[str] | None = None) -> DataFrame:
    """Long -> wide over an explicit value list (no value-discovery job; a value outside the list is
    an error); duplicates are combined with ``agg`` (``pivot_table`` uses the mean). ``names``
    renames the new columns."""
    rows = df.withColumn(column, checked(column, values, column))
    wide = rows.groupBy(*index).pivot(column, list(values)).agg(agg(value))
    if names is not None:
        wide = wide.withColumnsRenamed({str(v): n for v, n in zip(values, names)})
    return wide


#: The column of a lazy pivot: label -> value and place of the label.
LABELS = "by_label"
_LABELS_TYPE = "map<string,struct<value:double,place:int>>"


def pivot_lazy(df: DataFrame, index: Sequence[str], column: str, value: str, agg=mean, place: str | None = None) -> DataFrame:
    """Long -> wide over labels that nobody has listed, without a job: each row holds a map from label to
    value, and ``widen`` makes columns of it where the result is written. The map has one entry for each label of the row,
    as wide as the table will be. ``place`` is an integer column: labels are ordered by its least value, then by name."""
    at = F.min(place) if place else F.lit(0)
    cells = df.groupBy(*index, F.col(column).cast("string").alias("label")).agg(
        agg(value).cast("double").alias("value"), at.cast("int").alias("place"))
    entries = F.collect_list(F.struct("label", F.struct("value", "place")))
    return cells.groupBy(*index).agg(F.map_from_entries(entries).cast(_LABELS_TYPE).alias(LABELS))


def is_lazy(df: DataFrame) -> bool:
    return LABELS in df.columns


def widen(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """A lazy pivot as columns. Without ``labels`` one job finds those present; with them, a label outside is an error."""
    if labels is None:
        found = df.select(F.explode(LABELS).alias("label", "cell")).groupBy("label").agg(F.min("cell.place").alias("place"))
        labels = [r.label for r in sorted(found.collect(), key=lambda r: (r.place, r.label))]
        cells = F.col(LABELS)
    else:
        names = [str(v) for v in labels]
        known = F.size(F.array_except(F.map_keys(LABELS), F.array(*map(F.lit, names)))) == 0
        cells = F.when(known, F.col(LABELS)).otherwise(F.raise_error(F.concat(F.lit("label outside the list: "), F.to_json(F.map_keys(LABELS)))).cast(_LABELS_TYPE))
        labels = names
    held = df.withColumn(LABELS, cells)
    return held.select(*[c for c in df.columns if c != LABELS], *[F.try_element_at(LABELS, F.lit(v))["value"].alias(v) for v in labels])


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Split ``col`` on ``sep`` into new columns placed where ``col`` was."""
    parts = F.split(F.col(col), sep, len(into))
    out = []
    for c in df.columns:
        if c == col:
            out += [F.element_at(parts, i + 1).alias(n) for i, n in enumerate(into)]
        else:
            out.append(F.col(c))
    return df.select(*out)
