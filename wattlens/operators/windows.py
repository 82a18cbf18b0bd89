"""Window operators. Partitions always include ``scenario`` (when present) so parallelism grows
with the number of scenarios. Within a partition the rows are bounded by the hours of one model year
(times its technologies), or of all model years where a job says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import _c, safe_ratio



def avg_rank(value: str | Column, partition: Sequence[str | Column], descending: bool = True,
             tie_break: Sequence[str | Column] = (), nullable: bool = True) -> Column:
    """R ``rank``: ties get their average rank; NULLs come last with distinct ranks (after all
    values, in ``tie_break`` order). Rank and number of ties come from one sorted window;
    ``nullable=False`` saves the second one, which only NULLs need."""
    v = _c(value)
    w = Window.partitionBy(*partition).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last())
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2.0
    if not nullable:
        return ranked
    nulls = Window.partitionBy(*partition, v.isNull()).orderBy(*[_c(t).asc_nulls_last() for t in tie_break] or [F.lit(1)])
    return F.when(v.isNull(), (F.rank().over(w) - 1 + F.row_number().over(nulls)).cast("double")).otherwise(ranked)


def top_ranked(df: DataFrame, value: str, partition: Sequence[str], k: int) -> DataFrame:
    """Rows of plain rank at most ``k`` in descending order of ``value`` (all rows of a tie, NULLs last). Spark plans a group
    limit for it: a task passes on k rows of a group (and ties), whatever the group's size."""
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn("__rank", F.rank().over(w)).where(F.col("__rank") <= k).drop("__rank")


def position_desc(value: str | Column, partition: Sequence[str | Column],
                  tie_break: Sequence[str | Column] = ()) -> Column:
    """1..n in descending order of ``value`` (NULLs last), ties broken by ``tie_break``."""
    w = Window.partitionBy(*partition).orderBy(
        _c(value).desc_nulls_last(), *[_c(t).asc_nulls_last() for t in tie_break])
    return F.row_number().over(w)


def ntile_nonnull(value: str | Column, n: int, partition: Sequence[str | Column],
                  tie_break: Sequence[str | Column] = ()) -> Column:
    """``ntile`` over non-NULL values (larger buckets first); NULL values get no bucket."""
    v = _c(value)
    is_null = v.isNull()
    w = Window.partitionBy(*partition, is_null).orderBy(v.asc(), *[_c(t).asc_nulls_last() for t in tie_break])
    return F.when(~is_null, F.ntile(n).over(w))


def group_total(value: str | Column, partition: Sequence[str | Column], na_rm: bool = False) -> Column:
    """Group sum broadcast to every row; R semantics (one NULL -> NULL) unless ``na_rm``."""
    v = _c(value)
    w = Window.partitionBy(*partition)
    total = F.sum(v).over(w)
    if na_rm:
        return total
    return F.when(F.count(F.lit(1)).over(w) == F.count(v).over(w), total)


def share_of_group(value: str | Column, partition: Sequence[str | Column]) -> Column:
    """``x / sum(x)`` within the group (R: a NULL member makes every share NULL)."""
    return safe_ratio(value, group_total(value, partition))


def ratio_to_group_max(value: str | Column, of: str | Column, partition: Sequence[str | Column]) -> Column:
    """``value / max(of)`` within the group; NULL when the max is NULL or 0."""
    o = _c(of)
    w = Window.partitionBy(*partition)
    mx = F.when(F.count(F.lit(1)).over(w) == F.count(o).over(w), F.max(o).over(w))
    return safe_ratio(value, mx)
