"""Partitioning shared by the statistics on per-hour marts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .aggregate import scen_keys


def cluster_by_year(df: DataFrame) -> DataFrame:
    """Hash-partition a per-hour mart by (scenario, year).

    Every group-by and window of the hourly/dispatch statistics keys on a superset of
    (scenario, year), so this single exchange satisfies all of them and Spark plans no further
    shuffle. A partition holds one model year of one scenario (at most techs x 8,760 rows),
    whatever the input size, so no partition can grow with the data; parallelism grows with the
    number of scenarios x years.
    """
    return df.repartition(*scen_keys(df), "year")
