"""Mart sinks and mart scans.

Marts are written per scenario (one folder each, so rewriting one scenario leaves the others in
place), as Parquet by default or as CSV with a header. A mart is read back with its typed schema from
the registry, from either format; a field that doesn't fit its type is an error.

Staged commit: the job writes beside the mart, into a folder that readers leave out. A job that fails or is
killed leaves the old mart as it was. Only when it has succeeded is the staged folder renamed to a *ready* one
(the commit), and its folders are swapped in. A swap that was cut short is finished by ``recover``, which every
later write of the mart calls first; each step of it can be repeated. Between the two renames of a
scenario's swap a reader may miss that scenario, never see half of it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from ..operators.reshape import is_lazy, widen
from ..schemas import mart_schema
from ..session import cut_lineage
from .folders import Folders, partition_folder

PARTITION = "scenario"


def plain(df: DataFrame) -> DataFrame:
    """Exact DECIMAL sums as the DOUBLE that marts hold."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# -- staged commit ---------------------------------------------------------------------------------

def _beside(path: str, kind: str) -> str:
    """A folder beside ``path`` for its staged (``staged``), committed (``ready``) or replaced (``old``) data."""
    parent, name = os.path.split(path.rstrip("/"))
    return os.path.join(parent, f"_{kind}-{name}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish the swap of a committed write that was cut short, if there is one."""
    folders = Folders(spark, path)
    ready, old = _beside(path, "ready"), _beside(path, "old")
    if folders.exists(os.path.join(ready, "_gone")):
        for name in (n for n in folders.names(ready) if "=" in n):
            own = os.path.join(path, name)  # the old one: the new one still waits
            if folders.exists(own):
                folders.move(own, os.path.join(old, name))
            folders.move(os.path.join(ready, name), own)
        for name in folders.names(os.path.join(ready, "_gone")):
            if folders.exists(os.path.join(path, name)):
                folders.move(os.path.join(path, name), os.path.join(old, name))
        folders.delete(ready)
    elif folders.exists(ready):
        if folders.exists(path):
            folders.move(path, old)
        folders.move(ready, path)
    folders.delete(old)


def _commit(spark: SparkSession, staged: str, path: str, partitions: Sequence[str] | None) -> None:
    folders = Folders(spark, path)
    if partitions is not None:  # some scenarios only; those without rows now are listed under _gone
        folders.make(os.path.join(staged, "_gone"))
        for name in {partition_folder(PARTITION, p, spark) for p in partitions} - set(folders.names(staged)):
            folders.make(os.path.join(staged, "_gone", name))
    folders.move(staged, _beside(path, "ready"))
    recover(spark, path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", scenarios: Sequence[str] | None = None) -> None:
    """Replace a table (or only the partitions of ``scenarios``) once all of its new rows are written."""
    spark = df.sparkSession
    recover(spark, path)
    staged = f"{_beside(path, 'staged')}-{uuid.uuid4().hex}"
    partitioned = PARTITION in df.columns
    w = df.write.format(fmt)
    w = w.partitionBy(PARTITION) if partitioned else w
    try:
        (w.option("header", True) if fmt == "csv" else w).save(staged)
    except Exception:
        Folders(spark, path).delete(staged)
        raise
    _commit(spark, staged, path, scenarios if partitioned else None)


# -- marts -----------------------------------------------------------------------------------------

def write_mart(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", order_by: Sequence[str] | None = None,
               scenarios: Sequence[str] | None = None) -> None:
    """Write a mart. ``order_by`` gives one total order across the files by name: rows are dealt out by
    ranges of (scenario, keys) and sorted, so no task holds more than its range. ``scenarios`` names the scenarios that are being
    rebuilt: their old rows go with the commit, so one that has no rows any more doesn't keep them. A lazy pivot gets its
    columns here. ``mode="append"`` adds files without staging."""
    if is_lazy(df):
        df = widen(cut_lineage(df))  # aggregated once, for its labels and its rows
    df = plain(df)
    partitioned = PARTITION in df.columns
    if order_by:
        df = df.orderBy(*([PARTITION] if partitioned else []), *[f"`{c}`" for c in order_by])
    if mode == "overwrite":
        write_table(df, path, fmt, scenarios)
        return
    w = df.write.mode(mode).format(fmt)
    w = w.partitionBy(PARTITION) if partitioned else w
    (w.option("header", True) if fmt == "csv" else w).save(path)


def with_text_partitions(schema: StructType) -> StructType:
    """Scenario names are text, also those that look like numbers (Spark would read folder ``007`` as 7)."""
    return StructType([StructField(f.name, StringType(), True) if f.name == PARTITION else f for f in schema.fields])


def load(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """A stored table whose scenario folders are read as text."""
    paths = [path] if isinstance(path, str) else list(path)
    found = spark.read.format(fmt).options(**options).load(paths)
    if PARTITION not in found.columns or isinstance(found.schema[PARTITION].dataType, StringType):
        return found
    return spark.read.format(fmt).options(**options).schema(with_text_partitions(found.schema)).load(paths)


def read_mart(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A stored mart with the registry's types. A CSV line that doesn't fit them (a word in a number's place, a
    missing or an additional field) is an error of the job that reads it, never a NULL. An empty text is missing in CSV."""
    if fmt != "csv":
        df = load(spark, path, fmt)
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in mart_schema(name, df.columns)])
    columns = spark.read.option("header", True).csv(path).columns  # reads a header line only
    return (spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
            .schema(mart_schema(name, columns)).csv(path))
