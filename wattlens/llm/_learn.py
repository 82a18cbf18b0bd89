"""Bounded training samples, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """Is crc32 of the id as text divisible by 5? (False for a null id.)"""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_keys(rows: DataFrame, id_col: str, class_col: str, per_class: int, seed: str) -> DataFrame:
    """(id, class) of at most about ``per_class`` rows of each class, chosen by a hash of the id.

    Reads only the id and the class; no class is left out. The caller has checked how many classes there are: their counts
    are broadcast, so that rows of a frequent class stay where they are.
    """
    keys = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{class_col}`").alias("class")).where("id IS NOT NULL AND class IS NOT NULL")
    counts = keys.groupBy("class").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return keys.join(F.broadcast(counts), "class").where(place < F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("n"))).select("id", "class")
