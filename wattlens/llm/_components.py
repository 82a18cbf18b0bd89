"""Connected components of a link table by alternating star contraction.

Every round replaces links by links to the smallest neighbour (large star, then small star), so the
table never grows beyond its size and the number of rounds is logarithmic in practice. Rounds are
cut by ``checkpoint()`` into the shared checkpoint folder. Nothing is collected but two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.session import cut_lineage


def _to_least(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """(u, v) -> (v, m) with m the least of u's neighbours and u."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = pairs.join(least, "u")
    if keep_own:  # small star: u itself hangs under m, too
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of a totally ordered type -> (node, component): the smallest node reachable.

    Only nodes with a link to another node appear. An empty table gives an empty table.
    """
    pairs = cut_lineage(links.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, keep_own=False)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pairs = cut_lineage(_to_least(down, keep_own=True))
        # at the end every node hangs under its component's smallest one, and the table no longer changes
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
