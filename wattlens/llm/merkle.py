"""Merkle manifest of a dataset by lag and lead windows.

Rows are leaves. Within a group they are numbered by an order; every ``FANOUT`` consecutive nodes of a
level become one node of the next, until a group has one node left, its subroot. The subroots, ordered
by group, grow the same way to the root.

* Numbers come from one range sort over groups and order columns, so a group with a third of all rows
  is spread over many tasks; only a count for each (group, partition) is summed up beside it.
* Each level is one window over blocks of ``FANOUT ** BLOCK_LEVELS`` consecutive nodes. Lag and lead columns of
  the offsets 1 to FANOUT - 1, masked by a node's slot in its run and the run's length, are its
  siblings; the first child of a run hashes the parent. Blocks hold whole runs, so no task holds a group.
* On the way back, every node takes its parent's path by one equi-join a level.

Levels are cut by ``checkpoint()``, so a lost executor costs one level's tasks. Everything is built-in
DataFrame functions; the driver sees the number of rows in the largest group.

Defined results: a null field is encoded as ``-``; an empty text is ``0:``. A null group comes before
all others. Nulls in order columns come first; rows alike in all order columns follow their leaf
digests, and wholly equal rows are interchangeable (equal leaves, one place each). An empty table gives
an empty table. Input columns named like an added one (``leaf, path, subroot, root``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlens.session import cut_lineage

FANOUT = 8
#: Levels above a leaf that one window block spans: FANOUT ** BLOCK_LEVELS rows at most in one window partition.
BLOCK_LEVELS = 2
#: monotonically_increasing_id() holds the partition above these bits.
_PARTITION_BITS = 33


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in order."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of a path's sibling digests, from leaf to root and left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """(g, o, digest, row) -> (g, digest, row, pos, size): the place in the group by (o, digest), and the group's size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows differ by `tie`, so that many of them still spread over partitions
    rows = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))
    keys = ["g", "o", "digest", "tie"]
    ordered = cut_lineage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                          .select("g", "digest", "row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", _PARTITION_BITS)
    by_group = Window.partitionBy("g")
    runs = (ordered.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
            .select("g", "part", "first", F.sum("n").over(by_group).alias("size"),
                    (F.sum("n").over(by_group.orderBy("part")) - F.col("n")).alias("before")))
    return (ordered.withColumn("part", part).join(runs, ["g", "part"])
            .select("g", "digest", "row", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size"))


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of groups with several nodes, with the digests left and right of them in their run."""
    window = Window.partitionBy("g", F.floor(F.col("pos") / FANOUT ** BLOCK_LEVELS)).orderBy("pos")
    slot = F.col("pos") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("size") - F.col("pos") + slot)
    left = [F.when(slot >= k, F.lag("digest", k).over(window)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("digest", k).over(window)).otherwise("") for k in range(1, FANOUT)]
    return nodes.where("size > 1").select("*", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def _run() -> Column:
    return F.floor(F.col("pos") / FANOUT)


def _grow(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, o, digest, row) -> leaves (g, digest, row, path, top), and the top (g, digest) of every group."""
    leaves = _numbered(rows)
    largest = leaves.agg(F.max("size")).first()[0] or 0
    nodes, levels, tops = leaves, [], []
    while True:
        tops.append(nodes.where("size = 1"))
        if largest <= 1:
            break
        level = cut_lineage(_with_siblings(nodes))
        levels.append(level)
        # the first child of each run hashes the parent
        nodes = level.where(F.col("pos") % FANOUT == 0).select(
            "g", F.sha2(F.concat("digest", "right"), 256).alias("digest"), _run().alias("pos"),
            F.ceil(F.col("size") / FANOUT).alias("size"))
        largest = -(-largest // FANOUT)
    no_steps = F.array().cast("array<struct<left:string,right:string>>")

    def ended(at: int) -> DataFrame:
        return tops[at].withColumns({"path": no_steps, "top": F.col("digest")})

    above = ended(len(levels))
    for at in range(len(levels) - 1, -1, -1):
        parents = above.select("g", F.col("pos").alias("run"), F.col("path").alias("upper"), "top")
        step = F.array(F.struct("left", "right"))
        joined = levels[at].withColumn("run", _run()).join(parents, ["g", "run"]).withColumn("path", F.concat(step, "upper"))
        columns = [*tops[at].columns, "path", "top"]
        above = joined.select(*columns).unionByName(ended(at).select(*columns))
    subroots = tops[0].select("g", "digest")
    for found in tops[1:]:
        subroots = subroots.unionByName(found.select("g", "digest"))
    return above, subroots


def manifest(rows: DataFrame, leaf: Column, group: Column, order: list[Column]) -> DataFrame:
    """The input's columns, ``leaf``, ``path`` (siblings left and right at each level, up to the root), ``subroot``, ``root``.

    ``leaf`` is a digest (see ``leaf_digest``), ``group`` a text, ``order`` the order within a group.
    """
    carried = [c for c in rows.columns if c not in ("leaf", "path", "subroot", "root")]
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))
    leaves, subroots = _grow(rows.select(key.alias("g"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))).alias("o"),
                                         leaf.alias("digest"), F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")))
    upper, _ = _grow(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest", F.struct("g").alias("row")))
    upper = upper.select(F.col("row.g").alias("g"), F.col("path").alias("upper"), F.col("top").alias("root"))
    return leaves.join(upper, "g").select("row.*", F.col("digest").alias("leaf"), F.concat("path", "upper").alias("path"),
                                          F.col("top").alias("subroot"), "root")
