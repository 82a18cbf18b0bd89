"""Spark session settings and the shared checkpoint folder.

The jobs never depend on session settings for their results (no time-zone sensitive expression,
ANSI-safe arithmetic), so a cluster session can be passed in as it is. ``build_session`` is the
recommended configuration: AQE on (partition coalescing, skew-join splitting, runtime broadcast
of small sides under a size threshold), UI off.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "wattlens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The folder configured on the session wins. Only in local mode (tests) a scratch folder is
    made where none is configured; on a cluster that is an error, as executors don't share it.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # core setting, not settable on a running session: set the context's folder instead
        current = tempfile.mkdtemp(prefix="wattlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"wattlens-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables written by a job of this application."""
    return os.path.join(scratch_root(spark), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the scratch folder and read again. Like ``cut_lineage`` it survives lost
    executors; as a file scan it also has sizes, so the planner can choose joins, and prunes columns."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Call it when no result that reads them is needed any more
    (a DataFrame of a job with stored intermediate tables can't be run after it)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on this file system import the package from where the driver has it (a cluster
    without the path gets it by ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
