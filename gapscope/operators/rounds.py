"""Helpers for loops that refine a table until it stops changing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a session whose tasks run on the driver's own machine may go without: it gets a
    temporary folder. On a cluster other machines would not see that, so it is an error.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
    spark.conf.set(CHECKPOINT_SETTING, tempfile.mkdtemp(prefix="gapscope-checkpoint-"))
    return spark.conf.get(CHECKPOINT_SETTING)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The rows are computed once, survive lost executors, and come back with sizes the
    optimiser can use and columns it can prune.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gapscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, *folders: str) -> DataFrame:
    """``cut`` into a folder per value of some columns, so that a filter on them reads nothing else."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gapscope-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for table in tables:
        for folder in {re.sub(r"(/gapscope-[0-9a-f]{32})/.*", r"\1", f) for f in table.inputFiles()} if table is not None else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def differs(new: DataFrame, old: DataFrame) -> bool:
    return not new.exceptAll(old).isEmpty() or not old.exceptAll(new).isEmpty()


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``name`` = place from 0 in the order of ``keys``, ranked range by range.

    Rows are split into ranges of the keys; only the number of rows per range passes
    through one task.
    """
    ranged = cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__c")).select(
        "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranged.withColumn("__inside", inside).join(starts, "__range").select(
        *df.columns, (F.col("__start") + F.col("__inside")).alias(name)
    )
