"""Cutting lineage in iterative operators, orders over whole tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if the master is local (tests), else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="sonorant-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _ranged(rows: DataFrame, order: list) -> DataFrame:
    """rows in range partitions of an order, sorted, with the partition _p and the place _i in it; rows of equal order share a partition."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def numbered(rows: DataFrame, order: list, name: str = "global_id") -> DataFrame:
    """A running number from 0 over all rows in an order, without one task for all: range partitions plus their offsets."""
    parts = _ranged(rows, order)
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_o"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def running(rows: DataFrame, order: list, value: str, name: str, total=F.sum, add=lambda a, b: a + b) -> DataFrame:
    """A running total over all rows up to each in an order: totals inside range partitions, joined by ``add`` with those of the partitions before.

    One row per partition is all that a single task orders.
    """
    parts = _ranged(rows, order)
    inside = total(value).over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    before = parts.groupBy("_p").agg(total(value).alias("_t")).select("_p", total("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_o"))
    met = parts.withColumn("_in", inside).join(F.broadcast(before), "_p")
    both: Column = F.when(F.col("_o").isNull(), F.col("_in")).when(F.col("_in").isNull(), F.col("_o")).otherwise(add(F.col("_in"), F.col("_o")))
    return met.withColumn(name, both).drop("_p", "_i", "_o", "_in")
