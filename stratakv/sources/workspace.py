"""Tables in between, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own, for tests on one machine, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_stratakv_folder", None)
    if not folder:
        folder = spark._stratakv_folder = "file://" + tempfile.mkdtemp(prefix="stratakv-")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # ended before
        return
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = filesystem(spark, old)
    fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new))


def sorted_parts(df: DataFrame, key: str, name: str) -> DataFrame:
    """df in ranges of the key, sorted within each, written: with the number of its range (part) and the place in it, from 0.

    Ranges are sampled, so they are written before anything is counted in them.
    """
    path = new_folder(df.sparkSession, name)
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("place", F.monotonically_increasing_id())
    ordered.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def part_bounds(parts: DataFrame, key: str) -> DataFrame:
    """For every range: rows in the ranges before it, the last key before it and the first after it. One row a range."""
    order = Window.orderBy("part")
    each = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("part", before.alias("before"), F.lag("high").over(order).alias("key_before"), F.lead("low").over(order).alias("key_after"))
