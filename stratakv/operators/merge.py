"""Which version of a key counts: last writer wins on (change_time, seq), and what is built on that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(*by: str):
    return Window.partitionBy(*by).orderBy(F.col("change_time").desc(), F.col("seq").desc())


def union_runs(*runs: DataFrame) -> DataFrame:
    """All sources as one, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), runs)


def lww(log: DataFrame) -> DataFrame:
    """One row per key, the newest version; tombstones stay.

    Spark plans row_number = 1 as a group limit before and after one shuffle by key, so a key with many versions sends
    one row per task. Filters on the key put above it are pushed below it.
    """
    return log.withColumn("version", F.row_number().over(newest_first("key"))).where("version = 1").drop("version")


def live_state(log: DataFrame) -> DataFrame:
    """Current contents: a tombstone hides every older version of its key."""
    return lww(log).where(~F.col("tombstone")).drop("tombstone")


def version_history(log: DataFrame) -> DataFrame:
    """All versions with their age: 1 for a key's newest."""
    return log.withColumn("version", F.row_number().over(newest_first("key")))


def put(log: DataFrame, key: Column, value: Column, change_time: Column, seq: Column) -> DataFrame:
    """The log with one more record; an empty value is a tombstone."""
    row = log.sparkSession.range(1).select(key.alias("key"), value.cast(log.schema["value"].dataType).alias("value"), value.isNull().alias("tombstone"), change_time.alias("change_time"), seq.cast("long").alias("seq"))
    return union_runs(log, row)


def delete(log: DataFrame, key: Column, change_time: Column, seq: Column) -> DataFrame:
    return put(log, key, F.lit(None), change_time, seq)


def update(log: DataFrame, key: Column, value: Column, change_time: Column, seq: Column) -> DataFrame:
    """Overwriting is putting: the newer record wins and clears a tombstone."""
    return put(log, key, value, change_time, seq)


def merge_tiers(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Newest version over both tiers, with the tier that it came from."""
    return lww(union_runs(memory.withColumn("tier", F.lit("memory")), disk.withColumn("tier", F.lit("disk"))))
