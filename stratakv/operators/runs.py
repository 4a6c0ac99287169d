"""Runs, levels and compaction over run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.operators.merge import newest_first
from stratakv.sources.workspace import part_bounds, sorted_parts


def record_size(value_bytes: Column | None = None) -> Column:
    """Bytes of a record: checksum, time, flag and key size, and the value's size and bytes unless it is a tombstone.

    value_bytes: of the value, 8 (a double) by default.
    """
    size = F.lit(8) if value_bytes is None else value_bytes
    return (F.lit(29) + F.octet_length("key") + F.when(F.col("tombstone"), 0).otherwise(size + 8)).cast("bigint")


def flush(log: DataFrame, cap: int) -> DataFrame:
    """Memtables of `cap` records become runs of level 0: one version per key and run."""
    run = F.floor(F.col("seq") / cap).cast("long")
    newest = log.withColumn("run_id", run).withColumn("version", F.row_number().over(newest_first("run_id", "key")))
    return newest.where("version = 1").drop("version").withColumn("level", F.lit(0))


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level", "run_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_records"), F.sum(F.col("tombstone").cast("long")).alias("n_tombstones"), F.sum("seq").alias("seq_sum")
    )


def next_slot(stats: DataFrame, max_level: int) -> DataFrame:
    """Number of the next run of every level; levels stop at max_level - 1."""
    level = F.least(F.col("level"), F.lit(max_level - 1))
    return stats.groupBy(level.alias("level")).agg((F.count("*") + 1).alias("next_run"))


def renumber(stats: DataFrame) -> DataFrame:
    return stats.withColumn("new_run", F.row_number().over(Window.partitionBy("level").orderBy("run_id")))


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet. Run metadata only: one row per run on either side."""
    a, b = (x.select(F.col("run_id").alias(f"{n}_run"), F.col("min_key").alias(f"{n}_min"), F.col("max_key").alias(f"{n}_max")) for x, n in ((upper, "upper"), (lower, "lower")))
    return a.join(b, (F.col("upper_min") <= F.col("lower_max")) & (F.col("upper_max") >= F.col("lower_min")))


def plan_size_tiered(stats: DataFrame, tables: int, max_level: int) -> DataFrame:
    """Levels of which all runs are merged into one of the next, and how many runs those are."""
    count = stats.groupBy("level").agg(F.count("*").alias("n_runs"))
    return count.withColumn("compact", (F.col("n_runs") >= tables) & (F.col("level") < max_level - 1))


def plan_leveled(stats: DataFrame, tables: int, growth: int, max_level: int) -> DataFrame:
    """Levels over their limit, and the run, the oldest, that moves down."""
    count = stats.groupBy("level").agg(F.count("*").alias("n_runs"), F.min("run_id").alias("oldest_run"))
    limit = (F.lit(tables) * F.pow(F.lit(float(growth)), "level")).cast("long")
    return count.withColumn("run_limit", limit).withColumn("compact", (F.col("n_runs") >= F.col("run_limit")) & (F.col("level") < max_level - 1))


def compact(runs: DataFrame, fan_in: int) -> DataFrame:
    """Every fan_in neighbouring runs become one of the next level: newest version per key, tombstones kept."""
    merged = runs.withColumn("run_id", F.floor(F.col("run_id") / fan_in).cast("long")).withColumn("level", F.col("level") + 1)
    return merged.withColumn("version", F.row_number().over(newest_first("run_id", "key"))).where("version = 1").drop("version")


def compact_leveled(upper: DataFrame, lower: DataFrame, lower_stats: DataFrame, run_id: int) -> DataFrame:
    """One run of the upper level merged with the runs below that its key range meets."""
    moved = upper.where(F.col("run_id") == run_id)
    bounds = moved.agg(F.min("key").alias("low"), F.max("key").alias("high"))
    met = lower_stats.join(F.broadcast(bounds), (F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low"))).select("run_id")
    both = moved.unionByName(lower.join(met, "run_id", "left_semi").select(moved.columns))
    return both.withColumn("version", F.row_number().over(newest_first("key"))).where("version = 1").drop("version")


def bounds(capacity: int, tables: int, growth: int, level: Column) -> tuple[Column, Column]:
    """Records that a run of a level may have, size-tiered and leveled: what its Bloom filter is sized for."""
    return F.lit(capacity) * F.pow(F.lit(float(tables)), level + 1), F.lit(capacity) * F.pow(F.lit(float(growth)), level + 1) * tables


def with_offsets(runs: DataFrame) -> DataFrame:
    """Place and byte offset of every record in its run."""
    order = Window.partitionBy("run_id").orderBy("key")
    sized = runs.withColumn("record_size", record_size())
    return sized.withColumn("ordinal", F.row_number().over(order)).withColumn("offset", F.coalesce(F.sum("record_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sparse_index(runs: DataFrame, every: int) -> DataFrame:
    return with_offsets(runs).where(F.col("ordinal") % every == 0).select("run_id", "ordinal", "key", "offset")


def summary_index(runs: DataFrame, every: int, summary_every: int) -> DataFrame:
    """Every summary_every-th entry of the sparse index, with the run's key bounds."""
    index = sparse_index(runs, every)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("key"))
    ends = runs.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return index.withColumn("entry", place).where(F.col("entry") % summary_every == 0).join(ends, "run_id").select("run_id", "entry", "key", "min_key", "max_key")


def offset_bounds(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.lit(0).cast("long").alias("start"), F.sum(record_size()).alias("end"))


def dict_encode(log: DataFrame) -> DataFrame:
    """Number of every distinct key, in order, from 1. Ranges of keys are sorted each in its task, and their sizes give the offsets."""
    parts = sorted_parts(log.select("key").distinct(), "key", "dictionary")
    starts = F.broadcast(part_bounds(parts, "key").select("part", "before"))  # one row a range
    return parts.join(starts, "part").select("key", (F.col("before") + F.col("place") + 1).alias("key_id"))


def dict_decode(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """coded with the keys that its key_id stands for."""
    return coded.join(dictionary, "key_id").drop("key_id")
