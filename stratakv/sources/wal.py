"""The write-ahead log as append-only Parquet, its segments, and runs on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakv.operators.integrity import split_by_crc, with_crc
from stratakv.sources.workspace import remove, rename


def append(log: DataFrame, path: str, segment_rows: int | None = None) -> None:
    """Append records with their checksums; files roll at segment_rows records."""
    writer = with_crc(log).write.mode("append")
    (writer.option("maxRecordsPerFile", segment_rows) if segment_rows else writer).parquet(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound records, and those whose checksum doesn't hold."""
    return split_by_crc(spark.read.parquet(path))


def tail(log: DataFrame, low_seq: int) -> DataFrame:
    """What is left of the log once everything up to low_seq is in runs."""
    return log.where(F.col("seq") > low_seq)


def segments(log: DataFrame, segment_bytes: int, block: int = 1000) -> DataFrame:
    """seq, wal_bytes, segment of every record, by the running size of the log.

    Blocks of `block` sequence numbers are summed first, then blocks of as many blocks: the single ordered window runs
    over one row for block^2 records, and all other windows over `block` rows.
    """
    size = 37 + F.octet_length("key") + F.when(F.col("value").isNull(), 0).otherwise(8)
    sized = log.select("seq", size.cast("bigint").alias("wal_bytes"), F.floor(F.col("seq") / block).alias("block"))
    sums = sized.groupBy("block").agg(F.sum("wal_bytes").alias("n")).withColumn("large", F.floor(F.col("block") / block))

    def ahead(order: Window) -> Column:
        return F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    large = sums.groupBy("large").agg(F.sum("n").alias("n")).select("large", ahead(Window.orderBy("large")).alias("first"))
    starts = sums.select("block", "large", ahead(Window.partitionBy("large").orderBy("block")).alias("within")).join(large, "large")
    starts = starts.select("block", (F.col("first") + F.col("within")).alias("before"))
    within = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("wal_bytes").over(within), F.lit(0))
    return sized.join(starts, "block").select("seq", "wal_bytes", F.floor(start / segment_bytes).cast("bigint").alias("segment"))


def append_segments(log: DataFrame, path: str, segment_bytes: int) -> None:
    """The log with checksums as one folder a segment."""
    placed = with_crc(log).join(segments(log, segment_bytes).select("seq", "segment"), "seq")
    placed.repartition("segment").write.mode("append").partitionBy("segment").parquet(path)


def truncate(spark: SparkSession, path: str, low_seq: int) -> int:
    """Delete the segments whose records are all in runs, up to low_seq, and number the others from 0; how many went."""
    last = {r["segment"]: r["seq"] for r in spark.read.parquet(path).groupBy("segment").agg(F.max("seq").alias("seq")).collect()}
    gone = [s for s, seq in last.items() if seq <= low_seq]
    for segment in gone:
        remove(spark, f"{path}/segment={segment}")
    for number, segment in enumerate(sorted(set(last) - set(gone))):
        if number != segment:
            rename(spark, f"{path}/segment={segment}", f"{path}/segment={number}")
    return len(gone)


def write_run(rows: DataFrame, path: str, level: int, run_id: int, bloom: bool = True) -> None:
    """A sorted run: ranges of keys in files with min-max statistics and a Bloom filter on the key."""
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    writer = ordered.write.mode("overwrite")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(f"{path}/level={level}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; level and run_id come from the folders, so a filter on them reads only theirs."""
    return spark.read.option("basePath", path).parquet(f"{path}/level=*/run_id=*")
