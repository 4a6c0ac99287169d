"""Checksums and Merkle trees of runs."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.functions.hashing import fnv1_32


def record_text() -> Column:
    return F.concat_ws("|", F.col("key"), F.coalesce(F.col("seq").cast("string"), F.lit("")), F.col("tombstone").cast("string"))


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", F.crc32(F.encode(record_text(), "UTF-8")))


def split_by_crc(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose checksum holds, and the others for quarantine."""
    good = F.coalesce(F.col("crc") == F.crc32(F.encode(record_text(), "UTF-8")), F.lit(False))
    return log.where(good), log.where(~good)


def merkle_leaves(runs: DataFrame) -> DataFrame:
    """run_id, idx (from 0, in key order), hash of each record on its own, so a change stays where it is."""
    order = Window.partitionBy("run_id").orderBy("key")
    return runs.select("run_id", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), "key", fnv1_32(F.encode(record_text(), "UTF-8")).alias("hash"))


def merkle_levels(leaves: DataFrame, height: int) -> DataFrame:
    """run_id, level, idx, hash: a parent is the sum of its children; absent leaves count 0."""
    spread = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height))))
    return spread.groupBy("run_id", "level", F.expr("shiftright(idx, level)").alias("idx")).agg(F.sum("hash").alias("hash"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    n = F.count("*")
    height = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return leaves.groupBy("run_id").agg(F.sum("hash").alias("root"), n.alias("n_leaves"), height.cast("int").alias("height"))


def _leaf_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("run_id", "idx", F.col("hash").alias("old_hash"))
    b = new.select("run_id", "idx", F.col("hash").alias("new_hash"))
    return a.join(b, ["run_id", "idx"], "full_outer")


def merkle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves whose hashes differ; a leaf on one side only differs."""
    return _leaf_pairs(old, new).where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def validate(old: DataFrame, new: DataFrame) -> DataFrame:
    """run_id, status: same, changed, or another shape; and how many leaves changed. One pass over the pairs of leaves."""
    n = F.count(F.when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), 1))
    sides = _leaf_pairs(old, new).groupBy("run_id").agg(n.alias("n_changed"), F.count("old_hash").alias("n_old"), F.count("new_hash").alias("n_new"))
    status = F.when(F.col("n_old") != F.col("n_new"), "shape").when(F.col("n_changed") > 0, "changed").otherwise("same")
    return sides.select("run_id", status.alias("status"), "n_changed")


def merkle_pack(nodes: list[int]) -> bytes:
    """Node count in eight bytes, so that large trees survive, and the nodes."""
    return struct.pack(f">Q{len(nodes)}Q", len(nodes), *nodes)


def merkle_unpack(data: bytes) -> list[int]:
    return list(struct.unpack_from(f">{struct.unpack_from('>Q', data)[0]}Q", data, 8))
