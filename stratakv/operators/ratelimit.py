"""Token buckets over request logs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_bucket(events: DataFrame, by: str, rate: int, most: int, cost: int = 1, unit_seconds: int = 1) -> DataFrame:
    """by, n_requests, n_allowed: each key's requests in the order of (ts, event_id), its bucket full at the first.

    A bucket gains rate tokens for every whole unit since it last gained any. The fold isn't associative, so one task
    reads a key's requests in order; it holds one bucket at a time and no list of requests, however many a key has.
    Requests without a time are left out.
    """
    stamp = events.schema["ts"].dataType.simpleString()
    micros = F.expr(f"timestampdiff(MICROSECOND, CAST('1970-01-01' AS {stamp}), ts)")
    ordered = events.where(F.col("ts").isNotNull()).select(F.col(by).alias("by"), micros.alias("at"), "event_id").repartition("by").sortWithinPartitions("by", "at", "event_id").select("by", "at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, last, n, ok = None, 0, 0, 0, 0
        for batch in batches:
            done: dict[str, list] = {"by": [], "n_requests": [], "n_allowed": []}
            for key, at in zip(batch.column("by").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if n == 0 or key != held:
                    if n:
                        done["by"].append(held), done["n_requests"].append(n), done["n_allowed"].append(ok)
                    held, tokens, last, n, ok = key, most, at, 0, 0
                gained = (at - last) // 1_000_000 // unit_seconds * rate
                if gained:
                    tokens, last = min(most, tokens + gained), at
                n += 1
                if tokens >= cost:
                    tokens, ok = tokens - cost, ok + 1
            yield pa.RecordBatch.from_arrays([pa.array(done["by"], batch.schema.field("by").type), pa.array(done["n_requests"], pa.int64()), pa.array(done["n_allowed"], pa.int64())], names=list(done))
            kind = batch.schema.field("by").type
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([n], pa.int64()), pa.array([ok], pa.int64())], names=["by", "n_requests", "n_allowed"])

    folded = ordered.mapInArrow(fold, f"by {events.schema[by].dataType.simpleString()}, n_requests long, n_allowed long")
    return folded.withColumnRenamed("by", by)


def append_requests(spark: SparkSession, path: str, requests: DataFrame) -> None:
    """Requests (t, tokens, verdict) as lines at the end of the log, which begins with the first of them."""
    requests.select(F.concat_ws(", ", "t", F.col("tokens").cast("string"), "verdict").alias("value")).write.mode("append").text(path)


def parse_requests(lines: DataFrame) -> DataFrame:
    """Lines `HH:mm:ss, tokens, verdict` -> t, tokens, verdict."""
    parts = F.split("value", ", ")
    return lines.select(parts[0].alias("t"), parts[1].cast("int").alias("tokens"), parts[2].alias("verdict"))


def request_summary(requests: DataFrame) -> DataFrame:
    return requests.groupBy("verdict").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def bucket_pack(rate: int, most: int, tokens: int, last_nanos: int) -> bytes:
    return struct.pack("<qqqq", rate, most, tokens, last_nanos)


def bucket_unpack(data: bytes) -> tuple[int, int, int, int]:
    return struct.unpack("<qqqq", data)
