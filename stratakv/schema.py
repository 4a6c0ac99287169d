"""The record log: its columns, the engine's settings, and the adapter that makes a log of the events table."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.sources.shipping import ship

LOG = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("change_time", T.TimestampNTZType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)


@dataclass
class Config:
    """Settings with the defaults that hold when a setting is missing; `load` puts in others for invalid ones."""

    lruCap: int = 2
    compress: bool = False
    dictEncoding: bool = False
    oneFile: bool = False
    numberOfSSTable: int = 5
    memTableNumber: int = 2
    memTableCap: int = 5
    indexEl: int = 0
    summaryEl: int = 0
    memType: str = "hash"
    walSegmentSize: int = 2000
    rate: int = 3
    maxToken: int = 10
    compType: str = "size"
    maxSSTLevel: int = 4
    levelPlus: int = 12
    probab: float = 0.01

    #: What takes the place of a number that isn't positive.
    INVALID = {"lruCap": 2, "numberOfSSTable": 3, "memTableNumber": 2, "memTableCap": 5, "rate": 2, "maxToken": 10, "maxSSTLevel": 3, "levelPlus": 10}

    @classmethod
    def load(cls, text: str) -> Config:
        given = json.loads(text)
        known = {f.name for f in fields(cls)}
        own = cls(**{k: v for k, v in given.items() if k in known})
        for name, value in cls.INVALID.items():
            if getattr(own, name) <= 0:
                setattr(own, name, value)
        cap = own.memTableCap
        for name, part in (("indexEl", 3), ("summaryEl", 2)):
            if name not in given:
                setattr(own, name, max(cap // part, 1))
            elif not 0 < getattr(own, name) < cap:
                setattr(own, name, 1)
        if own.summaryEl < own.indexEl:
            own.summaryEl = own.indexEl + 1
        own.walSegmentSize = max(own.walSegmentSize, 1000)
        if own.memType not in ("hash", "btree", "skipl"):
            own.memType = "hash"
        if own.compType not in ("size", "level"):
            own.compType = "size"
        if own.probab > 0.1 or own.probab <= 0:
            own.probab = 0.01
        return own


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: a user's last digit slot is the key, `error` deletes it, any other event puts its value."""
    ship(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tombstone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("/"), (F.col("event_id") % 10).cast("string")).alias("key"),
        F.when(~tombstone, F.col("value")).alias("value"),
        tombstone.alias("tombstone"),
        F.col("ts").alias("change_time"),
        F.col("event_id").alias("seq"),
    )
