"""Sketches as values of a log with binary values, under a user's key and the sketch's ending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.operators.merge import live_state, put, union_runs

#: Endings of keys that hold sketches.
ENDING = {"bloom": "_bf", "cms": "_cms", "hll": "_hll", "simhash": "_sh"}


def create(log: DataFrame, key: str, kind: str, value: bytes, change_time: Column, seq: Column) -> DataFrame:
    """The log with the sketch put, or as it is where the key holds one of that kind already."""
    name = key + ENDING[kind]
    new = put(log.limit(0), F.lit(name), F.lit(bytearray(value)), change_time, seq)
    held = live_state(log.where(F.col("key") == name)).select("key")
    return union_runs(log, new.join(held, "key", "left_anti").select(log.columns))


def replace(log: DataFrame, key: str, kind: str, value: bytes, change_time: Column, seq: Column) -> DataFrame:
    """The log with a newer version of the sketch, as after adding to it."""
    return put(log, F.lit(key + ENDING[kind]), F.lit(bytearray(value)), change_time, seq)


def remove(log: DataFrame, key: str, kind: str, change_time: Column, seq: Column) -> DataFrame:
    return put(log, F.lit(key + ENDING[kind]), F.lit(None), change_time, seq)


def fetch(log: DataFrame, key: str, kind: str) -> bytes | None:
    rows = live_state(log.where(F.col("key") == key + ENDING[kind])).select("value").collect()
    return bytes(rows[0]["value"]) if rows else None
