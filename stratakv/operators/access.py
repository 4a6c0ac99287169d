"""Point reads, scans, paging and stepping over the current state. Key predicates reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.operators.merge import live_state, lww
from stratakv.sources.workspace import part_bounds, sorted_parts

#: Last `_` parts of keys kept for sketches, and the empty one.
RESERVED = ["bf", "hll", "cms", "sh", ""]


def key_valid(key: Column) -> Column:
    """Whether users may write the key: the part after its last `_` isn't reserved."""
    return ~F.substring_index(key, "_", -1).isin(RESERVED)


def state(log: DataFrame, include_tombstones: bool = False) -> DataFrame:
    return lww(log) if include_tombstones else live_state(log)


def get(log: DataFrame, key: str) -> DataFrame:
    return live_state(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows of the keys in `keys`; Spark broadcasts that side only while its size allows."""
    return live_state(log.join(keys.select("key").distinct(), "key", "left_semi"))


def exists(keys: DataFrame, log: DataFrame) -> DataFrame:
    return keys.join(live_state(log).select("key"), "key", "left_semi")


def missing(keys: DataFrame, log: DataFrame) -> DataFrame:
    return keys.join(live_state(log).select("key"), "key", "left_anti")


def prefix(log: DataFrame, start: str, include_tombstones: bool = False) -> DataFrame:
    return state(log.where(F.col("key").startswith(start)), include_tombstones)


def between(log: DataFrame, low: str, high: str, include_tombstones: bool = False) -> DataFrame:
    """Both ends included; none when low is above high."""
    return state(log.where(F.col("key").between(low, high)), include_tombstones)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of `size` rows in key order: one top-k, no full sort."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return rows.orderBy("key").offset(size * (number - 1)).limit(size)


def page_prev(rows: DataFrame, number: int, size: int) -> DataFrame:
    return page(rows, max(number - 1, 1), size)


def walk(rows: DataFrame) -> DataFrame:
    """Every key with the keys before and after it in the order of all keys.

    Ranges of keys are sorted each in its task; only where a range ends does the next one's first key come from the ranges' bounds.
    """
    parts = sorted_parts(rows, "key", "walk")
    order = Window.partitionBy("part").orderBy("place")
    bounds = F.broadcast(part_bounds(parts, "key").drop("before"))  # one row a range
    near = parts.withColumn("prev_key", F.lag("key").over(order)).withColumn("next_key", F.lead("key").over(order)).join(bounds, "part")
    return near.select(*rows.columns, F.coalesce("prev_key", "key_before").alias("prev_key"), F.coalesce("next_key", "key_after").alias("next_key"))


class Cursor:
    """Steps through a scan a key at a time, forwards and back. A step past the keys at hand reads the next `ahead` keys at once."""

    def __init__(self, rows: DataFrame, history: int = 50, ahead: int = 100):
        self.rows, self.history, self.ahead = rows, history, ahead
        self.stop()

    def next(self) -> str | None:
        if self.place + 1 == len(self.keys) and not self.ended:
            rows = self.rows.where(F.col("key") > self.keys[-1]) if self.keys else self.rows
            found = [r["key"] for r in rows.orderBy("key").select("key").head(self.ahead)]
            self.ended = len(found) < self.ahead
            self.keys += found
        if self.place + 1 == len(self.keys):
            return None
        self.place += 1
        gone = max(self.place - self.history + 1, 0)  # steps back go no further than the history
        self.keys, self.place = self.keys[gone:], self.place - gone
        return self.keys[self.place]

    def prev(self) -> str | None:
        if self.place <= 0:
            return None
        self.place -= 1
        return self.keys[self.place]

    def stop(self) -> None:
        self.keys, self.place, self.ended = [], -1, False


def min_key_sources(log: DataFrame, source: str) -> DataFrame:
    """Sources that hold the smallest key, newest version first."""
    least = log.agg(F.min("key").alias("least"))
    newest = Window.orderBy(F.col("change_time").desc(), F.col("seq").desc())
    held = log.join(F.broadcast(least), F.col("key") == F.col("least")).groupBy(source, "key").agg(F.max("change_time").alias("change_time"), F.max("seq").alias("seq"))
    return held.withColumn("age", F.row_number().over(newest))


def first_per_run(log: DataFrame, run: str, n: int) -> DataFrame:
    """The first n rows without a tombstone of every run, in key order: the bulk form of a scan."""
    order = Window.partitionBy(run).orderBy("key", F.col("seq").desc())
    return log.where(~F.col("tombstone")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def most_recent(log: DataFrame, n: int) -> DataFrame:
    """The n keys used last, as a cache of that capacity holds them."""
    return log.groupBy("key").agg(F.max("change_time").alias("last_used"), F.max("seq").alias("last_seq")).orderBy(F.desc("last_used"), F.desc("last_seq")).limit(n)
