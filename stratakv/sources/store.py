"""Runs on disk with a manifest: flush, compaction that replaces its inputs, and reads that touch only runs in question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.operators.merge import live_state, lww
from stratakv.sources.wal import write_run
from stratakv.sources.workspace import filesystem, remove


class RunStore:
    """Runs under path/runs/level=L/run_id=R. path/manifest/version=V lists those that count, one row a run.

    A version is written as a whole and never changed, so readers see the runs before a compaction or those after it.
    Keys' ranges and counts in the manifest are per run; records stay in their files.
    """

    def __init__(self, spark: SparkSession, path: str, tables: int = 4, max_level: int = 4):
        self.spark, self.path, self.tables, self.max_level = spark, path, tables, max_level

    def runs(self) -> list[dict]:
        """The manifest's newest version, newest runs of the lowest level first."""
        fs, where = filesystem(self.spark, f"{self.path}/manifest")
        versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where)] if fs.exists(where) else []
        if not versions:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={max(versions)}").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: (r["level"], -r["run_id"]))

    def _commit(self, runs: list[dict], version: int) -> None:
        kinds = "level int, run_id long, version long, min_key string, max_key string, n_records long, max_seq long"
        names = [k.split()[0] for k in kinds.split(", ")]
        self.spark.createDataFrame([tuple(r[n] for n in names) for r in runs], kinds).coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    def _write(self, rows: DataFrame, level: int, run_id: int, version: int) -> dict | None:
        write_run(rows, f"{self.path}/runs", level, run_id)
        own = self._files([{"level": level, "run_id": run_id}])
        found = own.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_records"), F.max("seq").alias("max_seq")).collect()[0].asDict()
        return found | {"level": level, "run_id": run_id, "version": version} if found["n_records"] else None

    def _files(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/level={r['level']}/run_id={r['run_id']}" for r in runs])

    def flush(self, log: DataFrame) -> None:
        """One more run of level 0, the newest version of every key in log."""
        runs = self.runs()
        version = max((r["version"] for r in runs), default=0) + 1
        new = self._write(lww(log), 0, version, version)
        if new:
            self._commit([*runs, new], version)

    def compact(self, level: int) -> bool:
        """All runs of a level become one of the next, if they are `tables` or more; the inputs go once the manifest has the new run."""
        runs = self.runs()
        own = [r for r in runs if r["level"] == level]
        if len(own) < self.tables or level >= self.max_level - 1:
            return False
        version = max(r["version"] for r in runs) + 1
        merged = self._write(lww(self._files(own)), level + 1, version, version)
        self._commit([r for r in runs if r["level"] != level] + [merged], version)
        for r in own:
            remove(self.spark, f"{self.path}/runs/level={r['level']}/run_id={r['run_id']}")
        return True

    def within(self, low: str, high: str) -> DataFrame | None:
        """Records between two keys, of the runs whose range meets theirs; the filter goes on to files and row groups."""
        met = [r for r in self.runs() if r["min_key"] <= high and r["max_key"] >= low]
        return self._files(met).where(F.col("key").between(low, high)) if met else None

    def get(self, key: str) -> DataFrame | None:
        """The key's live record, from the runs whose range has it; their Bloom filters and min-max statistics skip files. None: no run has the range."""
        rows = self.within(key, key)
        return None if rows is None else live_state(rows.where(F.col("key") == key))

    def multi_get(self, keys: DataFrame) -> DataFrame | None:
        """Live records of the keys, read from the runs that their range meets."""
        ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()[0]
        rows = None if ends["low"] is None else self.within(ends["low"], ends["high"])
        return None if rows is None else live_state(rows.join(keys.select("key").distinct(), "key", "left_semi"))

    def state(self) -> DataFrame | None:
        runs = self.runs()
        return live_state(reduce(DataFrame.unionByName, [self._files([r]) for r in runs])) if runs else None
