"""The log as a stream: flushing micro-batches to runs, and a token bucket that keeps its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratakv.operators.merge import lww
from stratakv.schema import LOG
from stratakv.sources.wal import write_run


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def flush_to_runs(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch becomes the run of level 0 with its number; a repeated batch overwrites its own run."""

    def flush(batch: DataFrame, number: int) -> None:
        write_run(lww(batch), path, 0, number)

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_bucket_stream(requests: DataFrame, by: str, rate: int, most: int, cost: int = 1, unit_seconds: int = 1) -> DataFrame:
    """by, ts, allowed of a stream of requests; each key keeps its tokens and the time it last gained any."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows = rows.sort_values([c for c in ("ts", "event_id") if c in rows.columns])
        tokens, last = state.get if state.exists else (most, int(rows["ts"].iloc[0].value // 1_000_000_000))
        allowed = []
        for ts in rows["ts"]:
            now = int(ts.value // 1_000_000_000)
            add = (now - last) // unit_seconds * rate
            if add:
                tokens, last = min(most, tokens + add), now
            allowed.append(tokens >= cost)
            tokens -= cost if tokens >= cost else 0
        state.update((tokens, last))
        yield pd.DataFrame({by: key[0], "ts": rows["ts"], "allowed": allowed})

    kind = requests.schema[by].dataType.simpleString()
    stamp = requests.schema["ts"].dataType.simpleString()
    return requests.groupBy(F.col(by)).applyInPandasWithState(step, f"{by} {kind}, ts {stamp}, allowed boolean", "tokens bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
