"""Arrow text columns as flat byte arrays, token hashes, and tables written to the shared folder.

Python code of this package works on whole Arrow batches: the UTF-8 bytes of a text column lie in one buffer, so
splitting into words and hashing them are a few numpy passes with no loop over rows or words.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at a time; a longer document is cut between words.
SLICE_BYTES = 4 << 20
#: Spark's setting by which a query's shuffles are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, back: bool = False) -> np.ndarray:
    """Powers of the base, or of its inverse, from 0 to n at least."""
    if len(_powers[back]) <= n:
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if back else _BASE
        _powers[back] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), base, np.uint64)]))
    return _powers[back]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of raw."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~SPACE[raw]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]; spans are in order, apart and not empty.

    Sums of the codes of bytes times powers of an odd base by their place in the span, as differences of running sums over
    about `step` bytes at a time.
    """
    total = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        part = raw[start[i] : end[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * powers(max(len(part), step))[: len(part)], out=sums[1:])
        a = start[i:j] - start[i]
        total[i:j] = (sums[end[i:j] - start[i]] - sums[a]) * powers(step, back=True)[a]
        i = j
    return mix(total + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, A-Z lower-cased, and the n + 1 offsets of rows among the words."""
    n = len(offsets) - 1
    parts, counts = [], np.zeros(n, np.int64)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = raw[offsets[row] : offsets[stop]]
        if stop == row + 1:
            low = 0
            while low < len(part):  # one long document, cut after a space
                high = min(len(part), low + SLICE_BYTES)
                while high < len(part) and not SPACE[part[high - 1]]:
                    high += 1
                piece = LOWER[part[low:high]]
                got = span_hashes(piece, *word_spans(piece))
                parts.append(got)
                counts[row] += len(got)
                low = high
        else:
            piece = LOWER[part]
            start, end = word_spans(piece)
            edges = offsets[row : stop + 1] - offsets[row]
            cut = edges[1:-1]  # a word ends where its document does
            inner = cut[(cut > 0) & (cut < len(piece))]
            inner = np.unique(inner[~SPACE[piece[inner - 1]] & ~SPACE[piece[inner]]])
            if len(inner):
                start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
            parts.append(span_hashes(piece, start, end))
            counts[row:stop] = np.diff(np.searchsorted(start, edges))
        row = stop
    at = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), at


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least."""
    for batch in batches:
        _, at = text_bytes(batch.column(text))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def gathered(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[pa.RecordBatch]:
    """The same rows, batches put together until they hold `least` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(text_bytes(batch.column(text))[1][-1])
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Have Spark hand texts to Python in smaller batches than usual, unless the session asks for still smaller ones.

    Ten thousand whole texts a batch would take more memory, on both sides, than all else that a task holds.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > rows or int(conf.get(name)) <= 0:
        conf.set(name, rows)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The arrays packed in a binary column, one after the other."""
    raw, _ = text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(raw.tobytes(), kind)


def by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Shard, start and end of each run of sorted keys with the same upper bits."""
    if not len(keys):
        return []
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def shard_bits(size: int, each: int = 4 << 20) -> int:
    """Bits that name shards of about `each` of `size` bytes of input."""
    return max(5, (max(size, 1) // each).bit_length())


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own, for tests, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_folder", None)
    if not folder:
        folder = spark._own_folder = "file://" + tempfile.mkdtemp(prefix="stratakv-")
    return folder


def written(df: DataFrame, name: str, files: int | None = None, block: int | None = None, free: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a lost executor costs no earlier step.

    files: at most so many, for tables known to be small. block: bytes of a row group, for rows with long binary values.
    free: the shuffles it took are removed as soon as it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    had = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        (df if files is None else df.coalesce(files)).write.options(**({"parquet.block.size": block} if block else {})).parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)
    atexit.register(_removed, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    _removed(df.sparkSession, df._written_to)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended before
        pass


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that none of `taken` has, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Size of df's input as its plan's statistics have it; of its texts, measured, where they say nothing or guess at a join."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < 1 << 60 and "Join" not in plan.toString():
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).collect()[0]["size"]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
