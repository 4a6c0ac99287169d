"""Language-model scoring from a log-frequency Bloom filter over n-gram counts.

Counting: every task sums the unigrams and bigrams of some millions of words, packs the sums by shard of their hash,
and one group per shard merges them. Each shard becomes a piece of the filter: an n-gram whose count falls in level q
of a logarithmic scale is entered q times, as (n-gram, 1) .. (n-gram, q), so its level is found again by probing until
a probe misses. Scoring: the pieces go to the workers as one broadcast while their measured size is below a bound;
beyond it, batches of documents are written as places among their kinds of words, send their distinct n-grams to the
pieces, as gaps between sorted hashes, and get a byte for each back, in the same order, with the same result.

Words are 64-bit hashes throughout (two words of a corpus of ten million types collide with probability 3e-6), bigrams
48-bit ones (one that is not among 10^10 learnt ones equals one of them with probability 4e-5, a false probe's is 4e-3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import by_shard, gathered, input_bytes, joined, mix, shard_bits, slices, small_batches, sum_by_key, text_bytes, words_of, written

END = np.uint64(0xA0761D6478BD642F)
START = np.uint64(0xE7037ED1A0B428DB)
UNI, BI = 1, 2
#: Words whose sums are packed at a time.
FLUSH = 2_000_000
#: Bytes of text scored at a time.
SLICE = 8 << 20
#: Keys that go to or from the JVM in one record batch.
PARCEL = 1 << 19
#: Bits of the first level keep unseen n-grams out; those above only tell levels apart. WORD bits at most lie in one 64-bit word.
FIRST, MORE, WORD = 8, 3, 4
BITS_PER_ENTRY = 1.6
#: Ratio of a level's counts to those of the level below, by n-gram order.
STEP = {UNI: 1.25, BI: 1.6}
#: Interpolation weights of the bigram estimate; a document's probability is the mean over them.
BLEND = (0.0, 0.4, 0.8)


def level_of(counts: np.ndarray, order: int) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(STEP[order]) + 1e-9).astype(np.int64)


def bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word) & ~np.uint64(0xFFFF)


def sequence(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every row, its end among them; the token before each, START for the first; the n + 1 row offsets."""
    n = len(at) - 1
    edges = at + np.arange(n + 1)
    token = np.empty(len(words) + n, np.uint64)
    ends = edges[1:] - 1
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = words, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[edges[:-1]] = START
    return token, before, edges


def squeezed(keys: np.ndarray, runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Each run of sorted keys as its first key and the gaps between them, bytes by significance: most are 0 and compress."""
    gap = np.diff(keys, prepend=np.uint64(0))
    start = [a for _, a, _ in runs]
    gap[start] = keys[start]
    byte = gap.view(np.uint8).reshape(-1, 8)
    return [byte[a:b].T.tobytes() for _, a, b in runs]


def unsqueezed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all runs, one after the other, and how many each has."""
    size = np.array([len(b) // 8 for b in blobs], np.int64)
    end = np.cumsum(size)
    byte = np.empty((int(size.sum()), 8), np.uint8)
    for blob, n, stop in zip(blobs, size.tolist(), end.tolist(), strict=True):
        byte[stop - n : stop] = np.frombuffer(blob, np.uint8).reshape(8, n).T
    gap = byte.view(np.uint64).reshape(-1)
    total = np.cumsum(gap)
    full = size > 0
    start = (end - size)[full]
    return total - np.repeat(total[start] - gap[start], size[full]), size


def parcels(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs in lists of about PARCEL keys, one run at least."""
    low = 0
    for i, (_, _, stop) in enumerate(runs):
        if i + 1 == len(runs) or stop - runs[low][1] >= PARCEL:
            yield runs[low : i + 1]
            low = i + 1


def probed(keys: np.ndarray, level: int, group: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word of a piece that holds the key's bits of this level and group, and their places in it, 6 bits each."""
    h = mix(keys + np.uint64((level * 64 + group + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
    return (((h >> np.uint64(32)) * words) >> np.uint64(32)).view(np.int64), h


def groups_of(level: int) -> list[int]:
    """Bits in each word probed for a level."""
    n = FIRST if level == 1 else MORE
    return [min(WORD, n - i) for i in range(0, n, WORD)]


def places(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for i in range(n):
        yield (h >> np.uint64(6 * i)) & np.uint64(63)


def filter_piece(keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
    """Cells and bits of one shard's filter."""
    entries = len(keys) * FIRST + int((levels - 1).sum()) * MORE
    cells = max(64, int(entries * BITS_PER_ENTRY) // 64 * 64 + 64)
    hit = np.zeros(cells, bool)
    level = 1
    while len(keys):
        for group, n in enumerate(groups_of(level)):
            at, h = probed(keys, level, group, np.uint64(cells // 64))
            for place in places(h, n):
                hit[(at << 6) + place.view(np.int64)] = True
        level += 1
        on = levels >= level
        keys, levels = keys[on], levels[on]
    return cells, np.packbits(hit, bitorder="little").tobytes()


@dataclass
class Filter:
    """Pieces of one n-gram order, laid end to end, and the mean count of each level."""

    bits: int
    first: np.ndarray
    cells: np.ndarray
    data: np.ndarray
    value: np.ndarray

    def levels(self, keys: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Level of each key, some thousands at a time, which stay in the processor's cache."""
        return np.concatenate([np.zeros(0, np.int64), *[self._levels(keys[i : i + step]) for i in range(0, len(keys), step)]])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        data = self.data.view(np.uint64)
        out = np.zeros(len(keys), np.int64)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero(self.cells[shard] > 0)
        keys, first, words = keys[left], self.first[shard[left]] >> 3, (self.cells[shard[left]] >> 6).astype(np.uint64)
        level = 1
        while len(left) and level < len(self.value):
            for group, n in enumerate(groups_of(level)):
                at, h = probed(keys, level, group, words)
                mask = np.zeros(len(h), np.uint64)
                for place in places(h, n):
                    mask |= np.uint64(1) << place
                stays = data[first + at] & mask == mask
                left, keys, first, words = left[stays], keys[stays], first[stays], words[stays]
            out[left] = level
            level += 1
        return out


@dataclass
class Model:
    """total and kinds: N and V of the training tokens. merged: the shards, with exact unigram counts, in the shared folder."""

    total: int
    kinds: int
    bits: int
    merged: DataFrame
    values: dict[int, np.ndarray]
    filter_bytes: int
    frequent_from: int


def learn(docs: DataFrame, frequent: int = 1 << 20) -> Model:
    """Counts, filter pieces and statistics of all of docs.text; nulls count as empty texts.

    `frequent` bounds the unigrams whose exact counts are broadcast for the base score.
    """
    small_batches(docs)
    bits = shard_bits(input_bytes(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, before = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            for order in (UNI, BI):
                keys, counts = np.unique(token if order == UNI else bigrams(before, token), return_counts=True)
                if order == UNI:
                    at = np.searchsorted(keys, START)
                    keys, counts = np.insert(keys, at, START), np.insert(counts, at, rows)
                for some in parcels(by_shard(keys, bits)):
                    yield pa.RecordBatch.from_pydict({"ngram": pa.array([order] * len(some), pa.int32()), "shard": pa.array([s for s, _, _ in some], pa.int32()), "keys": pa.array(squeezed(keys, some), pa.binary()), "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for _, a, b in some], pa.binary())})

        for batch in slices(batches, "text"):
            token, before, _ = sequence(*words_of(*text_bytes(batch.column("text"))))
            held.append((token, before))
            size, rows = size + len(token), rows + batch.num_rows
            if size >= FLUSH:
                yield from flush()
                size = rows = 0
        if rows:
            yield from flush()

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        order, shard = key[0].as_py(), key[1].as_py()
        keys, counts = sum_by_key(unsqueezed(group.column("keys").to_pylist())[0], joined(group.column("counts"), np.uint32).astype(np.int64))
        levels = level_of(counts, order)
        cells, data = filter_piece(keys, levels)
        most = int(levels.max()) + 1
        word = keys != START
        row = {
            "ngram": order, "shard": shard, "cells": cells, "data": data,
            "level_n": np.bincount(levels, minlength=most).tolist(), "level_sum": np.bincount(levels, counts, most).tolist(),
            "total": int(counts[word].sum()) if order == UNI else 0, "kinds": int(word.sum()) if order == UNI else 0,
            "keys": keys.tobytes() if order == UNI else b"", "counts": counts.tobytes() if order == UNI else b"",
        }
        return pa.table({k: [v] for k, v in row.items()}, schema=pa.schema(fields))

    fields = [("ngram", pa.int32()), ("shard", pa.int32()), ("cells", pa.int64()), ("data", pa.binary()), ("level_n", pa.list_(pa.int64())), ("level_sum", pa.list_(pa.float64())), ("total", pa.int64()), ("kinds", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
    merged = docs.select("text").mapInArrow(count, "ngram int, shard int, keys binary, counts binary").groupBy("ngram", "shard").applyInArrow(merge, "ngram int, shard int, cells long, data binary, level_n array<long>, level_sum array<double>, total long, kinds long, keys binary, counts binary")
    merged = written(merged, "lm-shards", free=True)
    levels = merged.select("ngram", F.posexplode(F.arrays_zip("level_n", "level_sum")).alias("level", "x"))
    stats = levels.groupBy("ngram", "level").agg(F.sum("x.level_n").alias("n"), F.sum("x.level_sum").alias("s")).collect()
    values = {}
    frequent_from = 1
    for order in (UNI, BI):
        own = sorted((r["level"], r["n"], r["s"]) for r in stats if r["ngram"] == order)
        means = [0.0]
        for _, n, s in own[1:]:  # a probe may err upwards, so a level that nothing has counts as the one below
            means.append(s / n if n else means[-1])
        values[order] = np.array(means)
        if order == UNI:
            above = 0
            for level, n, _ in reversed(own):
                above += n
                if above > frequent:
                    frequent_from = int(np.ceil(STEP[UNI] ** level - 1e-9))
                    break
    whole = merged.agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"), F.sum(F.octet_length("data")).alias("size")).collect()[0]
    return Model(whole["total"] or 0, whole["kinds"] or 0, bits, merged, values, whole["size"] or 0, frequent_from)


def filters(model: Model) -> dict[int, Filter]:
    """The whole filter on the driver; its size has been checked before."""
    out = {}
    for order in (UNI, BI):
        first, cells = np.zeros(1 << model.bits, np.int64), np.zeros(1 << model.bits, np.int64)
        parts, at = [], 0
        for row in model.merged.where(F.col("ngram") == order).select("shard", "cells", "data").toLocalIterator():
            first[row["shard"]], cells[row["shard"]] = at, row["cells"]
            parts.append(np.frombuffer(row["data"], np.uint8))
            at += len(parts[-1])
        out[order] = Filter(model.bits, first, cells, np.concatenate(parts) if parts else np.zeros(8, np.uint8), model.values[order])
    return out


def frequent_counts(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the unigrams counted frequent_from times or more, in order."""
    least = model.frequent_from

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = joined(batch.column("keys"), np.uint64), joined(batch.column("counts"), np.int64)
            on = (counts >= least) & (keys != START)
            yield pa.RecordBatch.from_pydict({"keys": [keys[on].tobytes()], "counts": [counts[on].tobytes()]})

    rows = model.merged.where(F.col("ngram") == UNI).select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def document_scores(own: np.ndarray, context: np.ndarray, pair: np.ndarray, edges: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """log10 probability of each row from its tokens' counts, those of the tokens before them, and those of the pairs."""
    base = (own + 1) / (total + kinds + 1)
    log_base = np.log10(base)
    seen = np.flatnonzero((pair > 0) & (own > 0) & (context > 0))
    ratio = np.minimum(pair[seen] / context[seen], 1.0)
    each = []
    for blend in BLEND:
        part = log_base + np.log10(1 - blend) * (context > 0)
        part[seen] = np.log10(blend * ratio + (1 - blend) * base[seen])
        each.append(np.add.reduceat(part, edges[:-1]))
    each = np.array(each)
    most = each.max(0)
    return most + np.log10(np.power(10.0, each - most).mean(0))


def after(values: np.ndarray, edges: np.ndarray, first: float | np.uint64) -> np.ndarray:
    """Each token's predecessor's value; `first` at the starts of rows."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[edges[:-1]] = first
    return out


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = 192 << 20) -> DataFrame:
    """`keep`, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    score is the log10 probability of the whole text and its end: per token the bigram and the add-one unigram
    estimate from the filter are interpolated, and the text's probability is the mean over the weights in BLEND, so a
    text that shares nothing with the training text stays near its unigram probability. base_score uses exact counts:
    those of frequent words (a bounded table) come by broadcast; the rest of each document's words meet theirs in a
    shuffle by shard. Null and empty texts have one token, the end. Rows keep their multiplicity. With nothing learnt
    every token has probability 1.
    """
    small_batches(docs)
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent_counts(model))
    in_memory = model.filter_bytes <= broadcast_bytes
    shared = spark.sparkContext.broadcast(filters(model)) if in_memory else None
    values, total, kinds, bits = model.values, model.total, model.kinds, model.bits
    smooth = np.log10(total + kinds + 1)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    blob = pa.binary()
    extra = {"kind": pa.int32(), "row_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "shard": pa.int32(), "batch_id": pa.int64(), "rows": blob, "keys": blob, "times": blob}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_counts = hot.value
        known = shared.value if shared else None
        serial = TaskContext.get().partitionId() << 36
        for batch in slices(gathered(batches, "text", SLICE), "text", SLICE):

            def emit(m: int, has: dict, kept: list | None = None) -> pa.RecordBatch:
                own = [pa.array(has[c], t) if c in has else pa.nulls(m, t) for c, t in extra.items()]
                return pa.RecordBatch.from_arrays([*(kept or [pa.nulls(m, batch.schema.field(c).type) for c in keep]), *own], names=[*keep, *extra])

            n = batch.num_rows
            token, before, edges = sequence(*words_of(*text_bytes(batch.column("text"))))
            row = np.repeat(np.arange(n), np.diff(edges))
            kind, inverse = np.unique(token, return_inverse=True)
            at = np.minimum(np.searchsorted(hot_keys, kind), max(len(hot_keys) - 1, 0))
            is_hot = hot_keys[at] == kind if len(hot_keys) else np.zeros(len(kind), bool)
            log_count = np.where(is_hot, np.log10((hot_counts[at] if len(hot_keys) else 0) + 1.0), 0.0)
            cold = ~is_hot[inverse]
            base = np.bincount(row, log_count[inverse], n) - np.diff(edges) * smooth
            ident = serial + np.arange(n)
            serial += n
            scores = None
            if known:
                own = values[UNI][known[UNI].levels(kind)][inverse]
                context = after(own, edges, values[UNI][known[UNI].levels(np.array([START]))[0]])
                pair = np.zeros(len(token))
                likely = np.flatnonzero((own > 0) & (context > 0))
                pair[likely] = values[BI][known[BI].levels(bigrams(before[likely], token[likely]))]
                scores = document_scores(own, context, pair, edges, total, kinds)
            doc = {"kind": np.zeros(n), "row_id": ident, "n_tokens": np.diff(edges), "n_known": np.bincount(row, ~cold, n).astype(np.int64), "base": base}
            yield emit(n, doc | ({} if scores is None else {"score": scores}), [batch.column(c) for c in keep])
            rows, keys = ident[row[cold]], token[cold]
            if len(keys):
                order = np.lexsort((rows, keys))
                rows, keys = rows[order], keys[order]
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
                often = np.diff(np.append(new, len(keys)))
                rows, keys = rows[new], keys[new]
                some = by_shard(keys, bits)
                yield emit(len(some), {"kind": [1] * len(some), "shard": [s for s, _, _ in some], "rows": [rows[a:b].tobytes() for _, a, b in some], "keys": [keys[a:b].tobytes() for _, a, b in some], "times": [often[a:b].astype(np.int64).tobytes() for _, a, b in some]})
            if not known:
                yield emit(1, {"kind": [2], "batch_id": [int(ident[0])], "keys": squeezed(kind, [(0, 0, len(kind))]), "rows": [inverse.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()], "times": [np.diff(edges).astype(np.uint32).tobytes()]})

    def look_up(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        known, counts = joined(there.column("keys"), np.uint64), joined(there.column("counts"), np.int64)
        rows, keys, times = (joined(asked.column(c), t) for c, t in (("rows", np.int64), ("keys", np.uint64), ("times", np.int64)))
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        count = np.where(known[at] == keys, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)
        row, of = np.unique(rows, return_inverse=True)
        return pa.table({"row_id": row, "cold_known": np.bincount(of, np.where(count > 0, times, 0), len(row)).astype(np.int64), "cold_base": np.bincount(of, times * np.log10(count + 1.0), len(row))}, schema=pa.schema([("row_id", pa.int64()), ("cold_known", pa.int64()), ("cold_base", pa.float64())]))

    own = ", ".join(f"{c} {'long' if t == pa.int64() else 'int' if t == pa.int32() else 'double' if t == pa.float64() else 'binary'}" for c, t in extra.items())
    measured = written(docs.select(*keep, "text").mapInArrow(measure, f"{kept}, {own}"), "lm-scores", block=16 << 20)
    asked = measured.where("kind = 1").select("shard", "rows", "keys", "times")
    there = model.merged.where(F.col("ngram") == UNI).select("shard", "keys", "counts")
    cold = asked.groupBy("shard").cogroup(there.groupBy("shard")).applyInArrow(look_up, "row_id long, cold_known long, cold_base double")
    cold = cold.groupBy("row_id").agg(F.sum("cold_known").alias("cold_known"), F.sum("cold_base").alias("cold_base"))
    rows = measured.where("kind = 0").join(cold, "row_id", "left")
    if not in_memory:
        rows = rows.drop("score").join(routed_scores(measured, model), "row_id")
    return rows.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def routed_scores(measured: DataFrame, model: Model) -> DataFrame:
    """row_id, score: distinct n-grams of each batch of rows go to their piece of the filter, and the levels come back."""
    values, total, kinds, bits = model.values, model.total, model.kinds, model.bits

    def tokens(keys: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of words of a batch in order, and the place among them of every token."""
        return unsqueezed(keys.to_pylist())[0], np.frombuffer(rows[0].as_py(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1)

    def pairs(kind: np.ndarray, place: np.ndarray, times: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        edges = np.concatenate([[0], np.cumsum(joined(times, np.uint32).astype(np.int64))])
        token = kind[place]
        return bigrams(after(token, edges, START), token), edges

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some_rows in batches:
            for i in range(some_rows.num_rows):
                row = some_rows.slice(i, 1)
                kind, place = tokens(row.column("keys"), row.column("rows"))
                pair, _ = pairs(kind, place, row.column("times"))
                for ngram, asked in ((UNI, np.insert(kind, np.searchsorted(kind, START), START)), (BI, np.unique(pair, return_counts=True)[0])):
                    for some in parcels(by_shard(asked, bits)):
                        m = len(some)
                        yield pa.RecordBatch.from_pydict({"ngram": pa.array([ngram] * m, pa.int32()), "shard": pa.array([x for x, _, _ in some], pa.int32()), "batch_id": pa.array([row.column("batch_id")[0].as_py()] * m, pa.int64()), "keys": pa.array(squeezed(asked, some), pa.binary())})

    def probe(key: tuple, asked: pa.Table, piece: pa.Table) -> pa.Table:
        ngram, shard, n = key[0].as_py(), key[1].as_py(), asked.num_rows
        keys, size = unsqueezed(asked.column("keys").to_pylist())
        if piece.num_rows:
            own = Filter(1, np.zeros(2, np.int64), np.full(2, piece.column("cells")[0].as_py()), np.frombuffer(piece.column("data")[0].as_py(), np.uint8), values[ngram])
            level = own.levels(keys).astype(np.uint8)
        else:
            level = np.zeros(len(keys), np.uint8)
        replies = [x.tobytes() for x in np.split(level, np.cumsum(size)[:-1])] if n else []
        return pa.table({"batch_id": asked.column("batch_id"), "ngram": pa.array([ngram] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "levels": pa.array(replies, pa.binary())})

    def finish(key: tuple, batch: pa.Table, replies: pa.Table) -> pa.Table:
        kind, place = tokens(batch.column("keys"), batch.column("rows").combine_chunks())
        pair, edges = pairs(kind, place, batch.column("times"))

        def levels(ngram: int) -> np.ndarray:
            part = replies.filter(pc.equal(replies.column("ngram"), ngram))
            return joined(part.sort_by("shard").column("levels"), np.uint8)

        start, uni = np.searchsorted(kind, START), levels(UNI)
        own = values[UNI][np.delete(uni, start)[place]]
        context = after(own, edges, values[UNI][uni[start]])
        _, of = np.unique(pair, return_inverse=True)
        got = document_scores(own, context, values[BI][levels(BI)[of]], edges, total, kinds)
        return pa.table({"row_id": key[0].as_py() + np.arange(len(got)), "score": got})

    batches = measured.where("kind = 2").select("batch_id", "keys", "rows", "times")
    asked = batches.mapInArrow(ask, "ngram int, shard int, batch_id long, keys binary")
    pieces = model.merged.select("ngram", "shard", "cells", "data")
    replies = asked.groupBy("ngram", "shard").cogroup(pieces.groupBy("ngram", "shard")).applyInArrow(probe, "batch_id long, ngram int, shard int, levels binary")
    replies = written(replies, "lm-levels", block=16 << 20, free=True)
    return batches.groupBy("batch_id").cogroup(replies.groupBy("batch_id")).applyInArrow(finish, "row_id long, score double")
