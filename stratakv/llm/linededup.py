"""Line dedup: later copies of repeated runs of lines are deleted.

All documents' lines form one sequence, ordered by doc_id and line number and cut at the ends of documents. Its suffixes
are sorted by prefix doubling: the rank of a position at depth d is the number of positions whose next d lines come
before its own, and the pair of ranks at a position and d lines on gives the order at depth 2d. A pair goes to a range
of ranks, so a shard sorts its own part of the suffix array, and counts of the shards before it give the offset.
Positions of one rank at depth d are an interval of the suffix array whose longest common prefix is d lines or more;
its first position in the corpus is the copy that stays. A position alone in its interval has its final place and takes
no further part, nor does one whose next d lines no other position has: no longer run starts there. Doubling goes on
until no interval is left, that is beyond the longest repeated run. A maximal repeated run is the union of its
intervals' blocks, and the later copies' lines go.

A line's identity is the 128-bit hash of its bytes; ranks are exact from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import SPACE, discard, fresh, input_bytes, joined, named, slices, small_batches, text_bytes, written

#: Bytes of what positions ask that meet in one shard.
SHARD_BYTES = 4 << 20


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line (without its line feed), the n + 1 row offsets among them, and words of each line.

    A row of k line feeds has k + 1 lines; an empty row has none.
    """
    size = np.diff(offsets)
    feed = np.flatnonzero(raw == 10)
    full = np.flatnonzero(size > 0)
    start = np.sort(np.concatenate([offsets[full], feed + 1]))
    end = np.sort(np.concatenate([feed, offsets[full + 1]]))
    count = np.zeros(len(size), np.int64)
    count[full] = 1
    count += np.diff(np.searchsorted(feed, offsets))
    at = np.concatenate([[0], np.cumsum(count)])
    begins = np.zeros(len(raw) + 1, np.int64)
    solid = ~SPACE[raw]
    begins[1:] = np.cumsum(solid & np.concatenate([[True], ~solid[:-1]])) if len(raw) else 0
    words = begins[end] - begins[start]
    # a row may start within what looks like a word of the row before
    head = offsets[full][offsets[full] > 0]
    joined = head[solid[head] & solid[head - 1]]
    words[np.searchsorted(start, joined)] += 1
    return start, end, at, words


def line_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """16 bytes a line."""
    whole, digest = raw.tobytes(), xxhash.xxh3_128_digest
    return b"".join([digest(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the packed line ids and word counts of every row with a text and an id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            start, end, at, words = lines_of(raw, offsets)
            ids, words = line_ids(raw, start, end), words.astype(np.uint32)
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([ids[16 * a : 16 * b] for a, b in cut], pa.binary()), pa.array([words[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "digest", "ids", "words"])

    given = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return given.where(F.col("doc_id").isNotNull()).mapInArrow(read, "doc_id long, digest long, ids binary, words binary").dropDuplicates(["doc_id", "digest"])


def chunk_table(lines: DataFrame, most: int) -> DataFrame:
    """The packed lines in chunks of whole documents, in order: chunk numbers and places within order all positions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[dict] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            count = [len(d["words"]) // 4 for d in held]
            pack_of = {"doc_ids": np.array([d["doc_id"] for d in held], np.int64), "digests": np.array([d["digest"] for d in held], np.int64), "ends": np.cumsum(count).astype(np.int64)}
            row = {"chunk": [number], **{c: [v.tobytes()] for c, v in pack_of.items()}, "ids": [b"".join(d["ids"] for d in held)], "words": [b"".join(d["words"] for d in held)]}
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["words"]) // 4 + 1
                if size >= most:
                    yield chunk()
                    number, size = number + 1, 0
        if held:
            yield chunk()

    tasks = max(16, input_bytes(lines) // (8 << 20))
    ordered = lines.repartitionByRange(int(tasks), "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    return written(ordered.mapInArrow(pack, "chunk long, doc_ids binary, digests binary, ends binary, ids binary, words binary"), "line-chunks")


#: One row a chunk and kind. kind 0: places with an earlier copy at this depth. kind 1: places still in question, the
#: ends of their documents, and the two keys that order them. kind 2: distinct keys of a chunk for one shard, how often the
#: chunk has them, and where first.
STATE = "kind int, depth int, chunk long, shard long, places binary, ends binary, key1 binary, key2 binary, counts binary"
#: One row a chunk and shard: for the first place of a key in the chunk, the rank within the shard, the interval's size,
#: and whether an earlier chunk has it.
REPLY = "shard long, chunk long, total long, places binary, ranks binary, sizes binary, before binary"


def state_rows(rows: list[dict]) -> pa.Table:
    kinds = {"kind": pa.int32(), "depth": pa.int32(), "chunk": pa.int64(), "shard": pa.int64()}
    return pa.table({f.split()[0]: pa.array([r.get(f.split()[0]) for r in rows], kinds.get(f.split()[0], pa.binary())) for f in STATE.split(", ")})


def classes(key1: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct pair of keys, in order of the pairs, and each place's number among them."""
    order = np.lexsort((key2, key1))
    new = np.ones(len(order), bool)
    new[1:] = (key1[order[1:]] != key1[order[:-1]]) | (key2[order[1:]] != key2[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def questions(chunk: int, depth: int, places: np.ndarray, ends: np.ndarray, key1: np.ndarray, key2: np.ndarray, shard: np.ndarray) -> list[dict]:
    """The rows of kinds 1 and 2. shard: of each place, rising with the keys."""
    if not len(places):
        return []
    first, number = classes(key1, key2)
    counts = np.bincount(number, minlength=len(first))
    own = {"depth": depth, "chunk": chunk}
    rows = [own | {"kind": 1, "places": places.tobytes(), "ends": ends.tobytes(), "key1": key1.tobytes(), "key2": key2.tobytes()}]
    of = shard[first]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        these = first[a:b]
        rows.append(own | {"kind": 2, "shard": int(of[a]), "places": places[these].tobytes(), "key1": key1[these].tobytes(), "key2": key2[these].tobytes(), "counts": counts[a:b].astype(np.int64).tobytes()})
    return rows


def answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Ranks of the keys that occur more than once in the corpus, for the chunks that asked."""
    key1, key2, places, counts = (joined(asked.column(c), t) for c, t in (("key1", np.uint64), ("key2", np.uint64), ("places", np.int64), ("counts", np.int64)))
    chunk = np.repeat(np.asarray(asked.column("chunk").combine_chunks()), [len(b) // 8 for b in asked.column("places").to_pylist()])
    order = np.lexsort((chunk, key2, key1))
    key1, key2, places, counts, chunk = key1[order], key2[order], places[order], counts[order], chunk[order]
    new = np.ones(len(order), bool)
    new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
    start = np.flatnonzero(new)
    size = np.add.reduceat(counts, start)
    kept = np.where(size > 1, size, 0)
    rank, each = np.cumsum(kept) - kept, np.diff(np.append(start, len(order)))
    on = np.repeat(size > 1, each)
    rank, size, before = np.repeat(rank, each)[on], np.repeat(size, each)[on], ~new[on]
    places, chunk = places[on], chunk[on]
    order = np.argsort(chunk, kind="stable")
    number, first, n = np.unique(chunk[order], return_index=True, return_counts=True)
    cut = [order[a : a + m] for a, m in zip(first, n, strict=True)]
    columns = {"shard": pa.array([key[0].as_py()] * len(cut), pa.int64()), "chunk": number.astype(np.int64), "total": pa.array([int(kept.sum())] * len(cut), pa.int64())}
    return pa.table(columns | {c: pa.array([v[at].tobytes() for at in cut], pa.binary()) for c, v in (("places", places), ("ranks", rank), ("sizes", size), ("before", before))})


def first_questions(chunks: DataFrame, shards: int) -> DataFrame:
    """Every line of a chunk, by the upper bits of its id."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = np.frombuffer(row["ids"], np.uint64).reshape(-1, 2), np.frombuffer(row["ends"], np.int64)
                end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
                key1 = np.ascontiguousarray(ids[:, 0])
                shard = ((key1 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                yield from state_rows(questions(row["chunk"], 0, np.arange(len(ids)), end, key1, np.ascontiguousarray(ids[:, 1]), shard)).to_batches()

    return written(chunks.select("chunk", "ends", "ids").mapInArrow(ask, STATE), "line-state")


def next_questions(state: DataFrame, replies: DataFrame, depth: int, base: dict[int, int], total: int, shards: int, keep: bool) -> DataFrame:
    """Ranks at 2^depth lines, found in the replies, and what is asked about 2^(depth + 1) lines. keep: record earlier copies."""

    def step(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if own.num_rows and got.num_rows:
            row = own.to_pylist()[0]
            places, ends = np.frombuffer(row["places"], np.int64), np.frombuffer(row["ends"], np.int64)
            first, number = classes(np.frombuffer(row["key1"], np.uint64), np.frombuffer(row["key2"], np.uint64))
            rank, size, before = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
            by_place = np.argsort(places[first])
            for r in got.to_pylist():
                at = by_place[np.searchsorted(places[first][by_place], np.frombuffer(r["places"], np.int64))]
                rank[at], size[at], before[at] = np.frombuffer(r["ranks"], np.int64) + base[r["shard"]], np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["before"], bool)
            on = size[number] > 0
            places, ends, number, later = places[on], ends[on], number[on], (before[number] | (places > places[first][number]))[on]
            if keep and later.any():
                rows.append({"kind": 0, "depth": depth, "chunk": row["chunk"], "places": places[later].tobytes()})
            half = 1 << depth
            second = np.minimum(np.searchsorted(places, places + half), len(places) - 1)
            whole = (places[second] == places + half) & (places + half < ends)
            key1, key2 = rank[number[whole]], rank[number[second[whole]]]
            # a place's share of its interval's ranks, by what follows: large intervals spread over many shards
            guess = key1 + (size[number[whole]] * (key2 / max(total, 1))).astype(np.int64)
            shard = (guess / max(total, 1) * shards).astype(np.int64)
            rows += questions(row["chunk"], depth + 1, places[whole], ends[whole], key1.astype(np.uint64), key2.astype(np.uint64), shard)
        return state_rows(rows)

    mine = state.where("kind = 1").select("chunk", "places", "ends", "key1", "key2")
    return written(mine.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(step, STATE), "line-state")


def earlier_copies(chunks: DataFrame, run_lines: int, lines_bytes: int) -> list[DataFrame]:
    """Tables of chunk, depth, places: where 2^depth lines start that an earlier position has too, at depth 0 and from run_lines on."""
    shards = max(8, lines_bytes // SHARD_BYTES)
    state, out, depth = first_questions(chunks, int(shards)), [], 0
    while True:
        replies = written(state.where("kind = 2").groupBy("shard").applyInArrow(answer, REPLY), "line-replies")
        totals = sorted((r["shard"], r["n"]) for r in replies.groupBy("shard").agg(F.first("total").alias("n")).collect())
        base, total = {}, 0
        for shard, n in totals:
            base[shard], total = total, total + n
        if not total:
            discard(replies)
            return [table.where("kind = 0").select("depth", "chunk", "places") for table in out]
        shards = max(8, total * 32 // SHARD_BYTES)
        keep = depth == 0 or 1 << depth >= run_lines
        new = next_questions(state, replies, depth, base, total, int(shards), keep)
        discard(replies)
        if state not in out:
            discard(state)
        if keep:
            out.append(new)
        state, depth = new, depth + 1


def removals(docs: DataFrame, run_lines: int = 4, line_words: int = 8, chunk_lines: int = 100_000) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), removed array<int>: the numbers, from 0, of the lines to delete, where there are any; gone array<boolean>: of every line."""
    lines = written(line_table(docs), "lines")
    chunks = chunk_table(lines, chunk_lines)
    found = None
    for table in earlier_copies(chunks, run_lines, input_bytes(lines)):
        found = table if found is None else found.union(table)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest long, removed array<int>, gone array<boolean>")

    def choose(key: tuple, chunk: pa.Table, copies: pa.Table) -> pa.Table:
        docs_of, digests, ends, some, gone = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, bool)
        if chunk.num_rows and copies.num_rows:
            row = {c: chunk.column(c)[0].as_py() for c in ("doc_ids", "digests", "ends", "words")}
            docs_of, digests, ends = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "digests", "ends"))
            words = np.frombuffer(row["words"], np.uint32)
            gone, cover = np.zeros(len(words), bool), np.zeros(len(words) + 1, np.int64)
            for copy in copies.to_pylist():
                at = np.frombuffer(copy["places"], np.int64)
                if copy["depth"] == 0:
                    gone[at] |= words[at] >= line_words
                if 1 << copy["depth"] >= run_lines:
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + (1 << copy["depth"]), -1)
            gone |= np.cumsum(cover)[:-1] > 0
            starts = np.concatenate([[0], ends[:-1]])
            some = [(i, a, b) for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if gone[a:b].any()]
        index = [i for i, _, _ in some]
        return pa.table({"doc_id": docs_of[index], "digest": digests[index], "removed": pa.array([np.flatnonzero(gone[a:b]).astype(np.int32) for _, a, b in some], pa.list_(pa.int32())), "gone": pa.array([gone[a:b] for _, a, b in some], pa.list_(pa.bool_()))})

    chosen = chunks.drop("ids").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(choose, "doc_id long, digest long, removed array<int>, gone array<boolean>")
    return written(chosen, "line-removals")


def dedup_lines(docs: DataFrame, run_lines: int = 4, line_words: int = 8, removed: str = "removed_lines") -> DataFrame:
    """docs with later copies of repeated lines deleted from text, and a column `removed` of the deleted lines' numbers.

    A line goes when an earlier position has it too and it has line_words words or more, or when it lies in a run of
    run_lines lines (a power of two) or more, whatever their words, that some earlier position repeats in one document.
    Earlier means a smaller doc_id, or a smaller line number of the same document; rows with one id and several texts
    are ordered by a hash of the text, and rows with the same id and text are one document: each of them loses the
    same lines. Lines end at line feeds; the kept ones are joined by line feeds again. Rows with a null id, a null or
    an empty text are left as they are, with a null in `removed`, as is every row that loses nothing. A document may
    end up with an empty text. An empty table gives an empty result. All other columns come back unchanged, whatever
    their names, but one named as `removed`, whose place that column takes.
    """
    if run_lines & (run_lines - 1) or run_lines < 1:
        raise ValueError("run_lines is a power of two")
    small_batches(docs)
    kept = [c for c in docs.columns if c.lower() != removed.lower()]
    ident, digest, gone, numbers = fresh(kept, "gone_id"), fresh(kept, "gone_digest"), fresh(kept, "gone_lines"), fresh(kept, "gone_numbers")
    found = removals(docs.select("doc_id", "text"), run_lines, line_words)
    found = found.select(F.col("doc_id").alias(ident), F.col("digest").alias(digest), F.col("removed").alias(numbers), F.col("gone").alias(gone))
    both = docs.select(*[named(c) for c in kept]).join(found, (F.col("doc_id").cast("long") == F.col(ident)) & (F.xxhash64("text") == F.col(digest)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.get(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNotNull(), left).otherwise(F.col("text")).alias("text")
    return both.select(*[text if c.lower() == "text" else named(c) for c in kept], F.col(numbers).alias(removed))
