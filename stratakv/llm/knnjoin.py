"""Exact top-k inner products by a Voronoi join.

Scores are integer inner products. Adding one coordinate sqrt(M^2 - |x|^2) to every data vector, M the largest norm,
and a zero to every query makes |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest vectors and
the triangle inequality holds. Pivots cut the space into cells. From the cells' summaries (size, farthest distance to
the pivot) every query group, whose members lie in one cell, gets an upper bound on the distance of its k-th
neighbours, and goes only to the cells that may hold a vector as near. A cell's vectors are dealt over units of bounded
size, and every unit reads its vectors once, however many groups come to it; within it, a group reads only those whose
distance to the pivot does not rule them out. The lists of all units are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.llm.textio import written

#: Bytes of data vectors in a unit, queries in a group, queries that meet a unit in one task, and pivots at most.
UNIT_BYTES, GROUP, QUERIES, PIVOTS = 8 << 20, 256, 32_768, 64


def finite(vector: Column) -> Column:
    """The vector is there and every component is a finite number."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of dim columns; rows that are shorter end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if len(values) == len(column) * dim:
        return values.reshape(len(column), dim)
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim)[None, :] < size[:, None]] = values
    return out


def numbered(good: DataFrame, is_query: Column, name: str) -> tuple[DataFrame, dict]:
    """row_id, vec_id, vector, query of every row, written; and how many rows and queries there are, the longest vector and the type of its components."""
    single = isinstance(good.schema["embedding"].dataType.elementType, T.FloatType)
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    base = good.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    base = written(base, name)
    row = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0)).alias("queries"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).collect()[0]
    return base, row.asDict() | {"kind": np.float32 if single else np.float64}


def packed_groups(queries: DataFrame, most: int, kind: type, dim: int) -> DataFrame:
    """group_id, rows, ids, vectors: a task's queries, `most` at a time."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in together(batches, most):
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                yield pa.RecordBatch.from_pydict({"group_id": [serial], "rows": [np.asarray(part.column("row_id")).tobytes()], "ids": [np.asarray(part.column("vec_id")).tobytes()], "vectors": [matrix(part.column("vector"), kind, dim).tobytes()]})
                serial += 1

    return queries.select("row_id", "vec_id", "vector").mapInArrow(group, "group_id long, rows binary, ids binary, vectors binary")


def per_unit(asked: DataFrame, there: DataFrame, by: list[str], solve: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """solve(query groups, vectors) of every unit that has both."""
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(name, {"long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in fields])

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(solve(left, right)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches([b.select(arrow.names) for b in out], arrow) if out else arrow.empty_table()

    return asked.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(work, schema)


def pivots_of(base: DataFrame, n: int, most: int) -> list[list[float]]:
    """A bounded sample of vectors, drawn by a hash of their content before any shuffle, so that copies count once."""
    rows = base.select(F.xxhash64("vector").alias("h"), "vector")
    for share in (min(1.0, 16 * most / max(n, 1)), 1.0):
        drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("h").agg(F.first("vector").alias("vector")).orderBy("h").limit(most).collect()
        if drawn:
            return [r["vector"] for r in drawn]
    return []


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers, beyond what a double holds; those beyond a long stop at its ends."""
    ends = np.iinfo(np.int64)
    own = [int(v) for v in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(own, row, strict=True)), ends.min), ends.max) for row in x], np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other rows with the largest integer inner product.

    Components become floor(scale * x), x as double. Ties go to the smaller vec_id. Rows are told apart by themselves,
    not by vec_id: rows that share one are queries and candidates each. Vectors of unequal lengths multiply as if the shorter
    ended in zeros. Vectors that are null or hold a null or a non-finite component take no part, nor do rows without an
    id. With no query, or fewer than k other rows, the result is as short as that. Products that float64 does not hold
    exactly (some component is large) are taken again in whole numbers, for all vectors that its error leaves in
    question; scores beyond a long stop at its ends. Other columns, of whatever names, are not read.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    base, stats = numbered(good, is_query, "knn-vectors")
    if not stats["queries"]:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, kind = max(stats["dim"], 1), stats["kind"]
    square = F.aggregate(F.transform("vector", lambda x: F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    large = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")) * scale + 1))
    measured = base.agg(F.max(square).alias("longest"), F.max(large).alias("largest")).collect()[0]
    longest, is_exact = measured["longest"], dim * (measured["largest"] or 0.0) ** 2 < 2.0**53

    def whole(x: np.ndarray) -> np.ndarray:
        return np.floor(x.astype(np.float64) * scale)

    drawn = pivots_of(base, stats["n"], int(np.clip(stats["queries"] // GROUP, 8, PIVOTS)))
    points = np.zeros((len(drawn), dim))
    for i, v in enumerate(drawn):
        points[i, : len(v)] = whole(np.array(v, np.float64))
    points = np.hstack([points, np.sqrt(np.maximum(longest - (points**2).sum(1), 0))[:, None]])
    slack = 1e-6 * (1 + np.sqrt(longest))

    def to_cells(x: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, lift[:, None]])
        square = (x**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * x @ points.T
        cell = square.argmin(1)
        return cell, np.sqrt(((x - points[cell]) ** 2).sum(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column("vector"), kind, dim))
            cell, away = to_cells(x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0)))
            q_cell, q_away = to_cells(x, np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row_id", "vec_id", "vector", "query")], pa.array(cell.astype(np.int32)), pa.array(away), pa.array(q_cell.astype(np.int32)), pa.array(q_away)], names=["row_id", "vec_id", "vector", "query", "cell", "away", "q_cell", "q_away"])

    element = "float" if kind is np.float32 else "double"
    placed = written(base.mapInArrow(place, f"row_id long, vec_id long, vector array<{element}>, query boolean, cell int, away double, q_cell int, q_away double"), "knn-cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()
    between = np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(2), 0))

    def bound(cell: int, far: float) -> float:
        """No query of a group at most `far` from its pivot has its k-th other vector farther away than this."""
        reach, left = sorted((far + between[cell, r["cell"]] + r["far"], r["n"]) for r in cells), k + 1
        for distance, n in reach:
            left -= n
            if left <= 0:
                return distance
        return float("inf")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's queries by cell, near ones to the pivot first, in groups, each once for every cell that may hold a neighbour."""
        serial = TaskContext.get().partitionId() << 32
        for batch in together(batches, 16 * GROUP):
            cell, away = np.asarray(batch.column("q_cell")), np.asarray(batch.column("q_away"))
            order = np.lexsort((away, cell))
            x = matrix(batch.column("vector"), kind, dim)
            rows, ids = np.asarray(batch.column("row_id")), np.asarray(batch.column("vec_id"))
            for c in np.unique(cell):
                a, b = np.searchsorted(cell[order], [c, c + 1])
                for start in range(a, b, GROUP):
                    at = order[start : min(b, start + GROUP)]
                    far = float(away[at].max())
                    most = bound(int(c), far)
                    own = {"group_id": [serial], "rows": [rows[at].tobytes()], "ids": [ids[at].tobytes()], "vectors": [x[at].tobytes()]}
                    serial += 1
                    for r in cells:
                        gap = between[c, r["cell"]]
                        low, high = gap - far - most - slack, gap + far + most + slack
                        if low <= r["far"]:
                            yield pa.RecordBatch.from_pydict(own | {"cell": pa.array([r["cell"]], pa.int32()), "low": [low], "high": [high]})

    def solve(asked: pa.Table, there: pa.Table) -> Iterator[pa.RecordBatch]:
        away = np.asarray(there.column("away").combine_chunks())
        order = np.argsort(away, kind="stable")
        away, all_rows, all_ids = away[order], np.asarray(there.column("row_id").combine_chunks())[order], np.asarray(there.column("vec_id").combine_chunks())[order]
        data = whole(matrix(there.column("vector").combine_chunks(), kind, dim)[order])
        for row in asked.to_pylist():
            on = slice(*np.searchsorted(away, [row["low"], row["high"]], "left"))
            rows, ids, x = all_rows[on], all_ids[on], data[on]
            if not len(ids):
                continue
            own, asking, q = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64), whole(np.frombuffer(row["vectors"], kind).reshape(-1, dim))
            products = q @ x.T
            error = np.zeros((1, 1)) if is_exact else dim * 2.0**-50 * np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
            products[rows[None, :] == own[:, None]] = -np.inf
            keep = min(k, len(ids))
            limit = -np.partition(-(products - error), keep - 1, axis=1)[:, keep - 1]
            for i in range(len(own)):
                at = np.flatnonzero(products[i] + (0 if is_exact else error[i]) >= limit[i])
                at = at[rows[at] != own[i]]
                score = products[i, at].astype(np.int64) if is_exact else exact_scores(q[i], x[at])
                first = np.lexsort((ids[at], -(score.astype(np.float64) if is_exact else score)))[:keep] if is_exact else sorted(range(len(at)), key=lambda j: (-int(score[j]), ids[at[j]]))[:keep]
                at, score = at[first], score[first]
                yield pa.RecordBatch.from_pydict({"query_row": np.full(len(at), own[i]), "query_id": np.full(len(at), asking[i]), "vec_id": ids[at], "score": score})

    sent = placed.where("query").select("row_id", "vec_id", "vector", "q_cell", "q_away").mapInArrow(groups, "group_id long, rows binary, ids binary, vectors binary, cell int, low double, high double")
    rows_of_unit, meetings = max(1, UNIT_BYTES // (8 * dim)), -(-stats["queries"] // QUERIES)
    parts = F.create_map(*[F.lit(v) for r in cells for v in (r["cell"], -(-r["n"] // rows_of_unit))])[F.col("cell")]
    asked = sent.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumn("salt", F.pmod(F.xxhash64("group_id"), F.lit(meetings)).cast("int"))
    there = placed.select("row_id", "vec_id", "vector", "away", "cell", F.pmod(F.xxhash64("row_id"), parts).cast("int").alias("part"))
    there = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(meetings - 1))))
    found = per_unit(asked, there, ["cell", "part", "salt"], solve, "query_row long, query_id long, vec_id long, score long")
    return best_of(found, k, F.desc("score"))


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least `rows` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best_of(found: DataFrame, k: int, by: Column) -> DataFrame:
    """The first k of each query's rows, ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(by, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
