"""Approximate nearest neighbours by collision counting over single projections.

Unit vectors are projected on `lines` random directions. A block of data vectors keeps the projections on each line in
sorted order. A query's window on a line is centred on its own projection and widens round by round (virtual
rehashing: a window of the next round is a coarser bucket of the same array). A vector whose projections fall into the
query's windows on enough lines is verified by its exact cosine. A round stands for a radius: the projections of two
vectors that far apart differ by a normal deviate of that size, so the share of lines on which they meet is known, and
the threshold lies `sure` standard deviations below it. A block's search ends when k verified vectors lie within the
round's radius: each nearer vector has then been verified with the probability that `sure` stands for. Nothing else
ends it, so neither the number nor the share of verified vectors is limited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.knnjoin import best_of, finite, matrix, numbered, packed_groups, per_unit

#: Bytes of vectors in a block, queries in a group, queries that search a block in one task, and tasks that share a block at least.
BLOCK_BYTES, GROUP, QUERIES, SALTS = 16 << 20, 128, 32_768, 6


def radii(first: float = 0.05, coarse: float = 2.5, turn: float = 0.7, fine: float = 1.1) -> np.ndarray:
    """Radii of the rounds, from near copies up to opposite vectors: steps are coarse where windows hold little anyway."""
    out = [first]
    while out[-1] < 2:
        out.append(out[-1] * fine if out[-1] >= turn else min(out[-1] * coarse, turn))
    return np.array(out)


def threshold(lines: int, reach: float, sure: float) -> int:
    """Collisions that vectors within a round's radius have but for `sure` standard deviations."""
    share = math.erf(reach / math.sqrt(2))
    return max(1, math.floor(lines * share - sure * math.sqrt(lines * share * (1 - share))))


class SortedProjections:
    """Sorted projections of one block of unit vectors, every vector's place among them, and the search in them."""

    def __init__(self, unit: np.ndarray, directions: np.ndarray):
        self.unit, self.start = unit, 0
        lines, n = len(directions), len(unit)
        self.sorted = np.empty((lines, n), np.float32)
        self.place = np.empty((lines, n), np.uint16 if n < 1 << 16 else np.uint32)
        places = np.arange(n).astype(self.place.dtype)
        for j, line in enumerate(directions):
            along = (unit @ line).astype(np.float32)
            order = np.argsort(along)
            self.sorted[j] = along[order]
            self.place[j, order] = places

    def candidates(self, query: np.ndarray, at: np.ndarray, need: int, least: int, rounds: np.ndarray, reach: float) -> np.ndarray:
        """Positions of the vectors verified in the first round that ends the search. at: the query's projections; need: vectors to find within a round's radius.

        A later round verifies all that an earlier one does, within a larger radius, so once a round ends the search all
        later ones do. The first such round is hence the same from wherever one looks for it, and the round before the
        last query's is close by. A vector is in a line's window when its place is; places are unsigned, so one
        comparison tells both ends.
        """
        lines, n = self.sorted.shape
        if n <= need:
            return np.arange(n)
        widths = np.concatenate([-rounds, rounds]) * reach
        edges = np.array([self.sorted[j].searchsorted((at[j] + widths).astype(np.float32)) for j in range(lines)])
        low = edges[:, : len(rounds)].astype(self.place.dtype)
        size = (edges[:, len(rounds) :] - edges[:, : len(rounds)]).astype(self.place.dtype)
        distance = np.full(n, np.nan)
        hits, inside, away = np.empty(n, np.uint8 if lines < 256 else np.uint16), np.empty(n, bool), np.empty(n, self.place.dtype)

        def verified(r: int) -> tuple[np.ndarray, bool]:
            hits[:] = 0
            for j in range(lines):
                np.less(np.subtract(self.place[j], low[j, r], out=away), size[j, r], out=inside)
                np.add(hits, inside.view(np.uint8), out=hits)
            some = np.flatnonzero(hits >= least)
            new = some[np.isnan(distance[some])]
            distance[new] = 2 - 2 * (self.unit[new] @ query)
            return some, len(some) >= need and bool(np.partition(distance[some], need - 1)[need - 1] <= rounds[r] ** 2)

        r = max(self.start - 1, 0)
        some, ends = verified(r)
        if ends:
            while r and (before := verified(r - 1))[1]:
                some, r = before[0], r - 1
        else:
            while not ends and r + 1 < len(rounds):
                r += 1
                some, ends = verified(r)
        self.start = r
        return some if ends else np.arange(n)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay what they are."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, lines: int = 192, reach: float = 1.0, sure: float = 1.3, seed: int = 29) -> DataFrame:
    """query_id, rank, vec_id, score: for each query k near rows by cosine, the query's own row left out.

    Every row is indexed, in blocks; every block is searched for every query, so no list of candidates is cut: all
    vectors over the collision threshold are verified on the original components in double precision. Ties go to the
    smaller vec_id. Rows are told apart by themselves, not by vec_id: rows that share one are queries and candidates
    each. Vectors of unequal lengths compare as if the shorter ended in zeros. Vectors that are null, empty, zero, or hold a
    null or non-finite component take no part, nor do rows without an id. Copies of one vector count once in a block's
    search and come back together, so a vector that fills a third of the table costs no more than any other. Other
    columns, of whatever names, are not read. No rows or no queries: no result.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    base, stats = numbered(good, is_query, "ann-vectors")
    if not stats["queries"]:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, kind = stats["dim"], stats["kind"]
    parts = -(-stats["n"] * dim * 8 // BLOCK_BYTES)
    salts = max(min(SALTS, -(-stats["queries"] // GROUP)), -(-stats["queries"] // QUERIES))
    directions = np.random.default_rng(seed).normal(size=(lines, dim))
    least, rounds = threshold(lines, reach, sure), radii()

    def search(asked: pa.Table, there: pa.Table) -> Iterator[pa.RecordBatch]:
        rows_of, ids = np.asarray(there.column("row_id").combine_chunks()), np.asarray(there.column("vec_id").combine_chunks())
        distinct, of = np.unique(matrix(there.column("vector").combine_chunks(), kind, dim).astype(np.float64), axis=0, return_inverse=True)
        of, distinct = of.reshape(-1), scaled(distinct)
        by_copy = np.lexsort((ids, of))
        starts = np.searchsorted(of[by_copy], np.arange(len(distinct) + 1))
        norm = np.sqrt((distinct**2).sum(1))
        index = SortedProjections(distinct / norm[:, None], directions)
        here = np.sort(rows_of)
        for row in asked.to_pylist():
            found: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
            asking = zip(np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64), scaled(np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.float64)), strict=True)
            for own, ident, q in asking:
                size = np.sqrt((q**2).sum())
                is_here = here[min(np.searchsorted(here, own), len(here) - 1)] == own
                near = index.candidates(q / size, directions @ (q / size), k + int(is_here), least, rounds, reach)
                exact = (distinct[near] * q).sum(1) / (norm[near] * size)
                if len(near) > 4 * k + 4:
                    on = -exact <= np.partition(-exact, k)[k]
                    near, exact = near[on], exact[on]
                lists = [by_copy[starts[i] : min(starts[i + 1], starts[i] + k + 1)] for i in near]
                if len(lists) == 0:
                    continue
                rows, score = np.concatenate(lists), np.repeat(exact, [len(a) for a in lists])
                other = rows_of[rows] != own
                rows, score = rows[other], score[other]
                pick = np.lexsort((ids[rows], -score))[:k]
                for name, values in (("query_row", np.full(len(pick), own)), ("query_id", np.full(len(pick), ident)), ("vec_id", ids[rows[pick]]), ("score", score[pick])):
                    found[name].append(values)
            if found["score"]:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in found.items()})

    asked = packed_groups(base.where("query"), GROUP, kind, dim).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("group_id"), F.lit(salts)).cast("int"))
    there = base.select("row_id", "vec_id", "vector", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int").alias("part"))
    there = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = per_unit(asked, there, ["part", "salt"], search, "query_row long, query_id long, vec_id long, score double")
    return best_of(found, k, F.desc("score"))


