"""Toxicity by a linear classifier over character n-grams whose features are naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import LOWER, SPACE, joined, slices, small_batches, text_bytes, written

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Classifier:
    """index[bucket]: 1 + the feature's number, 0 for none; weight: of each feature; bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = present(raw, offsets, self.index)
        z = np.bincount(row, self.weight[feature], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def buckets(raw: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that starts at each byte. A-Z are lower-cased, white space is one kind."""
    code = np.where(SPACE[raw], np.uint8(32), LOWER[raw]).astype(np.uint64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(code) < n:
            return
        gram = (gram[: len(code) - n + 1] << np.uint64(8)) | code[n - 1 :]
        if n in orders:
            yield n, ((gram + np.uint64(n << 56)) * _SPREAD >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(raw: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, feature) pairs, each once, of the features that a row's text has. Grams don't cross rows."""
    found = []
    features, used = int(index.max(initial=0)), index > 0
    for n, bucket in buckets(raw):
        at = np.flatnonzero(used[bucket])
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + n <= offsets[row + 1]
        found.append(row[whole] * np.int64(features) + index[bucket[at[whole]]] - 1)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(features, 1), pairs % max(features, 1)


def choose(counts: np.ndarray, bad: int, good: int, features: int, evidence: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that are features, in order, and their log-count ratios.

    counts: in how many texts of either label (0, 1) each bucket is present. The features are the n-grams whose presence
    tells the labels apart by a likelihood ratio statistic of `evidence` or more, the `features` strongest of them.
    """
    both, n = counts.sum(0), good + bad
    gain = np.zeros(counts.shape[1])
    for side, size in ((0, good), (1, bad)):
        for seen, margin in ((counts[side], both), (size - counts[side], n - both)):
            on = seen > 0
            gain[on] += 2 * seen[on] * np.log(seen[on] / (margin[on] * (size / n)))
    chosen = np.sort(np.argsort(-gain, kind="stable")[: min(features, int((gain >= evidence).sum()))])
    p, q = (counts[1, chosen] + alpha) / (bad + 2 * alpha), (counts[0, chosen] + alpha) / (good + 2 * alpha)
    return chosen, np.log(p / q)


def regress(row: np.ndarray, feature: np.ndarray, scale: np.ndarray, label: np.ndarray, decay: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on present features, each worth its scale; both labels weigh the same. Weights and bias."""
    n, bad = len(label), int(label.sum())
    x = scale[feature]
    share = np.where(label == 1, 0.5 / bad, 0.5 / (n - bad))
    w, b = np.zeros(len(scale)), 0.0
    mean, square = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = np.clip(np.bincount(row, x * w[feature], n) + b, -40, 40)
        error = (1 / (1 + np.exp(-z)) - label) * share
        slope = np.concatenate([np.bincount(feature, x * error[row], len(scale)) + decay / n * w, [error.sum()]])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        move = 0.02 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic of per_class documents of either label at most: those whose ids have the smallest hashes.

    A document labelled more than once has its highest label; rows of one id with several texts count as the text with
    the smallest hash. Labels other than 0 and 1 are passed over.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    there = marks.join(texts.select("id").distinct(), "id", "left_semi")
    parts = [there.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(per_class) for value in (0, 1)]
    picked = texts.join(F.broadcast(parts[0].union(parts[1])), "id")  # 2 * per_class rows at most
    return picked.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500, features: int = 4000, evidence: float = 20.0, alpha: float = 0.5, decay: float = 10.0, rounds: int = 300) -> Classifier:
    """Log-count ratios of presence in toxic and other texts scale the features; logistic regression weighs them.

    Learns from whole texts of at most per_class labelled documents of either label, the documented bound at every input
    size. Texts stay in their tasks: presence is counted there and summed by parts of the buckets, and the fit, in one
    task, reads which features each text has. Without rows of both labels every text gets one score.
    """
    sample = written(labelled_sample(docs, labels, per_class).select("id", "text", "toxic").repartition(16, "id"), "toxicity-sample")
    small_batches(docs)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    index = np.zeros(1 << BUCKET_BITS, np.int32)
    if not good or not bad:
        return Classifier(index, np.zeros(1), float((bad > 0) * 4.0 - (good > 0) * 4.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in slices(batches, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            for i, label in enumerate(batch.column("toxic").to_pylist()):
                own = [b for _, b in buckets(raw[offsets[i] : offsets[i + 1]])]
                if own:
                    counts[label, np.unique(np.concatenate(own))] += 1
        at = np.flatnonzero(counts.any(0))
        cut = np.searchsorted(at, np.arange(17) << (BUCKET_BITS - 4))
        for part in range(16):
            own = at[cut[part] : cut[part + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": [own.astype(np.int64).tobytes()], "good": [counts[0, own].tobytes()], "bad": [counts[1, own].tobytes()]})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        at, inverse = np.unique(joined(group.column("at"), np.int64), return_inverse=True)
        sums = [np.bincount(inverse, joined(group.column(c), np.int32), len(at)).astype(np.int32) for c in ("good", "bad")]
        return pa.table({"at": [at.tobytes()], "good": [sums[0].tobytes()], "bad": [sums[1].tobytes()]}, schema=pa.schema([(c, pa.binary()) for c in ("at", "good", "bad")]))

    packed = sample.mapInArrow(count, "part int, at binary, good binary, bad binary").groupBy("part").applyInArrow(add, "at binary, good binary, bad binary")
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for row in packed.toLocalIterator():  # one number a bucket and label at most
        at = np.frombuffer(row["at"], np.int64)
        counts[0, at], counts[1, at] = np.frombuffer(row["good"], np.int32), np.frombuffer(row["bad"], np.int32)
    chosen, scale = choose(counts, bad, good, features, evidence, alpha)
    index[chosen] = np.arange(1, len(chosen) + 1)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.zeros(1 << BUCKET_BITS, np.int32)
        index[chosen] = np.arange(1, len(chosen) + 1)
        for batch in slices(batches, "text", 4 << 20):
            row, feature = present(*text_bytes(batch.column("text")), index)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(lists, pa.binary())], names=["id", "toxic", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows]).sort_by("id")
        lists = [np.frombuffer(b, np.int32) for b in table.column("features").to_pylist()]
        row, feature = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
        weight, bias = regress(row, feature, scale, np.asarray(table.column("toxic").combine_chunks()).astype(np.int64), decay, rounds)
        yield pa.RecordBatch.from_pydict({"weight": [weight.tobytes()], "bias": [bias]})

    spelled = sample.mapInArrow(spell, "id long, toxic int, features binary").repartition(1)
    fitted = spelled.mapInArrow(train, "weight binary, bias double").collect()[0]
    return Classifier(index, np.frombuffer(fitted["weight"], np.float64) * scale if len(chosen) else np.zeros(1), fitted["bias"])


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """`keep`, score double (0 to 1), predicted int (score >= threshold) of every whole text.

    Null and empty texts have no feature and get the score of the bias alone. Rows keep their multiplicity; only text
    is an input of the score.
    """
    at = np.flatnonzero(model.index)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.index[at], model.weight, model.bias))
    small_batches(docs)
    given = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "text") + ", score double, predicted int"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, weight, bias = shared.value
        index = np.zeros(1 << BUCKET_BITS, np.int32)
        index[at] = number
        own = Classifier(index, weight, bias)
        for batch in slices(batches, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            got = own.scores(raw, offsets)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return given.mapInArrow(apply, schema)
