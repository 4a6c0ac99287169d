"""N-gram Jaccard join: which documents are linked by the similarity of their sets of word shingles.

Two sets of sizes a and b with a Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) * (a + b) elements,
and the smaller has t times the size of the larger at least. Sizes fall into bands of ratio 1 / t, so linked sets lie
in the same band or in neighbours; for every pair of neighbouring bands the hash space is cut into more segments than
linked sets can differ in. A set's parity sketch flips, for each of its shingles, one bit of the shingle's segment; its
Hamming distance is at most the number of elements in which the sets differ, and so is the number of segments that are
not alike. Linked sets hence share a whole segment, and a join on (bands, segment, bits) finds them; the sparse bits of
a segment are held as the exclusive or of 64-bit words. Candidates are verified exactly, on 64-bit shingle hashes.

Only components are asked for, so links within one component needn't all be found: candidates meet in bounded units
around the smallest member of their join group, a unit decides all of its pairs, and groups whose members ended up in
different components are met again as a whole, until every pair of a group has been decided or is in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.components import components
from stratakv.llm.textio import by_shard, input_bytes, mix, shard_bits, slices, small_batches, sum_by_key, text_bytes, words_of, written

#: Signatures packed at a time, and documents that meet in one unit.
FLUSH, UNIT = 2_000_000, 256
#: A set of more than one in SHARE rows is sent to all of them.
SHARE = 1000


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, in order, and the row offsets. Fewer than n words: all as one shingle."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, np.minimum(size, 1)))
    first = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, np.minimum(size, 1)))])[row] + at[row]
    h = np.full(len(row), 0x51ED270B35AE9D3B, np.uint64)
    for i in range(n):
        inside = i < size[row]
        h[inside] = mix(h[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + i] + np.uint64(i + 1))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(size) + 1))


class Bands:
    """Bands of set sizes for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.unit = np.log(den / num) * 1.0001 if num < den else 1e-9
        # segments beyond those in which sets may differ, so that those that aren't empty are enough of them
        least = num * num * (den + num) / (2 * den * den * max(den - num, 1e-9))  # shingles for each such segment
        spare = np.arange(0.0, 2.0, 0.01)
        enough = (1 + spare) * (1 - np.exp(-least / (1 + spare))) >= 1.04
        self.spare = float(spare[enough][0]) if enough.any() else 0.5

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / self.unit).astype(np.int64)

    def parts(self, differ: np.ndarray) -> np.ndarray:
        return differ + 4 + np.ceil(differ * self.spare).astype(np.int64)

    def differ(self, band: np.ndarray) -> np.ndarray:
        """Elements in which linked sets of bands `band` and `band + 1` differ at most."""
        largest = np.floor(np.exp((band + 2) * self.unit) + 1e-6).astype(np.int64)
        return (2 * largest * (self.den - self.num)) // (self.den + self.num)


def segments(h: np.ndarray, row: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, segment and bits of every segment that isn't empty. h is in order within rows, and so are segments."""
    segment = ((h >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    word = np.bitwise_xor.reduceat(mix(h), start) if len(start) else np.zeros(0, np.uint64)
    return row[start], segment[start], word


def signatures(h: np.ndarray, at: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every row's segments, for its band with the next and with the one before.

    Leaving the same shingles out of both sets can only bring them closer, so segments are made without the `frequent`
    ones, and without empty segments wherever the others are more than sets may differ in: one of them is then alike
    in both sets. Rows with too few such segments join on those of their whole sets as well, empty ones included if it
    has to be; two linked sets that both have too few meet there.
    """
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    lean = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h if len(frequent) else np.ones(len(h), bool)
    rows, keys = [], []
    for below in (0, 1):
        band = bands.of(size) - below
        differ = bands.differ(band)
        parts = bands.parts(differ)
        own, seg, word = segments(h[lean], row[lean], parts)
        few = (np.bincount(own, minlength=len(size)) <= differ) & (size > 0)
        kind = np.zeros(len(own), np.uint64)
        if few.any():
            some = few[row]
            own_w, seg_w, word_w = segments(h[some], row[some], parts)
            filled = np.bincount(own_w, minlength=len(size))
            short = np.flatnonzero(few & (filled <= differ))
            if len(short):
                r = np.repeat(short, parts[short])
                g = np.arange(len(r)) - np.repeat(np.cumsum(parts[short]) - parts[short], parts[short])
                empty = ~np.isin(r * (1 << 32) + g, own_w * (1 << 32) + seg_w)
                own_w, seg_w, word_w = np.concatenate([own_w, r[empty]]), np.concatenate([seg_w, g[empty]]), np.concatenate([word_w, np.zeros(int(empty.sum()), np.uint64)])
            own, seg, word = np.concatenate([own, own_w]), np.concatenate([seg, seg_w]), np.concatenate([word, word_w])
            kind = np.concatenate([kind, np.full(len(own_w), 1 << 62, np.uint64)])
        rows.append(own)
        keys.append(mix(word ^ mix(kind + ((band[own] + 2) << 40).astype(np.uint64) + seg.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(keys)


class Often:
    """Counts of keys in bounded memory: with more than `most` keys, all counts are lowered alike until `most` are left.

    A count is too small by `short` at most, which is at most all that was counted over `most`.
    """

    def __init__(self, most: int):
        self.most, self.short = most, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = sum_by_key(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.most:
            less = int(np.partition(self.counts, len(self.counts) - self.most - 1)[len(self.counts) - self.most - 1])
            self.short += less
            on = self.counts > less
            self.keys, self.counts = self.keys[on], self.counts[on] - less


def frequent_shingles(docs: DataFrame, words: int, share: int = 750, counters: int = 1 << 19, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Shingles that more than one in `share` documents have, by counts over all rows of docs, and some of half as many.

    Every task counts its own rows and gives what at least one in 2 * share of them has, so a sum over tasks is too small
    by one in 2 * share documents at most, and by one in `counters` shingles where a task's outgrow `counters`; sums of more
    than one in 2 * share, and of `least` at least, are taken, the largest `most`. Small partitions are counted together, so
    that what a task gives has been seen there several times. Results don't depend on which these are, only speed does.
    """
    n = docs.count()
    tasks = max(n // (8 * share), input_bytes(docs) // (8 << 20), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Often(counters), 0
        for batch in slices(batches, "text", 6 << 20):
            h, _ = shingles(*words_of(*text_bytes(batch.column("text"))), words)
            seen.add(*np.unique(h, return_counts=True))
            rows += batch.num_rows
        on = seen.counts * 2 * share >= rows
        keys, counts = seen.keys[on], seen.counts[on]
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["h", "n"])

    least = max(n // (2 * share) + 1, least)
    found = docs.select("text").coalesce(tasks).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(np.asarray(rows.column("h").combine_chunks()).view(np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by significance, which compress where numbers are alike."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1) for b in blobs.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def decide(ids: np.ndarray, h: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked among a unit's rows: (id, smaller id) pairs, one less than rows in a component."""
    n, size = len(ids), np.diff(at)
    row = np.repeat(np.arange(n), size)
    bits = int(np.clip(2 ** np.ceil(np.log2(2 * np.median(size) + 1)), 256, 1 << 15))
    bit = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)
    flips = np.zeros(n * bits, np.uint8)
    np.add.at(flips, row * bits + bit, np.uint8(1))
    sketch = np.packbits((flips & 1).reshape(n, bits), axis=1).view(np.uint64)
    root = np.arange(n)
    for i in range(n):
        near = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not size[i] or not len(near):
            continue
        near = near[bands.den * np.minimum(size[near], size[i]) >= bands.num * np.maximum(size[near], size[i])]
        total = size[near] + size[i]
        near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(1, dtype=np.int64) * (bands.den + bands.num) <= (bands.den - bands.num) * total]
        own = h[at[i] : at[i + 1]]
        for j in near:
            if root[j] == root[i]:
                continue
            other = h[at[j] : at[j + 1]]
            where = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = int((own[where] == other).sum())
            if bands.den * both >= bands.num * (size[i] + size[j] - both) and both:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    on = np.flatnonzero(least[root] < ids)
    return ids[on], least[root[on]]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the set of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 6 << 20):
            h, at = shingles(*words_of(*text_bytes(batch.column("text"))), words)
            digests = [np.add.reduceat(np.append(x, np.uint64(0)), at[:-1]) if len(at) > 1 else np.zeros(0, np.uint64) for x in (mix(h + np.uint64(1)), mix(h ^ np.uint64(0xA5A5A5A5)))]
            full = np.diff(at) > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *[pa.array(np.where(full, d, 0).view(np.int64)) for d in digests]], names=["doc_id", "n_shingles", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, n_shingles long, d1 long, d2 long")


def join_groups(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """group, center, doc: the documents that share a segment with others, each distinct list of them once.

    Copies within a task are joined on as one document, the smallest; so a text that fills a third of the table sends
    one row a task, not one a copy.
    """
    bits = shard_bits(input_bytes(docs))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, ids = np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])
            held.clear()
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            some = by_shard(keys, bits)
            return pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _, _ in some], pa.int32()), "keys": pa.array([planes(keys[a:b]) for _, a, b in some], pa.binary()), "ids": pa.array([planes(ids[a:b]) for _, a, b in some], pa.binary())})

        for batch in slices(batches, "text", 6 << 20):
            ids = np.asarray(batch.column("doc_id"))
            h, at = shingles(*words_of(*text_bytes(batch.column("text"))), words)
            digest = np.add.reduceat(np.append(mix(h + np.uint64(1)), np.uint64(0)), at[:-1])
            order = np.lexsort((ids, digest))
            first = np.ones(len(ids), bool)
            first[order[1:]] = digest[order[1:]] != digest[order[:-1]]
            once = first & (np.diff(at) > 0)
            row, keys = signatures(h, at, bands, shared.value)
            on = once[row]
            held.append((keys[on], ids[row[on]]))
            size += int(on.sum())
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        keys, ids = from_planes(group.column("keys"), np.uint64), from_planes(group.column("ids"), np.int64)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(start, len(keys)))
        name = np.add.reduceat(mix(ids.view(np.uint64)), start)
        several = np.flatnonzero(size > 1)
        several = several[np.unique(name[several], return_index=True)[1]]
        take = np.repeat(start[several], size[several]) + np.arange(int(size[several].sum())) - np.repeat(np.cumsum(size[several]) - size[several], size[several])
        return pa.table({"group_id": np.repeat(name[several].view(np.int64), size[several]), "center": np.repeat(ids[start[several]], size[several]), "doc": ids[take]})

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = named.mapInArrow(sign, "shard int, keys binary, ids binary")
    return written(packed.groupBy("shard").applyInArrow(meet, "group_id long, center long, doc long").distinct(), "jaccard-groups")


def links_in_units(units: DataFrame, texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """units(center, doc), the center's own row among them -> links(a, b), and salted(center, n) beyond UNIT members.

    A center with more members than a unit holds gets several; the center itself is in each.
    """
    n = units.groupBy("center").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / UNIT).cast("int")).where("salts > 1")
    salted = units.join(n.select("center", "salts"), "center", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    salted = salted.withColumn("salt", F.explode(F.when(F.col("doc") == F.col("center"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)))
    return links_of(salted.select("center", "salt", "doc"), ["center", "salt"], texts, words, bands)


def links_of(members: DataFrame, by: list[str], texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    def verify(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("doc").combine_chunks())
        order = np.argsort(ids, kind="stable")
        plain = [zstandard.decompress(group.column("packed")[int(i)].as_py()) for i in order]
        raw = np.frombuffer(b"".join(plain), np.uint8)
        h, at = shingles(*words_of(raw, np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)), words)
        a, b = decide(ids[order], h, at, bands)
        return pa.table({"a": a, "b": b})

    whole = members.join(texts, "doc")
    return whole.groupBy(*by).applyInArrow(verify, "a long, b long")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, packed: the compressed texts of the wanted documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", 6 << 20):
            raw, at = text_bytes(batch.column("text"))
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([press.compress(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc", "packed"])

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    return written(named.mapInArrow(pack, "doc long, packed binary").join(wanted, "doc", "left_semi"), "jaccard-texts")


def similar_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Rows are linked when den * |intersection| >= num * |union| of their sets of distinct `words`-word shingles (A-Z
    lower-cased; a text with fewer words is one shingle). component_id is the smallest doc_id that links lead to.
    Null, empty and blank texts have no shingle and are their own component; a row without an id has none. Repeated
    rows come back as often as they are there; rows with one id and several texts share a component. Extra columns are
    not read. An empty table gives an empty result.
    """
    bands = Bands(num, den)
    small_batches(docs)
    sets = written(shingle_sets(docs, words), "jaccard-sets")
    groups = join_groups(docs, words, bands)
    texts = packed_texts(docs, groups.select("doc").distinct())
    nearest = groups.groupBy("doc").agg(F.min("center").alias("center"))
    units = nearest.select("center", "doc").union(nearest.select("center", F.col("center").alias("doc"))).distinct()
    label = components(links_in_units(units, texts, words, bands))
    again = open_groups(groups, label)
    label = components(links_in_units(again, texts, words, bands).union(label))
    rest = across_salts(open_groups(groups, label), salted_centers(again), label)
    if not rest.isEmpty():
        label = components(links_of(rest, ["center", "salt", "other"], texts, words, bands).union(label))
    return with_components(sets, label)


def with_components(sets: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id from the sets of all rows and the components of the smallest document of each set.

    Of all sets, at most SHARE can be those of more than one in SHARE rows: these go to the rows by broadcast, the others
    meet theirs in a shuffle, so neither copies that fill a third of the table nor empty texts come together in one task.
    """
    key = ["n_shingles", "d1", "d2"]
    full, total = sets.where("n_shingles > 0"), sets.count()
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = classes.join(label.withColumnRenamed("node", "first"), "first", "left").select(*key, F.coalesce("component", "first").alias("component"), "n")
    classes = written(classes, "jaccard-classes")
    large = F.broadcast(classes.where(F.col("n") > max(total // SHARE, 1)).select(*key, F.col("component").alias("of_large"), F.lit(True).alias("large")))
    parted = full.join(large, key, "left")
    found = parted.where("large").select("doc_id", "n_shingles", "of_large")
    rest = parted.where("large IS NULL").select("doc_id", *key).join(classes.drop("n"), key, "left").select("doc_id", "n_shingles", "component")
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id"))
    result = found.union(rest).union(empty).toDF("doc_id", "n_shingles", "component")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def open_groups(groups: DataFrame, label: DataFrame) -> DataFrame:
    """center, doc of the join groups of more than two whose members are in different components; each center's own row as well."""
    labelled = groups.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    still = labelled.groupBy("group_id", "center").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group_id", "center")
    return written(groups.join(still, ["group_id", "center"], "left_semi").select("center", "doc").distinct(), "jaccard-open", 1 + groups.count() // 200_000)


def salted_centers(units: DataFrame) -> DataFrame:
    """center: those whose members links_in_units met in several units, so that not all of their pairs are decided."""
    return units.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") > UNIT).select("center")


def across_salts(members: DataFrame, salted: DataFrame, label: DataFrame) -> DataFrame:
    """center, salt, other, doc: pairs of units of one center, one with what is not in the center's component, the other with all.

    Of the centers in `salted`, however few members are left to each: groups that have closed since don't decide others.
    """
    members = members.join(salted, "center", "left_semi")
    n = members.groupBy("center").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / (UNIT * 2)).cast("int"))
    many = members.join(n.select("center", "salts"), "center")
    named = many.join(label.select(F.col("node").alias("doc"), F.col("component").alias("own")), "doc", "left")
    named = named.join(label.select(F.col("node").alias("center"), F.col("component").alias("main")), "center", "left")
    apart = F.coalesce("own", "doc") != F.coalesce("main", "center")
    named = named.withColumn("apart", apart).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    odd = named.where("apart").select("center", F.col("part").alias("salt"), "salts").distinct()
    pairs = odd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("center", "salt", "other")
    left = named.where("apart").select("center", F.col("part").alias("salt"), "doc").join(pairs, ["center", "salt"])
    right = named.select("center", F.col("part").alias("other"), "doc").join(pairs, ["center", "other"])
    cols = ["center", "salt", "other", "doc"]
    return written(left.select(cols).union(right.select(cols)).distinct(), "jaccard-across")
