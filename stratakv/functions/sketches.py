"""Bloom filter, Count-Min, HyperLogLog and SimHash as tables, with the arithmetic of their sizes."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.functions.hashing import bloom_positions, flat_bytes, fnv1_64_rows, fnv1a_32, murmur64

#: Bytes of text read at a time.
SLICE_BYTES = 8 << 20
#: Our own short list; SimHash bits depend on it.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions; the number of functions comes from whole bits per element."""
    bits = math.floor(-n * math.log(p) / math.log(2) ** 2)
    return bits, round(bits // n * math.log(2)) if n else 0


def bloom_create(df: DataFrame, n: Column, p: Column) -> DataFrame:
    ln2 = math.log(2)
    bits = F.floor(-n * F.log(p) / (ln2 * ln2)).cast("bigint")
    return df.withColumn("bits", bits).withColumn("hashes", F.round(F.floor(F.col("bits") / n) * ln2).cast("int"))


def bloom_add(keys: DataFrame, n: int, p: float) -> DataFrame:
    """pos: the set positions of the filter over keys.key."""
    bits, hashes = bloom_size(n, p)
    return keys.select(F.explode(bloom_positions(hashes, bits)("key")).alias("pos")).distinct()


def bloom_contains(probes: DataFrame, positions: DataFrame, n: int, p: float) -> DataFrame:
    """key, maybe: false only for keys that were never added."""
    bits, hashes = bloom_size(n, p)
    asked = probes.select("key", F.explode(F.array_distinct(bloom_positions(hashes, bits)("key"))).alias("pos"))
    hit = asked.join(positions.withColumn("set", F.lit(1)), "pos", "left")
    return hit.groupBy("key").agg((F.count("set") == F.count("*")).alias("maybe"))


def bloom_pack(n: int, p: float, positions: list[int]) -> bytes:
    """Big-endian: element count, probability, bit count, a byte for each bit, hash count."""
    bits, hashes = bloom_size(n, p)
    body = bytearray(bits)
    for i in positions:
        body[i] = 1
    return struct.pack(">QdQ", n, p, bits) + bytes(body) + struct.pack(">Q", hashes)


def bloom_unpack(data: bytes) -> tuple[int, float, int, list[int], int]:
    n, p, bits = struct.unpack_from(">QdQ", data)
    return n, p, bits, [i for i, b in enumerate(data[24 : 24 + bits]) if b], struct.unpack_from(">Q", data, 24 + bits)[0]


def cms_buckets(keys: DataFrame, width: int, hashes: int) -> DataFrame:
    """Row and bucket of each key in every row. Rows are shifts of one hash."""
    h = (fnv1a_32(F.col("key")) + F.col("row")) % 4294967296 % 4294967295
    return keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))).withColumn("bucket", (h % width).cast("bigint"))


def cms_update(keys: DataFrame, width: int, hashes: int) -> DataFrame:
    """Counts of copies first, so that a frequent key is hashed once per task, not once per copy."""
    counted = keys.groupBy("key").agg(F.count("*").alias("n"))
    return cms_buckets(counted, width, hashes).groupBy("row", "bucket").agg(F.sum("n").alias("cnt"))


def cms_estimate(probes: DataFrame, cells: DataFrame, width: int, hashes: int) -> DataFrame:
    asked = cms_buckets(probes.select("key"), width, hashes).join(cells, ["row", "bucket"], "left")
    return asked.groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_pack(width: int, table: list[list[int]]) -> bytes:
    return struct.pack(f"<ii{width * len(table)}i", width, len(table), *[c for row in table for c in row])


def cms_unpack(data: bytes) -> list[list[int]]:
    width, hashes = struct.unpack_from("<ii", data)
    cells = struct.unpack_from(f"<{width * hashes}i", data, 8)
    return [list(cells[i * width : (i + 1) * width]) for i in range(hashes)]


def hll_size(n: int) -> tuple[int, int, float]:
    """Registers (the smallest power of two above n), index bits and alpha."""
    m = 1 << n.bit_length()
    return m, m.bit_length() - 1, 0.7213 / (1 + 1.079 / m)


def hll_create(df: DataFrame, n: Column) -> DataFrame:
    bits = F.length(F.bin(n))
    m = F.pow(F.lit(2.0), bits).cast("bigint")
    return df.withColumn("m", m).withColumn("b", bits.cast("int")).withColumn("alpha", F.lit(0.7213) / (F.lit(1.0) + F.lit(1.079) / F.col("m")))


def hll_add(keys: DataFrame, n: int) -> DataFrame:
    """reg, rank: the largest rank per register, from the hash's upper bits and its trailing zeros."""
    _, bits, _ = hll_size(n)
    h = keys.select("key").distinct().select(murmur64()("key").alias("h"))
    below = F.bit_count(F.bitwise_not(F.col("h")).bitwiseAND(F.expr("try_subtract(h, 1L)")))
    zeros = F.when(F.col("h") == F.lit(-(1 << 63)), F.lit(63)).otherwise(below)
    return h.select(F.shiftrightunsigned("h", 64 - bits).alias("reg"), (zeros + 1).cast("int").alias("rank")).groupBy("reg").agg(F.max("rank").alias("rank"))


def hll_count(registers: DataFrame, n: int) -> DataFrame:
    """Raw estimate, without corrections for small or large counts; registers not in the table are zero."""
    m, _, alpha = hll_size(n)
    total = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)) + (m - F.count("*"))
    return registers.agg(F.floor(F.lit(alpha * m * m) / total).cast("bigint").alias("estimate"))


def hll_pack(n: int, registers: dict[int, int]) -> bytes:
    m, bits, alpha = hll_size(n)
    return struct.pack(f">QdQ{m}q", bits, alpha, m, *[registers.get(i, 0) for i in range(m)])


def hll_unpack(data: bytes) -> tuple[int, float, list[int]]:
    bits, alpha, m = struct.unpack_from(">QdQ", data)
    return bits, alpha, list(struct.unpack_from(f">{m}q", data, 24))


def word_prints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of every row of lower-cased text, and whether the row has a word at all."""
    blank = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word ends where its row does
    solid = ~blank
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    start, end = np.flatnonzero(solid & (~before | edge[:-1])), np.flatnonzero(solid & (~after | edge[1:])) + 1
    size = end - start
    short = np.zeros(len(size), np.int64)
    for i in range(max(map(len, STOP_WORDS))):
        there = size > i
        short[there] |= raw[start[there] + i].astype(np.int64) << (8 * i)
    common = np.array([int.from_bytes(w.encode(), "little") for w in STOP_WORDS])
    kept = (size > max(map(len, STOP_WORDS))) | ~np.isin(short, common)
    start, end = start[kept], end[kept]
    h = fnv1_64_rows(raw, start, end)
    negative = h >> np.uint64(63) == 1
    magnitude = np.where(negative, np.uint64(0) - h, h)  # a negative number's magnitude is its two's complement
    cut = np.searchsorted(start, offsets)
    has = np.diff(cut) > 0
    first = cut[:-1][has]
    prints = np.zeros(len(has), np.uint64)
    for i in range(64):
        bit = negative if i == 0 else (magnitude >> np.uint64(63 - i)) & np.uint64(1) == 1
        more = np.add.reduceat(np.where(bit, 1, -1), first) > 0 if len(first) else np.zeros(0, bool)
        prints[has] |= more.astype(np.uint64) << np.uint64(63 - i)
    return prints, has


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, print (64 bits as a long): words without stop words, weighed by how often they come.

    Bits of a word are its FNV-1 hash as a signed number: the sign, then the magnitude. A document is read where it lies,
    so nothing is shuffled; one without a word has no print.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.column("text").nbytes, 1)))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                prints, has = word_prints(*flat_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(has)), pa.array(prints[has].view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(read, f"doc_id {kind}, print long")


def print_text(bits: Column) -> Column:
    """The 64 bits as signs."""
    return F.lpad(F.bin(bits), 64, "0")


def hamming(a: Column, b: Column) -> Column:
    """Places in which two prints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(prints: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of distinct prints at most `most` (up to 3) bits apart.

    Of six blocks of bits, such a pair has three alike at least, so prints meet by every three of the six, on some 32
    bits; a pair that shares more than three blocks is taken where the first three of them meet, and needs no distinct.
    Copies of a print count once, as its smallest doc_id, so identical documents make no pairs here: print_classes has
    the documents that each of these ids stands for.
    """
    edges = [0, 11, 22, 33, 43, 53, 64]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in three) for three in combinations(range(6), 3)]
    masks = [F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks]
    one = prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    keyed = one.withColumn("bits", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("print").bitwiseAND(m).alias("key")) for i, m in enumerate(masks)])))
    a, b = (keyed.select(F.col("bits.way").alias("way"), F.col("bits.key").alias("key"), F.col("doc_id").alias(f"{n}_id"), F.col("print").alias(f"{n}_print")) for n in ("a", "b"))
    apart = F.col("a_print").bitwiseXOR(F.col("b_print"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(m) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = a.join(b, ["way", "key"]).where((F.col("a_id") < F.col("b_id")) & (F.bit_count(apart) <= most) & (first == F.col("way")))
    return pairs.select("a_id", "b_id", hamming(F.col("a_print"), F.col("b_print")).alias("distance"))


def print_classes(prints: DataFrame) -> DataFrame:
    """doc_id, class_id of every document: the smallest doc_id with its print, which near_pairs has for all of them."""
    one = prints.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    return prints.join(one, "print").select("doc_id", "class_id")


def simhash_pack(doc: str, words: list[str], bits: str) -> bytes:
    text, tokens = doc.encode(), "\n".join(words).encode()
    return struct.pack("<QQ", len(text), len(tokens)) + text + tokens + np.array([int(b) for b in bits], np.uint8).tobytes()


def simhash_unpack(data: bytes) -> tuple[str, list[str], str]:
    n, m = struct.unpack_from("<QQ", data)
    text, tokens, bits = data[16 : 16 + n], data[16 + n : 16 + n + m], data[16 + n + m :]
    return text.decode(), tokens.decode().split("\n") if tokens else [], "".join(map(str, bits))

