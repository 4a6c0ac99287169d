"""Language identification by prediction by partial matching over bytes.

One context tree per language, of variable order: a context of up to `order` bytes is kept when training saw it often
enough in any language. Escape probabilities follow method C with exclusion: what an escape leaves goes to the bytes
that the context has not seen, in proportion to their probabilities one byte shorter, so that every context's
probabilities sum to one. Statistics are frozen after training, and the code length of a byte depends only on the
longest kept context before it. That makes the trees of all languages one
finite automaton: a state per kept context, a transition per byte, and per state, byte and language a code length.
Texts are cut into strips that are read side by side, each from a few bytes before its start, which settles its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import named, slices, small_batches, text_bytes

UND = "und"
LETTER = r"\p{L}"
STRIP = 512


@dataclass
class ContextTrees:
    """Frozen statistics: `step[state * width + symbol]` is the next state, `bits[...]` a code length per language."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    width: int
    order: int
    step: np.ndarray
    bits: np.ndarray

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row's whole text under each language."""
        n, langs = len(offsets) - 1, len(self.languages)
        out = np.zeros((n, langs))
        if not len(raw):
            return out
        size = np.diff(offsets)
        per_row = -(-size // STRIP)
        row = np.repeat(np.arange(n), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = offsets[row] + nth * STRIP
        length = np.minimum(STRIP, offsets[row + 1] - start)
        by_length = np.argsort(-length, kind="stable")
        start, length, row, nth = start[by_length], length[by_length], row[by_length], nth[by_length]
        symbols = self.symbol[raw]
        state = np.zeros(len(row), np.int32)
        for back in range(self.order, 0, -1):  # the bytes before a strip that isn't its document's first
            inner = np.flatnonzero(nth > 0)
            state[inner] = self.step[state[inner] * self.width + symbols[start[inner] - back]]
        spent = np.zeros((len(row), langs), np.float32)
        alive = np.searchsorted(-length, -np.arange(STRIP), "left")
        for t in range(int(length[0])):
            k = alive[t]
            at = state[:k] * self.width + symbols[start[:k] + t]
            spent[:k] += self.bits[at]
            state[:k] = self.step[at]
        for j in range(langs):
            out[:, j] = np.bincount(row, spent[:, j], n)
        return out


def grow(texts: dict[str, list[bytes]], order: int, min_count: int, most_cells: int) -> ContextTrees:
    """Trees from training texts. most_cells bounds states * symbols * languages: the rarest contexts go first."""
    languages = sorted(texts)
    if not languages:
        return ContextTrees([], np.zeros(256, np.int32), 1, order, np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    streams = [np.frombuffer(b"\n".join(texts[name]), np.uint8) for name in languages]
    seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *streams]))
    symbol = np.full(256, len(seen), np.int32)  # the last symbol: any byte not seen in training
    symbol[seen] = np.arange(len(seen))
    width, langs = len(seen) + 1, len(languages)
    codes = [symbol[x].astype(np.int64) for x in streams]
    # counts[k][j]: (context of k symbols, symbol) as a number in base width -> how often language j has it
    grams = []
    for k in range(order + 1):
        of_language = []
        for c in codes:
            if len(c) <= k:
                of_language.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            number = np.zeros(len(c) - k, np.int64)
            for i in range(k + 1):
                number = number * width + c[i : len(c) - k + i]
            of_language.append(np.unique(number, return_counts=True))
        grams.append(of_language)
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    room = max(1, most_cells // (width * langs)) - 1
    for k in range(1, order + 1):
        numbers = np.concatenate([g[0] // width for g in grams[k]])
        counts = np.concatenate([g[1] for g in grams[k]])
        keys, inverse = np.unique(numbers, return_inverse=True)
        sums = np.bincount(inverse, counts, len(keys))
        kept = (sums >= min_count) & np.isin(keys % width ** (k - 1), contexts[k - 1])  # its suffix is kept
        kept &= np.isin(keys // width, contexts[k - 1])  # and its prefix, so that transitions stay within the trees
        keys, sums = keys[kept], sums[kept]
        if len(keys) > room:
            keys = np.sort(keys[np.argsort(-sums, kind="stable")[:room]])
        room -= len(keys)
        contexts.append(keys)
    first = np.cumsum([0, *[len(c) for c in contexts]])
    states = int(first[-1])
    step = np.zeros((states, width), np.int32)
    bits = np.zeros((states, width, langs), np.float32)
    chances = np.full((1, width, langs), 1.0 / width)
    for k, keys in enumerate(contexts):
        if k:
            shorter = np.searchsorted(contexts[k - 1], keys % width ** (k - 1))
            block, back = step[first[k - 1] + shorter].copy(), chances[shorter]
        else:
            block, back = np.zeros((1, width), np.int32), chances
        chances = np.empty((len(keys), width, langs))
        if k < order and len(contexts[k + 1]):  # a longer context, where one is kept
            longer = keys[:, None] * width + np.arange(width)
            at = np.minimum(np.searchsorted(contexts[k + 1], longer), len(contexts[k + 1]) - 1)
            found = contexts[k + 1][at] == longer
            block = np.where(found, first[k + 1] + at, block)
        step[first[k] : first[k + 1]] = block
        for j, (numbers, counts) in enumerate(grams[k]):
            context = numbers // width
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            own = keys[at] == context if len(keys) else np.zeros(len(context), bool)
            at, sym, counts = at[own], (numbers % width)[own], counts[own]
            total, kinds = np.bincount(at, counts, len(keys)), np.bincount(at, minlength=len(keys))
            shorter_p = back[:, :, j].copy()
            shorter_p[at, sym] = 0.0
            unseen = shorter_p.sum(1)
            escapes = (kinds > 0) & (kinds < width)
            weight = np.where(escapes, kinds / np.maximum(total + kinds, 1) / np.maximum(unseen, 1e-300), np.where(kinds > 0, 0.0, 1.0))
            chance = shorter_p * weight[:, None]
            chance[at, sym] = counts / np.where(escapes, total + kinds, np.maximum(total, 1))[at]
            chances[:, :, j] = chance
        bits[first[k] : first[k + 1]] = -np.log2(np.maximum(chances, 1e-300))
    return ContextTrees(languages, symbol, width, order, step.reshape(-1), bits.reshape(-1, langs))


def training_sample(docs: DataFrame, bytes_per_language: int, passage: int = 2000, most_bytes: int = 64 << 20, most_languages: int = 500) -> dict[str, list[bytes]]:
    """About bytes_per_language of passages of each language, most_bytes in all, of the most_languages with the most text.

    Every document is cut into passages of `passage` characters, and a hash of document and place draws passages, so
    long documents are learnt from like short ones. The share drawn comes from each language's total size: the sample
    does not grow with the input, and beyond the bound the largest hashes go, whatever the order of the rows.
    """
    text = F.col("text")
    usable = docs.where(F.col("lang").isNotNull() & text.rlike(LETTER)).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row_hash"))
    sizes = {r["lang"]: r["size"] for r in usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("size"), "lang").limit(most_languages).collect()}
    if not sizes:
        return {}
    each = min(bytes_per_language, most_bytes // len(sizes))
    shares = docs.sparkSession.createDataFrame([(name, int(min(1.0, each / n) * (1 << 30))) for name, n in sizes.items()], "lang string, share long")
    drawn = lambda i: F.pmod(F.xxhash64("row_hash", i), F.lit(1 << 30)) < F.col("share")
    places = F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / passage).cast("int")), drawn)
    parts = usable.join(F.broadcast(shares), "lang").select("lang", "row_hash", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(text, i * passage + 1, F.lit(passage)).alias("part")))).alias("x"))
    parts = parts.select("lang", F.col("x.part").cast("binary").alias("part"), F.xxhash64("row_hash", "x.place").alias("draw")).distinct()
    out: dict[str, list[bytes]] = {name: [] for name in sizes}
    room = dict.fromkeys(sizes, 2 * each)
    for row in parts.orderBy("draw", "lang", "part").limit(4 * sum(min(n, each) for n in sizes.values()) // passage + 64 * len(sizes)).collect():
        if room[row["lang"]] > 0:
            out[row["lang"]].append(bytes(row["part"]))
            room[row["lang"]] -= len(row["part"])
    return {name: sorted(texts) for name, texts in out.items() if texts}


def learn(docs: DataFrame, order: int = 4, min_count: int = 24, bytes_per_language: int = 400_000, most_cells: int = 12_000_000) -> ContextTrees:
    """Trees of the languages in docs.lang, from a bounded sample of its labelled rows (see training_sample).

    The documented bounds: bytes_per_language of text each, most_cells code lengths in all, whatever the input's size.
    Only lang, text and, to draw the sample, doc_id are read. A null lang, a null text and a text without a letter teach
    nothing; with no other rows nothing is learnt.
    """
    return grow(training_sample(docs, bytes_per_language), order, min_count, most_cells)


def identify(docs: DataFrame, trees: ContextTrees, keep: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred string, score double, bits_per_byte double of every whole text.

    The language with the shortest code wins, ties by name; score is its posterior share at one code length per
    byte-normalised unit: 2^-bits of the winner over the sum of all, with code lengths divided by the square root of
    the text's bytes so that it stays a graded confidence on long texts. Null text, text without a letter, and any
    text when nothing was learnt are `und` with score 0 and null bits_per_byte. Rows keep their multiplicity; other
    columns, of whatever names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    small_batches(docs)
    names = [f"keep_{i}" for i in range(len(keep))]
    cols = [named(c) if isinstance(c, str) else c for c in keep]
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    names = ["text" if isinstance(c, str) and c == "text" else n for c, n in zip(keep, names, strict=True)]  # sent once
    given = docs.select(*[c.alias(n) for c, n in zip(cols, names, strict=True) if n != "text"], lettered.alias("lettered"), "text")
    fields = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    schema = ", ".join(f"{n} {fields[n]}" for n in names) + ", lang_pred string, score double, bits_per_byte double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            lettered = np.asarray(batch.column("lettered")) & bool(own.languages)
            size = np.maximum(np.diff(offsets), 1)
            if own.languages:
                spent = own.code_lengths(raw, offsets)
                best = spent.argmin(1)
                least = spent[np.arange(len(spent)), best]
                share = 1 / np.exp2(-(spent - least[:, None]) / np.sqrt(size)[:, None]).sum(1)
                names_of = pa.array(own.languages, pa.string()).take(pa.array(best))
                lang = pa.array(np.where(lettered, names_of.to_numpy(zero_copy_only=False), UND), pa.string())
                score_of = pa.array(np.where(lettered, share, 0.0))
                rate = pa.array(least / size, mask=~lettered)
            else:
                lang = pa.array([UND] * batch.num_rows, pa.string())
                score_of, rate = pa.array(np.zeros(batch.num_rows)), pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lang, score_of, rate], names=[*names, "lang_pred", "score", "bits_per_byte"])

    found = given.mapInArrow(score, schema)
    return found.select(*[F.col(n).alias(c if isinstance(c, str) else docs.select(c).columns[0]) for n, c in zip(names, keep, strict=True)], "lang_pred", "score", "bits_per_byte")
