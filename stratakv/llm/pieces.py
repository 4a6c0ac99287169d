"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus scan over chunks.

A model's text is the given text with a blank put before it and blanks written as U+2581. A segmentation is a path from
piece to piece, and the encoding is the best path: for a Unigram model the one with the largest sum of scores; for a BPE
model the one path in which any two neighbours are what the model makes of the two of them together, pairs that aren't
being worth minus infinity. (Merges are local: a sequence of pieces is what merging the whole gives exactly if this
holds for all neighbours, so that path is unique.)

A giant text is cut at any characters into chunks. A chunk's state at a border is the piece that covers the last
character before it. The chunk's transfer matrix holds, for every state at either border, the best sum in between;
matrices combine by the max-plus product, which is associative, so a scan over a text's small matrices settles the
states at all borders, and every chunk is traced back between its own two, wherever there is room.

No piece of a usable model has a blank after another character, so no piece crosses the place where a run of blanks
starts. There all paths of a chunk meet, and what lies between two such places is encoded on its own, each distinct
segment once a batch, by the public library; so are whole texts that aren't giant. A chunk without a blank is searched
character by character.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import named, slices, small_batches, span_hashes, text_bytes, written

SIGN = "▁"
#: Bytes of text from which a document is giant, and of its chunks; distinct segments and pairs that a worker remembers.
CHUNK, REMEMBER = 1 << 16, 200_000
NEVER = float("-inf")


class Codec:
    """One model in one worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SIGN in p[1:] and p.strip(SIGN) for p in names):
            raise ValueError("pieces of this model go on past a blank")
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(len(names))]
        spelled = [b"" if s else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SIGN, " ").encode() for i, (p, s) in enumerate(zip(names, special, strict=True))]
        self.size = np.array([len(b) for b in spelled], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.blank = self.model.piece_to_id(SIGN)
        self.known: dict[int, np.ndarray] = {}
        byte = [self.model.is_byte(i) for i in range(len(names))]
        self.byte_ids = {spelled[i][0]: i for i in range(len(names)) if byte[i]}
        if len(self.byte_ids) < 256:
            raise ValueError("this model has no pieces for single bytes")
        self.numbers = {p.replace(SIGN, " "): i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.lattice = Lattice(dict.fromkeys(self.numbers, 0.0), 0.0, Merges({p: self.model.get_score(i) for p, i in self.numbers.items()}))

    def ids_of(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is none goes as its bytes."""
        out: list[int] = []
        for piece in pieces:
            number = self.numbers.get(piece)
            out += [number] if number is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    def encode_segments(self, keys: list[int], texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        got = self.model.encode([texts[i][1:].decode() for i in new], num_threads=1) if new else []
        for i, ids in zip(new, got, strict=True):
            self.known[keys[i]] = np.array(ids if len(texts[i]) > 1 else [self.blank], np.int32)
        return [self.known[k] for k in keys]

    def encode(self, raw: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the row offsets among them. prefix: the row starts a text, so a blank comes before it."""
        data, edges = with_blanks(raw, offsets, prefix)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = data == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[edges[:-1][np.diff(edges) > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(data))
        key, first, of = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        whole = data.tobytes()
        ids = self.encode_segments(key.tolist(), [whole[start[i] : end[i]] for i in first])
        size = np.array([len(x) for x in ids], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        per = size[of]
        total = np.concatenate([[0], np.cumsum(per)])
        take = np.repeat(at[of] - total[:-1], per) + np.arange(total[-1])
        return np.concatenate(ids)[take], total[np.searchsorted(start, edges)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets, without the blank put before a text."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.letters[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])]
        edges = total[offsets]
        keep = np.ones(len(out), bool)
        heads = edges[:-1][prefix & (np.diff(edges) > 0)]
        keep[heads] = False
        return out[keep], edges - np.searchsorted(heads, edges)


def with_blanks(raw: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank put before every row that starts a text and isn't empty."""
    own = prefix & (np.diff(offsets) > 0)
    edges = offsets + np.concatenate([[0], np.cumsum(own)])
    out = np.full(int(edges[-1]), 32, np.uint8)
    body = np.ones(len(out), bool)
    body[edges[:-1][own]] = False
    out[body] = raw
    return out, edges


def plain(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U+2581 as a blank, which the model cannot tell from it."""
    if len(raw) > 2:
        hit = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
        if len(hit):
            out, keep = raw.copy(), np.ones(len(raw), bool)
            out[hit], keep[hit + 1], keep[hit + 2] = 32, False, False
            return out[keep], offsets - 2 * np.searchsorted(hit, offsets)
    return raw, offsets


class Merges:
    """Whether a BPE model leaves two pieces side by side."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: of all neighbours that make a piece, those with the highest score go first, left ones before right ones."""
        parts = list(text)
        while len(parts) > 1:
            worth = [self.scores.get(a + b, NEVER) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            most = max(worth)
            if most == NEVER:
                break
            i = worth.index(most)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def __call__(self, a: str, b: str) -> bool:
        if (a, b) not in self.known:
            if len(self.known) > REMEMBER:
                self.known.clear()
            self.known[a, b] = self.merged(a + b) == [a, b]
        return self.known[a, b]


class Lattice:
    """Paths over pieces. scores: of pieces; unknown: of a character that is none; joins: may the one follow the other?"""

    def __init__(self, scores: dict[str, float], unknown: float, joins: Callable[[str, str], bool] | None = None):
        self.scores, self.unknown, self.joins = scores, unknown, joins
        self.longest = max(map(len, scores), default=1)
        self.starts = {p[:n] for p in scores for n in range(1, len(p) + 1)}

    def pieces_at(self, text: str, at: int) -> list[tuple[int, float]]:
        """Ends and scores of the pieces that start there."""
        found = []
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            part = text[at:end]
            if part not in self.starts:
                break
            if part in self.scores:
                found.append((end, self.scores[part]))
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, self.unknown))
        return found

    def states(self, text: str, border: int, last: bool) -> list[tuple[int, int]]:
        """Start and end, from the border, of the pieces over the character before it; those that end there if the text does."""
        found = [(at - border, end - border) for at in range(max(0, border - self.longest), border) for end, _ in self.pieces_at(text, at)]
        return [(a, b) for a, b in found if (b == 0 if last else b >= 0)]

    def forward(self, text: str, sources: list[tuple[int, int]], stop: int, back: dict | None = None) -> tuple[list[float] | None, dict[tuple[int, int], list[float]]]:
        """Best sums from each source, a piece (start, end), to the pieces over `stop`.

        Once all paths have met in one piece, sums are counted from there, and those up to there are given first.
        """
        before, width = None, len(sources)
        live: dict[int, dict[int, list[float]]] = {}
        for i, (start, end) in enumerate(sources):
            live.setdefault(end, {}).setdefault(start, [NEVER] * width)[i] = 0.0
        out: dict[tuple[int, int], list[float]] = {}
        for at in range(min(live), stop):
            here = live.pop(at, None)
            if here is None:
                continue
            if width > 1 and not live and not out and len(here) == 1:
                (start, sums), width = *here.items(), 1
                before, here = sums, {start: [0.0]}
            ahead = self.pieces_at(text, at)
            for start, sums in here.items():
                for end, score in ahead:
                    if self.joins is None or start < 0 or self.joins(text[start:at], text[at:end]):
                        there = out.setdefault((at, end), [NEVER] * width) if end >= stop else live.setdefault(end, {}).setdefault(at, [NEVER] * width)
                        for i, value in enumerate(sums):
                            if value + score > there[i]:
                                there[i] = value + score
                                if back is not None:
                                    back[at, end] = start
        for end, here in live.items():  # sources that reach beyond
            for start, sums in here.items():
                if end >= stop:
                    out[start, end] = sums
        return before, out

    def trace(self, text: str, source: tuple[int, int], stop: int, goal: tuple[int, int]) -> list[str]:
        """Pieces of the best path after the source up to the goal, a piece over `stop`."""
        back: dict[tuple[int, int], int] = {}
        self.forward(text, [source], stop, back)
        out, (start, end) = [], goal
        while (start, end) != source:
            out.append(text[start:end])
            start, end = back[start, end], start
        return out[::-1]


def meetings(text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and last place from low to high where a run of blanks starts; no piece crosses it."""
    first = next((i for i in range(low, high + 1) if text[i : i + 1] == " " and (i == 0 or text[i - 1] != " ")), None)
    if first is None:
        return None
    return first, next(i for i in range(high, low - 1, -1) if text[i : i + 1] == " " and (i == 0 or text[i - 1] != " "))


@dataclass
class Part:
    """A chunk of a text: text[low:high] with what pieces over its borders need around it."""

    text: str
    low: int
    high: int
    first: bool
    last: bool

    def sources(self, lattice: Lattice) -> list[tuple[int, int]]:
        return [(-1, 0)] if self.first else [(a + self.low, b + self.low) for a, b in lattice.states(self.text, self.low, False)]

    def goals(self, lattice: Lattice) -> list[tuple[int, int]]:
        return [(a + self.high, b + self.high) for a, b in lattice.states(self.text, self.high, self.last)]

    def meetings(self) -> tuple[int, int] | None:
        return meetings(self.text, self.low if self.first else max(self.low, 1), self.high - 1)

    def transfer(self, lattice: Lattice, cut: bool = True) -> np.ndarray:
        """The best sum from every source to every goal. Between two meetings all paths are alike, and nothing is counted."""
        sources, goals = self.sources(lattice), self.goals(lattice)
        met = self.meetings() if cut else None
        if met is None:
            before, out = lattice.forward(self.text, sources, self.high)
            rows = np.array([out.get(g, [NEVER] * len(next(iter(out.values()), [0]))) for g in goals]).T.reshape(-1, len(goals))
            return rows if before is None else np.array(before)[:, None] + rows
        before, out = lattice.forward(self.text, sources, met[0]) if met[0] > 0 else (None, {(-1, 0): [0.0]})
        reached = np.array([v for (_, end), v in out.items() if end == met[0]]).max(0)
        after = lattice.forward(self.text, [(-1, met[1])], self.high)[1]
        return (reached if before is None else np.array(before) + reached[0])[:, None] + np.array([after.get(g, [NEVER])[0] for g in goals])[None, :]

    def pieces(self, lattice: Lattice, source: tuple[int, int], goal: tuple[int, int], cut: bool = True) -> tuple[list[str], str, list[str]]:
        """Pieces after the source up to the first meeting, the text from there to the last one, and the pieces on to the goal."""
        met = self.meetings() if cut else None
        if met is None:
            return lattice.trace(self.text, source, self.high, goal), "", []
        head: list[str] = []
        if source[1] < met[0]:
            ends = {g: v for g, v in lattice.forward(self.text, [source], met[0])[1].items() if g[1] == met[0]}
            head = lattice.trace(self.text, source, met[0], max(ends, key=lambda g: ends[g][0]))
        return head, self.text[met[0] : met[1]], lattice.trace(self.text, (-1, met[1]), self.high, goal)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: best sums through any state in between."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state at every border, first and last included, by a scan over the matrices."""
    left = [np.zeros((1, 1))]
    for matrix in matrices:
        left.append(product(left[-1], matrix))
    states = [int(left[-1][0].argmax())]
    if left[-1][0].max() == NEVER:
        raise ValueError("no path over the pieces")
    for before, matrix in zip(left[-2::-1], reversed(matrices), strict=True):
        states.append(int((before[0] + matrix[:, states[-1]]).argmax()))
    return states[::-1]


def cut_text(text: str, chunk: int, around: int) -> list[Part]:
    """Parts of about `chunk` characters, `around` at least, each with as much of its neighbours."""
    chunk = max(chunk, around, 1)
    borders = [*range(0, max(len(text) - chunk, 0) + 1, chunk), len(text)] if text else [0, 0]
    return [Part(text[max(0, a - around) : b + around], min(a, around), min(a, around) + b - a, a == 0, b == len(text)) for a, b in zip(borders[:-1], borders[1:], strict=True)]


def chunked(batches: Iterator[pa.RecordBatch], kept: list[str], most: int, around: int) -> Iterator[pa.RecordBatch]:
    """A row for every chunk of a giant text, the blank put before it among them."""
    for batch in slices(batches, "text"):
        raw, offsets = plain(*text_bytes(batch.column("text")))
        for i in range(batch.num_rows):
            for number, part in enumerate(cut_text(" " + raw[offsets[i] : offsets[i + 1]].tobytes().decode(), most, around)):
                row = {"chunk": pa.array([number], pa.int32()), "part": [part.text], "low": pa.array([part.low], pa.int32()), "high": pa.array([part.high], pa.int32()), "is_first": [part.first], "is_last": [part.last]}
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in kept], *[pa.array(v) if isinstance(v, list) else v for v in row.values()]], names=[*kept, *row])


def part_of(row: dict) -> Part:
    return Part(row["part"], row["low"], row["high"], row["is_first"], row["is_last"])


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """`keep`, token_ids array<int>, decoded string of every row of docs.

    token_ids are those that the public library gives the whole text; decoded is made from them alone and equals the
    text, but that U+2581 comes back as a blank. A null text has null ids and a null decoded text; an empty one has
    none and "". Texts over `chunk` bytes are cut into chunks, encoded anywhere and put together again, whether they have
    blanks or not. Rows keep their multiplicity; columns not in `keep` are not read, and names don't matter. An empty
    table gives an empty result. The model is a BPE model with pieces for single bytes.
    """
    small_batches(docs)
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    shared, around = spark.sparkContext.broadcast(base64.b64encode(model)), Codec(model).lattice.longest
    names = [f"keep_{i}" for i in range(len(keep))]
    columns = [named(c).alias(n) for c, n in zip(keep, names, strict=True)]
    given = docs.select(*columns, F.col("text").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    head = "".join(f"{c} {kinds[c]}, " for c in names)
    large = F.coalesce(F.octet_length("text") > chunk, F.lit(False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(base64.b64decode(shared.value))
        for batch in slices(batches, "text", 2 << 20):
            raw, offsets = plain(*text_bytes(batch.column("text")))
            whole = np.ones(batch.num_rows, bool)
            ids, at = codec.encode(raw, offsets, whole)
            out, edges = codec.decode(ids, at, whole)
            there = np.asarray(batch.column("text").is_valid())
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~there))
            texts = pa.StringArray.from_buffers(len(there), pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()), pa.array(there).buffers()[1] if not there.all() else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists, texts], names=[*names, "token_ids", "decoded"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Codec(base64.b64decode(shared.value)).lattice
        for batch in batches:
            for row in batch.to_pylist():
                matrix = part_of(row).transfer(lattice)
                yield pa.RecordBatch.from_pydict({"row_id": [row["row_id"]], "chunk": pa.array([row["chunk"]], pa.int32()), "goals": pa.array([matrix.shape[1]], pa.int32()), "matrix": [matrix.tobytes()]})

    def scan(key: tuple, text: pa.Table) -> pa.Table:
        rows = text.sort_by("chunk").to_pylist()
        states = border_states([np.frombuffer(r["matrix"]).reshape(-1, r["goals"]) for r in rows])
        return pa.table({"row_id": [r["row_id"] for r in rows], "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "source": pa.array(states[:-1], pa.int32()), "goal": pa.array(states[1:], pa.int32())})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(base64.b64decode(shared.value))
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                part = part_of(row)
                before, between, after = part.pieces(codec.lattice, part.sources(codec.lattice)[row["source"]], part.goals(codec.lattice)[row["goal"]])
                raw = np.frombuffer(between.encode(), np.uint8)
                inner, _ = codec.encode(raw, np.array([0, len(raw)]), np.zeros(1, bool))
                ids = np.concatenate([np.array(codec.ids_of(before), np.int32), inner.astype(np.int32), np.array(codec.ids_of(after), np.int32)])
                out, _ = codec.decode(ids, np.array([0, len(ids)]), np.array([part.first]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in [*names, "row_id", "chunk"]], pa.array([ids], pa.list_(pa.int32())), pa.array([out.tobytes().decode()])], names=[*names, "row_id", "chunk", "token_ids", "decoded"])

    small = given.where(~large).mapInArrow(work, f"{head}token_ids array<int>, decoded string")
    giant = given.where(large).withColumn("row_id", F.monotonically_increasing_id())
    parts = giant.mapInArrow(lambda b: chunked(b, [*names, "row_id"], chunk, around), f"{head}row_id long, chunk int, part string, low int, high int, is_first boolean, is_last boolean")
    parts = written(parts.repartition("row_id", "chunk"), "piece-chunks")
    matrices = parts.select("row_id", "chunk", "part", "low", "high", "is_first", "is_last").mapInArrow(transfers, "row_id long, chunk int, goals int, matrix binary")
    borders = matrices.groupBy("row_id").applyInArrow(scan, "row_id long, chunk int, source int, goal int")
    settled = parts.join(borders, ["row_id", "chunk"]).select(*names, "row_id", "chunk", "part", "low", "high", "is_first", "is_last", "source", "goal")
    settled = settled.mapInArrow(settle, f"{head}row_id long, chunk int, token_ids array<int>, decoded string")
    whole = settled.groupBy("row_id").agg(*[F.first(c).alias(c) for c in names], F.sort_array(F.collect_list(F.struct("chunk", "token_ids", "decoded"))).alias("parts"))
    whole = whole.select(*names, F.flatten("parts.token_ids").alias("token_ids"), F.array_join("parts.decoded", "").alias("decoded"))
    both = small.unionByName(whole)
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "token_ids", "decoded")


def unigram_scan(text: str, scores: dict[str, float], chunk: int = 256, unknown: float = -100.0) -> list[str]:
    """The segmentation of text into pieces with the largest sum of scores; single characters that are no piece cost `unknown`."""
    lattice = Lattice(scores, unknown)
    parts = cut_text(text, chunk, lattice.longest)
    if not text:
        return []
    states = border_states([p.transfer(lattice, False) for p in parts])
    out: list[str] = []
    for part, a, b in zip(parts, states[:-1], states[1:], strict=True):
        out += part.pieces(lattice, part.sources(lattice)[a], part.goals(lattice)[b], False)[0]
    return out
