"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a range of ids, or of any other order that is named, form one stream of tokens. It is cut into windows
of at most `size` tokens. Windows end at document ends, at sentence ends (at least
`spacing` tokens apart) or, inside sentences longer than that, at forced points.
The cost of a window is its padding plus what its end costs: nothing at a document's end, a little at a
sentence's, more within one. A window that is a power of two is not padded.

With f the least cost up to a cut at place c, f(j) = end(j) + size - c_j + min(f(i) + c_i)
over the cuts i with c_j - c_i <= size. The minimum slides with j, so a monotone
queue gives each transition in constant time; exact powers of two are looked up.
Long streams are solved `horizon` tokens at a time; the last windows of a solved part are
reopened with what follows, so memory is bounded and a stream pays one tail.

Edge cases: a null or empty text is its end token alone; null ids come first;
rows with one id are kept in the order of their texts' hashes.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens

SIZE = 4096
END_ID = 2
SPACING = 32
HORIZON = 64 * SIZE
#: Cost of a window's end, in tokens of padding.
SENTENCE_COST, FORCED_COST, WINDOW_COST = 4, 64, 1
DOCUMENT, SENTENCE, FORCED = 0, 1, 2
_COST = (0, SENTENCE_COST, FORCED_COST)


def sentence_ends(e: tokens.Encoder) -> np.ndarray:
    """By id: whether the token ends a sentence (punctuation with a stop in it, at a word's end)."""
    out = np.zeros(e.vocabulary, bool)
    for text, i in e.tokenizer.get_vocab().items():
        if text.endswith("</w>"):
            core = text[:-4]
            out[i] = any(c in ".!?" for c in core) and not any(c.isalnum() for c in core)
    return out


def cuts_of(ids: np.ndarray, ends: np.ndarray, spacing: int, size: int) -> tuple[list[int], list[int]]:
    """Places (tokens before the cut) and kinds of the cuts of one document, its end last."""
    found = np.flatnonzero(ends[ids[:-1]]) + 1
    n = len(ids)
    if len(found):  # the first of every stretch of `spacing` tokens
        slot = found // spacing
        found = found[np.concatenate([[True], slot[1:] != slot[:-1]])]
        found = found[found < n]
    edges = np.concatenate([[0], found, [n]])
    places, kinds = [], []
    step = max(1, size // 64)
    if (np.diff(edges) <= 8 * step).all():
        return [*found.tolist(), n], [SENTENCE] * len(found) + [DOCUMENT]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 8 * step:
            inner = list(range(a + step, b, step))
            places += inner
            kinds += [FORCED] * len(inner)
        places.append(b)
        kinds.append(DOCUMENT if b == n else SENTENCE)
    return places, kinds


def best_cuts(places: list[int], kinds: list[int], size: int, more: bool = False) -> list[int]:
    """The places at which to cut a stream that starts at 0.

    places ascend, no two more than size apart. The last one is a cut, unless more
    is to come: then the path ends wherever in the last window it is cheapest.
    """
    where = {0: 0.0}
    came: dict[int, int] = {}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    halves = [size >> k for k in (1, 2) if size >> k]
    for c, kind in zip(places, kinds, strict=True):
        while c - queue[0][1] > size:
            queue.popleft()
        sofar, start = queue[0]
        best, origin = sofar + size - c, start
        for h in halves:
            f = where.get(c - h)
            if f is not None and f < best:
                best, origin = f, c - h
        best += _COST[kind] + WINDOW_COST
        where[c], came[c] = best, origin
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c))
    out, c = [], min((p for p in places if p > places[-1] - size), key=where.__getitem__) if more else places[-1]
    while c:
        out.append(c)
        c = came[c]
    return out[::-1]


def tail(n: int, size: int) -> list[int]:
    """Lengths for the last n tokens of a stream: powers of two, or one padded window where that costs little."""
    out = []
    while n:
        take = n if size - n <= size // 64 or n & (n - 1) == 0 else 1 << (n.bit_length() - 1)
        out.append(min(take, size))
        n -= out[-1]
    return out


class Stream:
    """Takes documents in order, gives pieces: (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, size: int, spacing: int, horizon: int):
        self.size, self.spacing, self.horizon = size, spacing, horizon
        self.sequence = first_sequence
        self.docs: deque[list] = deque()  # [doc_id, ids, tokens already given]
        self.places: list[int] = []
        self.kinds: list[int] = []
        self.n = 0

    def add(self, doc: int | None, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
        places, kinds = cuts_of(ids, ends, self.spacing, self.size)
        self.places += [p + self.n for p in places]
        self.kinds += kinds
        self.n += len(ids)
        self.docs.append([doc, ids, 0])
        return self.give(best_cuts(self.places, self.kinds, self.size, True)[:-1]) if self.n >= self.horizon else []

    def close(self) -> list[tuple]:
        if not self.n:
            return []
        path = best_cuts(self.places, self.kinds, self.size)[:-1]
        done = path[-1] if path else 0
        for n in tail(self.n - done, self.size):
            done += n
            path.append(done)
        return self.give(path)

    def give(self, path: list[int]) -> list[tuple]:
        out, at = [], 0
        for c in path:
            offset = 0
            while at < c:
                doc, ids, given = self.docs[0]
                n = min(c - at, len(ids) - given)
                out.append((doc, given, n, zlib.crc32(ids[given : given + n].astype("<u4").tobytes()), len(ids), self.sequence, offset))
                at, offset = at + n, offset + n
                if given + n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0][2] = given + n
            self.sequence += 1
        keep = int(np.searchsorted(self.places, at, "right"))
        self.places = [p - at for p in self.places[keep:]]
        self.kinds = self.kinds[keep:]
        self.n -= at
        return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def in_order(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id and text, ranges of the order in partitions, ascending in each; without an order by doc_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"_o{i}") for i in range(len(order or []))] or [F.col("doc_id")]
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])])
    ties = [F.col("doc_id")] if order else []
    return some.repartitionByRange(n, *keys).sortWithinPartitions(*keys, *ties, F.xxhash64("text")).select("doc_id", "text")


def pack(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SIZE, spacing: int = SPACING, horizon: int = HORIZON, order: list[str] | None = None, kept: int = tokens.KEPT_CHUNKS) -> DataFrame:
    """Pieces of all documents (doc_id, text); see PIECES. Sequence ids ascend with the order, which is that of doc ids unless columns are named. kept: chunks that a Python worker remembers (tokens.Encoder)."""

    held = docs.sparkSession.sparkContext.broadcast(tokens.Held(path, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held.value.get()
        ends = sentence_ends(encoder)
        stream = Stream(TaskContext.get().partitionId() << 40, size, spacing, horizon)
        out: list[tuple] = []
        for b in C.slices(batches, most=2_000_000):
            for doc, ids in zip(C.column(b, "doc_id"), encoder.encode(C.texts(b)), strict=True):
                out += stream.add(doc, np.append(ids, np.int32(end_id)), ends)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=PIECES)
                out = []
        out += stream.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=PIECES)

    return in_order(docs, order).mapInArrow(run, ", ".join(f"{f.name} long" for f in PIECES))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir), tokens.public_path())
