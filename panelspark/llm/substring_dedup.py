"""Substring dedup by relative Lempel-Ziv parsing against distributed reference blocks.

Every text is cut into content-defined blocks: a block is a run of windows (50
consecutive words) that share one anchor, the least hash among the 12-word grams
inside the window. Equal texts are cut alike wherever they stand, so a block is
the unit of the reference: `reference_blocks` indexes every distinct block of the
corpus by (anchor, content hash) with the smallest document that holds it. A
document is parsed against that whole index:

* a block whose content an earlier document has is a match of all its windows with
  the place where the index has it;
* wherever an anchor has more than one content, blocks agree only in part. Their
  windows are matched one by one (`boundary_windows`), by 128 bits of hash, with the
  first place that has them;
* `parse` goes through a document from left to right. At each window it takes the
  match that reaches farthest along one diagonal, across blocks and single windows,
  as a factor (start, end, ref_doc, ref_start); the parse goes on with the windows
  that straddle the factor's end, so that none is lost where two factors meet.

The reference has each distinct block at one place (its first document), so a factor
is the longest match with that reference. Of a window that several blocks of the
smallest document share, one place is taken. A factor is at least one window long by
construction; shorter matches are literals. Nothing is compared pairwise: hot
passages meet in map-side combined minima.

Edge cases: texts that are null or have fewer words than a window give no spans;
null ids are the last in order, so such rows are never a reference for others that
have an id; repeated rows are each judged, and rows with one doc_id never remove
each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
GRAM = 12
#: Windows handled at once; longer texts are cut into pieces of so many, which only adds boundary checks.
PIECE = 1 << 18
NO_ID = (1 << 63) - 1
_BASE1, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    for have in (size, PIECE * 2):
        if (base, have) in _powers:
            return _powers[base, have][:n]
    out = np.full(size, base, np.uint64)
    out[0] = 1
    _powers[base, size] = np.multiply.accumulate(out)
    return _powers[base, size][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of word spans of one piece of text, from prefix sums of a polynomial in the words' hashes."""

    def __init__(self, words: list[bytes], base: int):
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.inverse = _power(pow(base, -1, 1 << 64), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(h * _power(base, len(words)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _leasts(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def blocks_of(words: list[bytes], window: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """(first window, windows, anchor, content hash) of the blocks of a text, piece by piece."""
    out = []
    for at in range(0, len(words) - window + 1, PIECE):
        part = words[at : at + PIECE + window - 1]
        spans = Spans(part, _BASE1)
        i = np.arange(len(part) - gram + 1)
        grams = spans.of(i, i + gram)
        # the high bits decide, then the first place; both depend on the content alone
        keyed = (grams & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1)) | i.astype(np.uint64)
        place = (_leasts(keyed, window - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        count = np.diff(np.append(first, len(place)))
        out.append((first + at, count, grams[place[first]], spans.of(first, first + count + window - 1)))
    return out


def reference_blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, first, windows, anchor, content) of every block of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            rows: list[tuple] = []
            for doc, key, text in zip(C.column(b, "doc_id"), C.column(b, "row_key"), C.texts(b), strict=True):
                words = (text or b"").split()
                rows += [(doc, key, *x) for x in blocks_of(words, window, gram)]
            n = [len(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([r[0] for r in rows], n).astype(np.int64)),
                    pa.array(np.repeat([r[1] for r in rows], n).astype(np.int64)),
                    *(pa.array(np.concatenate([r[k] for r in rows] or [np.zeros(0)]).astype(t).view(v)) for k, t, v in ((2, np.int32, np.int32), (3, np.int32, np.int32), (4, np.uint64, np.int64), (5, np.uint64, np.int64))),
                ],
                ["doc_id", "row_key", "first", "windows", "anchor", "content"],
            )

    return docs.mapInArrow(run, "doc_id long, row_key long, first int, windows int, anchor long, content long")


def boundary_windows(docs: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, at, w1, w2): a 128-bit hash of every window of the asked blocks."""
    lists = asked.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "windows")).alias("asked"))
    joined = docs.join(lists.withColumnsRenamed({"doc_id": "d", "row_key": "k"}), (F.col("doc_id") == F.col("d")) & (F.col("row_key") == F.col("k")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, most=1_000_000):
            out: list[tuple] = []
            for doc, key, text, asks in zip(C.column(b, "doc_id"), C.column(b, "row_key"), C.texts(b), C.column(b, "asked"), strict=True):
                words = (text or b"").split()
                at = np.unique(np.concatenate([np.arange(a["first"], a["first"] + a["windows"]) for a in asks]))
                for low in range(0, len(words), PIECE):
                    mine = at[(at >= low) & (at < low + PIECE)] - low
                    if len(mine):
                        part = words[low : low + PIECE + window]
                        out.append((np.full(len(mine), doc), np.full(len(mine), key), (mine + low).astype(np.int32), *(Spans(part, base).of(mine, mine + window).view(np.int64) for base in (_BASE1, _BASE2))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc_id", "row_key", "at", "w1", "w2"])

    return joined.select("doc_id", "row_key", "text", "asked").mapInArrow(run, "doc_id long, row_key long, at int, w1 long, w2 long")


def matches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Matches (doc_id, row_key, start, windows, ref_doc, ref_at): windows from `start` on that the earlier ref_doc has from `ref_at` on.

    docs needs doc_id, text and row_key; ids must not be null here (see `keyed`).
    """
    blocks = C.cut(reference_blocks(docs.select("doc_id", "row_key", "text"), window, gram), "blocks")
    index = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("ref_doc"), F.min_by("first", "doc_id").alias("ref_at"), F.count("*").alias("copies"))
    index = C.cut(index, "index")
    several = index.groupBy("anchor").agg(F.count("*").alias("contents")).filter("contents > 1").select("anchor", F.lit(True).alias("open"))
    known = index.join(several, "anchor", "left").filter("copies > 1 or open").drop("copies")
    met = blocks.join(known, ["anchor", "content"]).filter("doc_id > ref_doc or open").select("doc_id", "row_key", "first", "windows", "ref_doc", "ref_at")
    met = C.cut(met, "met")
    whole = met.filter("doc_id > ref_doc").withColumnRenamed("first", "start")
    firsts = met.filter("doc_id = ref_doc")
    windows = C.cut(boundary_windows(docs.select("doc_id", "row_key", "text"), firsts, window), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("ref_doc"), F.min_by("at", "doc_id").alias("ref_at"), F.max("doc_id").alias("last")).filter("last > ref_doc").drop("last")
    partly = windows.join(least, ["w1", "w2"]).filter("doc_id > ref_doc").select("doc_id", "row_key", F.col("at").alias("start"), F.lit(1).alias("windows"), "ref_doc", "ref_at")
    return whole.unionByName(partly)


def parse(start: np.ndarray, windows: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, ref_doc, ref_start) of a document, in words, from its matches in any order; factors don't overlap.

    Matches that touch on one diagonal of one reference document are a run. From each window on, the run that
    reaches farthest is taken, ties to the smaller document and place.
    """
    start, shift = start.astype(np.int64), ref_at.astype(np.int64) - start
    order = np.lexsort((start, shift, ref_doc))
    low, high, doc, shift = start[order], (start + windows)[order], ref_doc[order], shift[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]) | (low[1:] > high[:-1])
    at = np.flatnonzero(fresh)
    runs = sorted(zip(low[at].tolist(), np.maximum.reduceat(high, at).tolist(), doc[at].tolist(), shift[at].tolist(), strict=True), key=lambda r: (r[0], r[2:])) if len(at) else []
    out: list[tuple[int, int, int, int]] = []
    next_run, p, done, best = 0, 0, 0, None
    while True:
        while next_run < len(runs) and runs[next_run][0] <= p:
            if best is None or runs[next_run][1] > best[1]:
                best = runs[next_run]
            next_run += 1
        if best is not None and best[1] > p:
            begin, done = max(p, done), best[1] + window - 1
            out.append((begin, done, best[2], begin + best[3]))
            p = best[1]
        elif next_run < len(runs):
            p = runs[next_run][0]
        else:
            return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", C.row_key().alias("row_key"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each document (doc_id, text) parsed, with the words of its factors removed.

    Returns doc_id, n_words, n_removed, factors (start, end, ref_doc, ref_start: words from `start` to `end` are those
    of the text of ref_doc from `ref_start` on), kept_sha256, kept (the words that stay, joined by one space; null text: empty).
    """
    rows = keyed(docs)
    found = matches(rows, window, gram).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_at")).alias("found"))
    joined = rows.join(found, ["doc_id", "row_key"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            lists = b.column(b.schema.get_field_index("found"))
            n = [x or 0 for x in pc.list_value_length(lists).to_pylist()]
            ends = np.cumsum(n)
            fields = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            out: list[tuple] = []
            for doc, text, count, end in zip(C.column(b, "doc_id"), C.texts(b), n, ends, strict=True):
                words = (text or b"").split()
                parsed = parse(*(x[end - count : end] for x in fields), window) if count else []
                kept, at = [], 0
                for f in parsed:
                    kept += words[at : f[0]]
                    at = f[1]
                kept += words[at:]
                left = b" ".join(kept)
                factors = [dict(zip(("start", "end", "ref_doc", "ref_start"), f, strict=True)) for f in parsed]
                out.append((None if doc == NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), factors, left.decode()))
            yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, x, strict=True)) for x in out], schema=RESULT)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,end:int,ref_doc:long,ref_start:int>>, kept string")


_FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(_FACTOR)), ("kept", pa.string())])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
