"""Importance resampling of documents towards a target text, by bucket-partitioned inverted postings.

Features are the runs of 1 to `longest` words; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. A bucket that the
target has more often than the documents do gains, in thousandths of a nat, and a document weighs what its features' buckets gain.

Postings are (bucket, document, count), packed: a task cuts its documents into blocks and
writes, for each bucket and block, the places of the documents in the block and their counts. Both corpora are summed up by bucket, which
gives each bucket's gain; the postings are shuffled by bucket and meet it there, emit contributions, summed up in the task, and a
last shuffle by block adds them up by document. A frequent bucket, which every block has, is dealt over `SALT` keys, and its rows are
streamed, never gathered. A block holds about BLOCK_BYTES of text, so what is gathered for one is bounded.

The draw adds Gumbel noise from a hash of the id to the weight and takes the highest scores: a sample without
replacement in proportion to the exponential of the weights. Ranks are places in one order over range partitions.

Edge cases: a null or empty text has no features and weight 0; rows that repeat an id with other text are documents of their own
(ties go to the smaller id, then the smaller hash of the text); equal rows are each returned, and ranked; a null id is hashed as an empty one and
comes last on ties; without target text all of its counts are 0; no documents give no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import prefix

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10000, 1, 20, 10, 2024
#: Text of a block of documents, and documents in it at most; a place in a block takes two bytes.
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 1 << 16
#: Keys over which the postings of each bucket are dealt.
SALT = 64
#: Features whose buckets a worker remembers, and postings that a task sums up before it emits contributions.
KEPT_FEATURES, HELD_POSTINGS = 500_000, 4_000_000
_SPACE = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_WORDS = bytes(32 if c in _SPACE else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Of a posting list of no bucket: the documents of a block.
DOCUMENTS = -1
_LISTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("total", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary())])


class Buckets(dict):
    """Bucket by feature, worked out at first sight."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def features(text: bytes | None, longest: int) -> tuple[list[bytes], int]:
    """All runs of 1 to longest words, and the number of words."""
    words = (text or b"").translate(_WORDS).split()
    out = words
    for n in range(2, longest + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out, len(words)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary strings: the stretches of values between cuts."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def postings(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Posting lists of docs(doc_id, row_key, text), a row for each bucket and block, and a row of the bucket DOCUMENTS for each block; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block = Buckets(buckets), TaskContext.get().partitionId() << 24
        for b in C.slices(batches, most=BLOCK_BYTES):
            for low in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(low, BLOCK_DOCS)
                k, found = part.num_rows, [features(t, longest) for t in C.texts(part)]
                sizes = np.array([len(f) for f, _ in found], np.int64)
                code = np.fromiter(map(of.__getitem__, chain.from_iterable(f for f, _ in found)), np.int64, int(sizes.sum())) * k + np.repeat(np.arange(k), sizes)
                code, n = np.unique(code, return_counts=True)
                bucket, at = code // k, (code % k).astype(np.uint16)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(code) else np.zeros(0, np.int64), len(code))
                own = len(cuts) - 1
                nothing = pa.nulls(own, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(np.full(own, block)), pa.array(np.add.reduceat(n, cuts[:-1]) if own else np.zeros(0, np.int64), pa.int64()), _packed(at, cuts), _packed(n.astype(np.uint32), cuts), nothing, nothing], schema=_LISTS
                )
                ids = part.column(0)
                words = np.array([w for _, w in found], np.int64)
                held = [ids.is_null().to_numpy(zero_copy_only=False).tobytes(), words.tobytes(), ids.fill_null(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS], pa.int32()), pa.array([block]), pa.array([int(sizes.sum())]), *[pa.array([x], pa.binary()) for x in held]], schema=_LISTS)
                block += 1
            if len(of) > KEPT_FEATURES:
                of.clear()

    return C.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", "text").mapInArrow(run, "bucket int, block long, total long, at binary, n binary, ids binary, keys binary"), "postings")


def gains(lists: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that one of the corpora has: at most `buckets` rows."""
    sides = [df.filter(F.col("bucket") >= 0).groupBy("bucket").agg(F.sum("total").alias(c)) for df, c in ((lists, "s"), (target, "t"))]
    both = sides[0].join(sides[1], "bucket", "full").na.fill(0, ["s", "t"])
    all_ = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    # one row of totals
    return both.crossJoin(F.broadcast(all_)).select("bucket", F.floor(1000 * F.ln((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long").alias("gain"))


def contributions(lists: DataFrame, gain: DataFrame) -> DataFrame:
    """(block, at, value): what documents get from the buckets of one task, several rows for a block."""
    salted = lists.filter(F.col("bucket") >= 0).select("bucket", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int").alias("salt"), "block", "at", "n")
    every = gain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = salted.join(every.hint("shuffle_hash"), ["bucket", "salt"]).select("block", "at", "n", "gain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> pa.RecordBatch:
            code, value = (np.concatenate(x) for x in zip(*held, strict=True))
            turn = np.argsort(code, kind="stable")
            code, value = code[turn], value[turn]
            start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code, value = code[start], np.add.reduceat(value, start)
            block = code >> np.uint64(16)
            cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]].astype(np.int64)), _packed((code & np.uint64(65535)).astype(np.uint16), cuts), _packed(value, cuts)], ["block", "at", "value"])

        for b in batches:
            block, gain = b.column(0).to_numpy(), b.column(3).to_numpy()
            at, n = (b.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
            many = np.array([len(x) >> 1 for x in at], np.int64)
            place = np.frombuffer(b"".join(at), np.uint16).astype(np.uint64)
            count = np.frombuffer(b"".join(n), np.uint32).astype(np.int64)
            # a block's number has 24 bits of its own below those of its task
            held.append(((np.repeat(block.astype(np.uint64), many) << np.uint64(16)) | place, count * np.repeat(gain, many)))
            size += len(place)
            if size > HELD_POSTINGS:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    return met.mapInArrow(run, "block long, at binary, value binary")


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, row_key, n_words, n_features, weight) of docs(doc_id, text) against target(text)."""
    lists = postings(docs.withColumn("row_key", C.row_key()), longest, buckets)
    wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), "text"), longest, buckets)
    found = contributions(lists, gains(lists, wanted, buckets))

    def add(docs_of: pa.Table, parts: pa.Table) -> pa.Table:
        row = docs_of.to_pylist()[0]
        words = np.frombuffer(row["n"], np.int64)
        total = np.zeros(len(words), np.int64)
        for at, value in zip(parts["at"].to_pylist(), parts["value"].to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(value, np.int64)
        # runs of up to `longest` of w words
        runs = sum(np.maximum(words - i, 0) for i in range(longest))
        none = np.frombuffer(row["at"], bool)
        return pa.table([pa.array(np.frombuffer(row["ids"], np.int64), mask=none), pa.array(np.frombuffer(row["keys"], np.int64)), pa.array(words), pa.array(runs), pa.array(total)], ["doc_id", "row_key", "n_words", "n_features", "weight"])

    blocks = lists.filter(F.col("bucket") == DOCUMENTS).select("block", "at", "n", "ids", "keys")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(add, "doc_id long, row_key long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Thousandths of a Gumbel variable from a hash of doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, n_words, n_features, weight, score, rank): ranks of the `percent` of the documents with `least_words` words or more that are drawn."""
    scored = C.cut(weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise(seed)), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    order = able.withColumns({"_s": -F.col("score"), "_n": F.col("doc_id").isNull()})
    placed = prefix.running(order, ["_s", "_n", "doc_id", "row_key"]).withColumn("rank", F.when(F.col("place") <= draw, F.col("place")))
    return placed.select(*scored.columns, "rank").union(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(C.documents(spark, sf_dir).select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")
