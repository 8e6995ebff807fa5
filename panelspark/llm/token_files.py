"""Token ids of documents in compressed files, and back.

A file set is a Spark table of segments, written by Spark's own committer so that
lost executors and repeated tasks leave no half files: shard (a range of doc ids), seq (order in the
shard), the documents with their numbers of ids, and the coded ids (see idcoder: blocks that are
reset and checksummed on their own). Documents lie whole in a segment, ascending by id.

Edge cases: a null or empty text is its end id alone; null ids come first; rows
with one id stay separate, in the order of their texts' hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import idcoder, packing, tokens

END_ID = 1
#: Ids in a segment (a longer document has a segment of its own): bounds the memory of a task.
SEGMENT = 1 << 22
SCHEMA = "shard int, seq int, doc_ids array<long>, lengths array<int>, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def write(docs: DataFrame, to: str, path: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode every document (doc_id, text) and write the file set to `to`."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens.Held(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = sent.value.get(), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            coded = idcoder.encode(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([shard], [seq], [doc_ids], [[len(p) for p in parts]], [coded]), _ARROW, strict=True)], schema=_ARROW)

        for b in C.slices(batches, most=2_000_000):
            for doc, ids in zip(C.column(b, "doc_id"), encoder.encode(C.texts(b)), strict=True):
                if parts and held + len(ids) + 1 > segment:
                    yield full()
                    doc_ids, parts, held, seq = [], [], 0, seq + 1
                doc_ids.append(doc)
                parts.append(np.append(ids, np.int32(end_id)))
                held += len(parts[-1])
        if parts:
            yield full()

    packing.in_order(docs).mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of a file set, start counted over all documents before it."""
    files = spark.read.schema(SCHEMA).parquet(at)
    sizes = files.select("shard", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # two levels: segments within a shard, shards among themselves
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    segments = sizes.select("shard", "seq", (F.sum("n").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n")).alias("within"))
    starts = segments.join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, doc_ids, lengths = (b.column(i) for i in range(3))
            for k, ids in idcoder.decode(b.column(3).to_pylist()):
                docs, n = doc_ids[k].values, lengths[k].values.to_numpy()
                ends = np.cumsum(n)
                raw = ids.astype("<u4")
                for low in range(0, len(n), 2000):
                    some = slice(low, low + 2000)
                    first, last = int(ends[low] - n[low]), int(ends[some][-1])
                    cuts = np.append(0, ends[some] - first)
                    flat = raw[first:last]
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs.slice(low, 2000),
                            pa.array(base[k].as_py() + ends[some] - n[some]),
                            pa.array(n[some].astype(np.int64)),
                            pa.array([zlib.crc32(flat[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32))),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    joined = files.join(starts, ["shard", "seq"]).select("base", "doc_ids", "lengths", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    at = f"{C.shared_dir(spark)}/panelspark/ids-{uuid.uuid4().hex}"
    write(C.documents(spark, sf_dir), at, tokens.public_path())
    return read(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32")
