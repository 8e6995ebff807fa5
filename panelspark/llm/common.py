"""What several training-data operators share.

Null handling is the same everywhere: operators select the columns they need by
name, so extra columns with clashing names pass by untouched; a null text counts
as an empty one unless the operator says otherwise; a null id is kept in the
result but never matches another row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT_BATCH_BYTES = 4_000_000
#: Bytes of the Arrow batches that Spark sends to Python, which are bounded by rows alone otherwise (10,000).
ARROW_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold about ARROW_BYTES (one row at least): a JVM holds those of all its tasks outside its heap, in buffers that double, and each Python worker its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.panelspark.shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.panelspark.shared", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: a finished stage survives lost executors and is not computed twice.

    The files of an application are in a folder of its own, to be deleted once its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = ROOT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut further so that each holds about `most` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        sizes = np.frombuffer(col.cast(pa.large_binary()).buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1)
            end = min(end, b.num_rows)
            yield b.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def row_key(text: str = "text") -> F.Column:
    """Tells rows that repeat a doc_id with other text apart; identical rows share it, and so share their result."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph.

    edges(a, b) long -> (node, root): every node of an edge with the smallest node
    it reaches. Each round takes the least label among a node's neighbours, then
    jumps twice to the label's own label, so chains shrink geometrically. Labels are written to the
    shared folder after each round. Null ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
    labels = cut(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        parent = labels.select(F.col("node").alias("p"), F.col("root").alias("pr"))
        jumped = hooked.join(parent, hooked.root == parent.p, "left").select("node", "old", F.least("root", F.coalesce("pr", "root")).alias("root"))
        jumped = cut(jumped, "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
