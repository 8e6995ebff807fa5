"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints that differ in at most `radius` bits link. Covering masks find them
all: give each bit a vector of radius+1 bits; for every nonzero vector v the mask
of v keeps the bits whose vector has an odd product with v. Differing bits number
at most radius, so some v is orthogonal to all of them, and in that table the pair
agrees. There are 2**(radius+1) - 1 tables.

Equal fingerprints are one node, so exact copies never meet in a bucket. A bucket
of up to `bucket` fingerprints is compared in one numpy call and gives a spanning forest, not
its pairs. A larger bucket is covered again over the bits its mask left free,
which keeps the guarantee and at least one more bit each time; where no more than
`radius` bits are free, all its members link, and one minimum joins them. No
bucket is ever capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, RADIUS, SEED, BUCKET = 3, 3, 42, 1024


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included, A-Z in lower case; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))


def majority(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes: the bits that over half of them have; none: 0."""
    split = h.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 15):
        bits += np.unpackbits(split[low : low + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z in lower case; no words: 0."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in C.texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key().alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def covering(free: int, radius: int) -> list[int]:
    """Masks within the bits of `free` such that any `radius` of them are all left out of some mask."""
    bits = [i for i in range(64) if free >> i & 1]
    size = radius + 1
    unit = [1 << i for i in range(size)]
    vectors = unit + [v for v in range(1, 1 << size) if v not in unit]
    of = {b: vectors[k % len(vectors)] for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (of[b] & v).bit_count() & 1) for v in range(1, 1 << size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a bucket's fingerprints."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    left, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        edge = np.array([root])
        while len(edge):
            reach = near[edge] & left
            found = np.flatnonzero(reach.any(axis=0))
            if len(found):
                out += zip(nodes[edge[reach[:, found].argmax(axis=0)]].tolist(), nodes[found].tolist(), strict=True)
                left[found] = False
            edge = found
    return out


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes of classes(fp, node): the same components as all links of at most `radius` bits."""
    spark = classes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for members in b.column(0).to_pylist():
                x = np.array([(m["fp"], m["node"]) for m in members], np.int64)
                out += forest(x[:, 0].copy().view(np.uint64), x[:, 1], radius)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    edges = None
    rows, masks = classes.select("fp", "node", F.lit(0).cast("long").alias("mask")), [0]
    while True:
        # children of every mask in use: a fixed table that doesn't depend on the data
        kids = {m: sorted({m | k for k in covering(~m & (1 << 64) - 1, radius)}) for m in masks}
        table = spark.createDataFrame([(_signed(m), [_signed(k) for k in ks]) for m, ks in kids.items()], "mask long, kids array<long>")
        keyed = rows.join(F.broadcast(table), "mask").select("fp", "node", F.explode("kids").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = C.cut(keyed.join(sizes, ["mask", "key"]), "met")
        small = met.filter(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "node")).alias("m")).select("m").mapInArrow(run, "a long, b long")
        edges = small if edges is None else edges.union(small)
        large = met.filter(F.col("n") > bucket)
        used = [r[0] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]
        if not used:
            return edges
        done = [_signed(m) for m in used if 64 - m.bit_count() <= radius]
        if done:
            alike = large.filter(F.col("mask").isin(done))
            least = alike.groupBy("mask", "key").agg(F.min("node").alias("a"))
            edges = edges.union(alike.join(least, ["mask", "key"]).select("a", F.col("node").alias("b")))
        masks = [m for m in used if 64 - m.bit_count() > radius]
        if not masks:
            return edges
        rows = large.filter(~F.col("mask").isin(done)).select("fp", "node", "mask") if done else large.select("fp", "node", "mask")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row_key, fp, component_id) of every row of docs(doc_id, text).

    component_id: the smallest doc_id reachable over links. Null or empty texts have
    fingerprint zero. Rows with a null id get the component of their fingerprint but are no node of their own.
    """
    prints = C.cut(fingerprints(docs, shingle), "prints")
    classes = C.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = C.components(links(classes.filter("node is not null"), radius, bucket))
    of = classes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "row_key", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(C.documents(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
