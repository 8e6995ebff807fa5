"""Exact top-k search by MaxScore over sharded postings.

The terms of a vector are its dimensions, their weights integers. A shard holds the
postings of a few thousand candidates, one row of weights for each dimension, and
each dimension's least and greatest weight, which bound what it can add to a score.
For a query the dimensions are ordered by the width of that bound. Candidates come in
blocks; once k of them are scored, the k-th score splits the dimensions: those whose
bounds together can't lift a candidate over it are non-essential. The essential
postings are traversed for the whole block, then the others one group
after another, each time only for candidates that can still reach the k-th score. Each shard
gives its k best, and merging takes the k best of these.

Candidates and queries meet in (shard, query block) groups of bounded size; more
rows make more groups, not larger ones.

Edge cases: vectors that are null or hold null or non-finite components are no
candidates and no queries; shorter vectors count as padded with zeros; a query
never finds rows of its own id; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS, BLOCK, STEP = 8192, 512, 512, 8
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def finite(c: str = "embedding"):
    """Whether a vector and all its components are there and finite."""
    return F.coalesce(F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), F.lit(False))


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, w): floor(scale * x) of each component, for vectors that are finite."""
    some = vectors.filter(finite() & F.col("vec_id").isNotNull())
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("w"))


class Shard:
    """Postings of some candidates, in blocks by ascending id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, exact: bool):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # doubles hold all sums exactly if `exact`; else Python's integers
        self.postings = np.ascontiguousarray(weights[order].T.astype(np.float64 if exact else object))
        self.least, self.most = self.postings.min(axis=1), self.postings.max(axis=1)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids."""
        high = np.maximum(q * self.least, q * self.most)
        order = np.argsort(-(high - np.minimum(q * self.least, q * self.most)), kind="stable")
        # rest[j]: the most that dimensions from the j-th on can add
        rest = np.append(np.cumsum(high[order][::-1])[::-1], 0)
        low = np.append(np.cumsum(np.minimum(q * self.least, q * self.most)[order]), 0)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.postings.dtype)
        for at in range(0, len(self.ids), BLOCK):
            here = self.ids[at : at + BLOCK]
            need = scores[-1] if len(scores) == k else None
            essential = len(order)
            if need is not None:
                # candidates that add least in the first j dimensions and most in the others stay below the k-th score
                below = np.flatnonzero(np.append(0, low[:-1]) + rest < need)
                essential = int(below[0]) if len(below) else len(order)
                essential = min(max(essential, STEP), len(order))
            dims = order[:essential]
            got = q[dims] @ self.postings[dims, at : at + BLOCK]
            alive = np.flatnonzero(here != query_id)
            while need is not None and len(alive):
                alive = alive[got[alive] + rest[essential] >= need]
                if essential == len(order):
                    break
                dims = order[essential : essential + STEP]
                got[alive] += q[dims] @ self.postings[dims][:, at + alive]
                essential += len(dims)
            if len(alive):
                ids, scores = np.concatenate([ids, here[alive]]), np.concatenate([scores, got[alive]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        return ids, scores


def search(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by inner product. Both take vec_id and w, integer weights."""
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    held = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        rows = [t.column("w").to_pylist() for t in (left, right)]
        width = max(1, max(len(w) for t in rows for w in t))
        padded = [np.array([w + [0] * (width - len(w)) for w in t], dtype=np.int64) for t in rows]
        exact = width * float(np.abs(padded[0].astype(float)).max()) * float(np.abs(padded[1].astype(float)).max()) < 2**53
        shard = Shard(left.column("vec_id").to_numpy(), padded[0], exact)
        out = []
        for query_id, q in zip(right.column("vec_id").to_pylist(), padded[1].astype(np.float64 if exact else object), strict=True):
            ids, scores = shard.search(query_id, q, k)
            out.append((np.full(len(ids), query_id), ids, scores.astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], schema=RESULT)

    found = held.select("shard", "block", "vec_id", "w").groupBy("shard", "block").cogroup(asked.select("shard", "block", "vec_id", "w").groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.filter("vec_id % 50 = 0"), 5)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
