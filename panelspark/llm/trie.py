"""The prefix trie of conversations, by preorder intervals.

A turn's digest is 128 bits of its role and text. A prefix of d turns is named by d and the sums, modulo 2**64, of two hashes of (place,
digest) over its turns: sums of a conversation's turns in order, so a conversation is split over tasks however long it is. Equal prefixes
of all conversations are one node.

Nodes are put in preorder: a node's key are the digests of those turns on its way down at which the trie branches, then its depth. Keys compare as
the ways themselves would, since nodes with one key's digests lie on one chain. A node's place in that order and the place of
the last node below it bound its subtree: the end is the greatest place among the last nodes of its members. Leaves and saved tokens of a
subtree are then differences of running sums over the whole order (`prefix.running`), taken at the end and before the start.

Conversations are rebuilt first: the first h turns of the one that the id's group starts with (h from a hash of the id), then one's own turns after the first h.

Edge cases: turns are ordered by number, null first, then role, then the digest; null roles and texts are empty; equal rows are turns of their own;
rows with a null id belong to no conversation and are left out; a conversation whose rebuilt one has no turns is a member of the root; the root has no
text and saves nothing; no rows give no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import prefix

GROUP, SHARED = 20, 4
#: Ids in a piece of a node's list of members.
PIECE = 4096
_WRAP = "decimal(38,0)"


def turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, digest, words) of rows(conv_id, turn, role, text): each turn's place in its conversation, from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length first, so that no two turns run together alike
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(whole, 256), 1, 32)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    some = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().alias("_t0"), F.col("turn").alias("_t"), role.alias("_r"), digest.alias("digest"), words.alias("words"))
    placed = prefix.running(some, ["conv", "_t0", "_t", "_r", "digest"])
    first = placed.groupBy("conv").agg(F.min("place").alias("_first"))
    return placed.join(first, "conv").select("conv", (F.col("place") - F.col("_first") + 1).alias("pos"), "digest", "words")


def rebuilt(own: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """(conv, pos, digest, words): h turns of the group's first conversation, then one's own after the first h; h is the id's CRC-32 modulo `shared`."""
    convs = own.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string")) % shared).withColumn("base", F.col("conv") - F.col("conv") % group)
    starts = own.filter(F.col("pos") < shared)
    heads = convs.join(starts.withColumnRenamed("conv", "base"), "base").filter("pos <= h").select("conv", "pos", "digest", "words")
    taken = heads.groupBy("conv").agg(F.max("pos").alias("_n"))
    rest = own.join(convs.select("conv", "h").join(taken, "conv", "left"), "conv").filter("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.coalesce("_n", F.lit(0))).alias("pos"), "digest", "words")
    return heads.union(rest)


def _modulo(c: Column) -> Column:
    return F.pmod(c, F.lit("18446744073709551616").cast(_WRAP))


def paths(some: DataFrame) -> DataFrame:
    """(conv, pos, digest, words, node, parent): names of the prefix up to each turn and of the one before."""
    half = [F.xxhash64(F.lit(i), "pos", "digest") for i in range(2)]
    # sums of 32-bit halves stay far from the end of a long
    parts = {f"_{i}{side}": (F.shiftrightunsigned(h, 32) if side else h.bitwiseAND(F.lit(0xFFFFFFFF))) for i, h in enumerate(half) for side in (0, 1)}
    up = prefix.running(some.withColumns(parts), ["conv", "pos"], list(parts))
    start = up.filter("pos = 1").select("conv", *[(F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_from") for c in parts])
    up = up.join(start, "conv")

    def name(depth: Column, before: bool) -> Column:
        total = {c: (F.col(f"{c}_upto") - F.col(f"{c}_from") - (F.col(c) if before else F.lit(0))).cast(_WRAP) for c in parts}
        sums = [_modulo(total[f"_{i}1"] * F.lit(1 << 32).cast(_WRAP) + total[f"_{i}0"]) for i in range(2)]
        return F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])

    return up.select("conv", "pos", "digest", "words", name(F.col("pos"), False).alias("node"), name(F.col("pos") - 1, True).alias("parent"))


ROOT = "0:0:0"


def member_hashes(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) of last(node, conv): the hash of the ids, ascending, comma between.

    Ranges of (node, conv) are joined to pieces of text side by side; a node's pieces are then streamed through the hash in order, nothing gathered.
    """
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, convs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, at = [], 0
            for i in range(1, len(nodes) + 1):
                if i == len(nodes) or nodes[i] != nodes[at] or i - at == PIECE:
                    out.append((nodes[at], convs[at], ",".join(map(str, convs[at:i]))))
                    at = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            done = []
            for x, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if x == node:
                    h.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, h.hexdigest()))
                node, h = x, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([h.hexdigest()])], ["node", "ends_sha256"])

    made = last.select("node", "conv").repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node string, first long, ids string")
    return made.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def trie(rows: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """The nodes of the rebuilt conversations of rows(conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and preorder and end."""
    own = C.cut(turns(rows), "turns")
    convs = own.select("conv").distinct()
    some = C.cut(paths(C.cut(rebuilt(own, group, shared), "rebuilt")), "paths")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0").select(F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    below = some.groupBy("node").agg(F.min("pos").alias("depth"), F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = C.cut(root.unionByName(below), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # the way of a node is that of its smallest member, of which the turns below branching nodes count
    branching = children.filter("n_children > 1").select(F.col("node").alias("parent"))
    shown = nodes.select(F.col("conv_id").alias("conv")).distinct()
    steps = some.join(branching, "parent", "left_semi").join(shown, "conv", "left_semi").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("steps"))
    way = F.array_join(F.transform(F.filter("steps", lambda s: s["pos"] <= F.col("depth")), lambda s: s["digest"]), "")
    keyed = nodes.join(steps.withColumnRenamed("conv", "conv_id"), "conv_id", "left").withColumn("key", F.coalesce(way, F.lit(""))).drop("steps")
    keyed = keyed.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    placed = C.cut(prefix.running(keyed, ["key", "depth"], ["leaf", "saved"]).drop("key"), "preorder")

    at = placed.select("node", "place")
    deepest = some.groupBy("conv").agg(F.max_by("node", "pos").alias("node"))
    last = C.cut(convs.join(deepest, "conv", "left").withColumn("node", F.coalesce("node", F.lit(ROOT))).join(at, "node"), "last")
    ends = some.select("conv", "node").join(last.select("conv", "place"), "conv").groupBy("node").agg(F.max("place").alias("end"))
    total = placed.agg(F.max("place").alias("_all"))
    # the root's subtree is all; one row
    bounded = placed.join(ends, "node", "left").crossJoin(F.broadcast(total)).withColumn("end", F.coalesce("end", "_all")).drop("_all")
    stop = placed.select(F.col("place").alias("end"), F.col("leaf_upto").alias("_leaf"), F.col("saved_upto").alias("_saved"))
    whole = bounded.join(stop, "end").withColumn("n_leaves", F.col("_leaf") - F.col("leaf_upto") + F.col("leaf")).withColumn("saved_tokens", F.col("_saved") - F.col("saved_upto") + F.col("saved"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(above, "parent", "left").join(member_hashes(last), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("place").alias("preorder"), "end")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")).drop("preorder", "end")


#: CRC-32 of a decimal id, byte by byte with a table that is built from its polynomial; then the trie by joins of each conversation's turns.
OP12_SQL = f"""
WITH RECURSIVE steps AS (SELECT i, 0 AS n, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, n + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE n < 8),
 tab AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE n = 8),
 r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 d AS (SELECT c, turn, role, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM r),
 o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS pos FROM d),
 crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT c FROM o), tab),
 convs AS (SELECT c, crc % {SHARED} AS h, c - c % {GROUP} AS base FROM crc),
 heads AS (SELECT v.c, o.pos, o.digest, o.words FROM convs v JOIN o ON o.c = v.base AND o.pos <= v.h),
 b AS (SELECT * FROM heads UNION ALL SELECT o.c, o.pos - v.h + coalesce(n, 0), o.digest, o.words FROM o JOIN convs v ON o.c = v.c LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY c) t ON t.c = o.c WHERE o.pos > v.h),
 named AS (SELECT c, pos, words, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos)) AS node FROM b),
 p AS (SELECT c, pos, words, node, lag(node, 1, 'root') OVER (PARTITION BY c ORDER BY pos) AS parent FROM named UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
 nodes AS (SELECT node, any_value(parent) AS parent, min(c) AS conv_id, max(pos) AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY node),
 kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
 below AS (SELECT top, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT DISTINCT a.node AS top, b.node AS low FROM p a JOIN p b ON a.c = b.c AND a.pos <= b.pos) JOIN nodes ON node = low LEFT JOIN kids k ON k.parent = low GROUP BY top),
 ended AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, pos) AS node FROM p GROUP BY c) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below ON top = n.node LEFT JOIN nodes u ON u.node = n.parent LEFT JOIN kids k ON k.parent = n.node LEFT JOIN ended e ON e.node = n.node
"""
