"""Embedding near-dedup by NN-descent.

Vectors are compared within their label only. Equal vectors are one class; its
smallest id stands for it. For the others a neighbour graph is refined:
* it starts from random hyperplane trees: within a leaf all are compared, and each keeps its `k` nearest;
* neighbours-of-neighbours joins: the neighbours of a vector, and those whose
  neighbour it is, are compared with each other; what beats the k-th neighbour is kept. Only vectors
  with a new neighbour take part again. Rounds end when they find few new links;
* an audit compares a bounded sample of vectors with all of their label. While recall is
  below `recall`, further trees and rounds follow.
Neighbours at or over the threshold are links, and links give components. A vector all of whose k neighbours are links is
saturated: its list is enlarged to twice its length and its neighbours, and those whose neighbour it is, are compared with each other again, until it has room or
`LIST_MOST` places. Components of more vectors than that can't lie in lists of this length (they would be all pairs), so their lists don't grow: what is saturated
in the end is compared with all of its label, block by block, where one link for each two components is kept, and these join components that no list
connects. Counts of such components come from comparing them in blocks, so no group gives its pairs and no partner is capped. If the last audit is still
below `recall`, all vectors are compared so, which is exact.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of other lengths never link; rows with
one id are one vector each, but count as one node; null ids have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .topk import finite

THRESHOLD, K, TREES, LEAF, SEED = 0.93, 10, 8, 48, 7
RECALL, AUDIT, ROUNDS, TRIES = 0.97, 200, 4, 4
#: Places of the longest list.
LIST_MOST = 160
BITS = 24
_PAIRS = "node long, nbr long, sim double"


def _matrix(lists: list[list[float]]) -> np.ndarray:
    """Rows of norm 1, in double precision; shorter ones padded with zeros."""
    width = max(map(len, lists))
    if any(len(x) != width for x in lists):
        lists = [x + [0.0] * (width - len(x)) for x in lists]
    x = np.array(lists, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(group: pa.Scalar, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict]:
    """Ids and unit vectors of a collected list of structs, and its other fields."""
    v = group.values
    fields = {f.name: v.field(i) for i, f in enumerate(v.type)}
    vec = fields["vec"]
    n = np.diff(vec.offsets.to_numpy()[: len(v) + 1] if vec.offset == 0 else vec.offsets.to_numpy())
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == n[0]).all():
        x = x.reshape(len(n), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    else:
        x = _matrix(vec.to_pylist())
    return fields["node"].to_numpy(zero_copy_only=False), x, {k: fields[k].to_numpy(zero_copy_only=False) for k in names}


def _pairs(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(sim, pa.float64())], ["node", "nbr", "sim"])


def classes(vectors: DataFrame) -> DataFrame:
    """(label, vec, dims, node, size) of the distinct vectors that can link."""
    able = vectors.filter(finite() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    kept = able.select("label", F.col("embedding").alias("vec"), F.size("embedding").alias("dims"), F.col("vec_id").cast("long").alias("node"))
    return kept.groupBy("label", "dims", "vec").agg(F.min("node").alias("node"), F.count("*").alias("size"))


def nearest(pairs: DataFrame, k: int, caps: DataFrame | None = None) -> DataFrame:
    """The k nearest of each node, or as many as caps(node, cap) says; pairs(node, nbr, sim, born)."""
    best = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    once = pairs.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    ranked = once.withColumn("r", F.row_number().over(best))
    if caps is None:
        return ranked.filter(F.col("r") <= k).drop("r")
    return ranked.join(caps, "node", "left").filter(F.col("r") <= F.coalesce("cap", F.lit(k))).drop("r", "cap")


def leaves(points: DataFrame, trees: int, k: int, seed: int) -> DataFrame:
    """(node, nbr, sim): the k nearest within each leaf of `trees` random hyperplane trees."""
    sizes = points.groupBy("label", "dims").agg(F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.count("*") / F.lit(LEAF))).cast("int"))).alias("depth"))
    able = points.join(sizes, ["label", "dims"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            rows = C.column(b, "vec")
            x = _matrix(rows) if rows else np.zeros((0, 1))
            if x.shape[1] not in planes:
                planes[x.shape[1]] = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], trees * BITS))
            side = (x @ planes[x.shape[1]] > 0).reshape(len(x), trees, BITS)
            codes = (side * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*b.schema.names, "codes"])

    coded = able.select("label", "dims", "depth", "node", "vec").mapInArrow(code, f"{', '.join(f'`{n}` {t}' for n, t in able.select('label', 'dims', 'depth', 'node', 'vec').dtypes)}, codes array<long>")
    laid = coded.select("label", "dims", "node", "vec", "depth", F.posexplode("codes").alias("tree", "code"))
    # a leaf is the first `depth` sides; groups that stay together are dealt out further
    laid = laid.withColumn("leaf", F.expr(f"shiftright(code, {BITS} - depth)")).drop("code", "depth")
    counts = laid.groupBy("label", "dims", "tree", "leaf").agg(F.count("*").alias("n"))
    dealt = laid.join(counts, ["label", "dims", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.ceil(F.col("n") / F.lit(4.0 * LEAF)).cast("long")))
    groups = dealt.groupBy("label", "dims", "tree", "leaf", "part").agg(F.collect_list(F.struct("node", "vec")).alias("m")).select("m")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group in b.column(0):
                if len(group) < 2:
                    continue
                node, x, _ = _vectors(group, ())
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                top = np.argpartition(-sim, min(k, len(node) - 1) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(node)), top.shape[1]), top.reshape(-1)
                keep = i != j
                out.append((node[i[keep]], node[j[keep]], sim[i[keep], j[keep]]))
            if out:
                yield _pairs(*map(np.concatenate, zip(*out, strict=True)))

    return groups.mapInArrow(compare, _PAIRS)


def refined(graph: DataFrame, points: DataFrame, k: int, born: int) -> DataFrame:
    """(node, nbr, sim) found by comparing the neighbours of each vector that has an edge born in the last round."""
    back = Window.partitionBy("nbr").orderBy(F.desc("sim"), "node")
    turned = graph.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k).select(F.col("nbr").alias("center"), F.col("node").alias("node"), "born")
    members = graph.select(F.col("node").alias("center"), F.col("nbr").alias("node"), "born").union(turned)
    active = members.groupBy("center").agg(F.max("born").alias("last")).filter(F.col("last") == born).select("center")
    members = members.groupBy("center", "node").agg(F.max("born").alias("born")).join(active, "center", "left_semi")
    bars = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("bar"))
    known = points.select("node", "vec").join(bars, "node", "left")
    groups = members.join(known, "node").groupBy("center").agg(F.collect_list(F.struct("node", "vec", "born", F.coalesce("bar", F.lit(-2.0)).alias("bar"))).alias("m")).select("m")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group in b.column(0):
                if len(group) < 2:
                    continue
                node, x, more = _vectors(group, ("born", "bar"))
                sim = x @ x.T
                fresh = more["born"] == born
                ok = (sim > more["bar"][:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                if len(i):
                    out.append((node[i], node[j], sim[i, j]))
            if out:
                yield _pairs(*map(np.concatenate, zip(*out, strict=True)))

    return groups.mapInArrow(compare, _PAIRS)


def enlarged(graph: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(node, nbr, sim) of links of the nodes in asked(node), found by comparing their neighbours with each other. graph(node, nbr), lists of k at most."""
    back = Window.partitionBy("nbr").orderBy(F.desc("sim"), "node")
    turned = graph.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k).select(F.col("nbr").alias("center"), "node")
    own = asked.select(F.col("node").alias("center"), "node")
    members = graph.select(F.col("node").alias("center"), F.col("nbr").alias("node")).union(turned).join(asked.withColumnRenamed("node", "center"), "center", "left_semi").union(own).distinct()
    known = points.select("node", "vec").join(asked.withColumn("asks", F.lit(True)), "node", "left")
    groups = members.join(known, "node").groupBy("center").agg(F.collect_list(F.struct("node", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))).alias("m")).select("m")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group in b.column(0):
                node, x, more = _vectors(group, ("asks",))
                mine = np.flatnonzero(more["asks"])
                sim = x[mine] @ x.T
                sim[np.arange(len(mine)), mine] = -2
                i, j = np.nonzero(sim >= THRESHOLD)
                out.append((node[mine[i]], node[j], sim[i, j]))
            if out:
                yield _pairs(*map(np.concatenate, zip(*out, strict=True)))

    return groups.mapInArrow(compare, _PAIRS)


def grown(graph: DataFrame, points: DataFrame, k: int, born: int) -> tuple[DataFrame, DataFrame]:
    """The graph with longer lists for saturated nodes, and (node, cap) of these. Only nodes of components of at most LIST_MOST nodes ask: all their links fit in a list."""
    links = graph.filter(F.col("sim") >= THRESHOLD)
    roots = C.components(links.select(F.col("node").alias("a"), F.col("nbr").alias("b")))
    small = C.cut(roots.join(roots.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") <= LIST_MOST), "root").select("node"), "small")
    caps = points.sparkSession.createDataFrame([], "node long, cap int")
    size = k
    while size < LIST_MOST:
        full = graph.filter(F.col("sim") >= THRESHOLD).groupBy("node").agg(F.count("*").alias("n")).join(caps, "node", "left").filter(F.col("n") >= F.coalesce("cap", F.lit(k))).select("node")
        asked = C.cut(full.join(small, "node", "left_semi"), "saturated")
        if asked.isEmpty():
            break
        size = min(2 * size, LIST_MOST)
        caps = C.cut(caps.join(asked, "node", "left_anti").union(asked.select("node", F.lit(size))), "caps")
        more = enlarged(graph, points, asked, size).withColumn("born", F.lit(born))
        graph = C.cut(nearest(graph.union(more), k, caps), "graph")
    return graph, caps


def block_counts(points: DataFrame, block: int = 512) -> DataFrame:
    """(node, linked): how many vectors, copies counted, each links with in its own group. points(grp, node, vec, size)."""
    sizes = points.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks"))
    dealt = points.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    groups = dealt.withColumn("pair", pair).groupBy("grp", "pair").agg(F.collect_list(F.struct("node", "vec", "size", "mine")).alias("m")).select("m", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, i, j in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                node, x, more = _vectors(group, ("size", "mine"))
                a, c = np.flatnonzero(more["mine"] == i), np.flatnonzero(more["mine"] == j)
                linked = x[a] @ x[c].T >= THRESHOLD
                if i == j:
                    np.fill_diagonal(linked, False)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(linked @ more["size"][c])], ["node", "n"])
                elif len(a) and len(c):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a], node[c]])), pa.array(np.concatenate([linked @ more["size"][c], more["size"][a] @ linked]))], ["node", "n"])

    return groups.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("linked"))


def bridges(points: DataFrame, asked: DataFrame, block: int = 512) -> DataFrame:
    """(a, b): roots of components with a link between them, for links of the nodes in asked(node) with any of their label. points(label, dims, node, vec, root)."""
    whole = ["label", "dims"]
    some = points.join(asked, "node", "left_semi").select(*whole, "node", "vec", "root")
    counts = [x.groupBy(*whole).agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias(c)) for x, c in ((some, "m"), (points, "n"))]
    sizes = counts[0].join(counts[1], whole)

    def dealt(rows: DataFrame, mine: str, other: str, blocks: str, others: str, side: int) -> DataFrame:
        at = rows.join(sizes, whole).withColumn(mine, F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return at.select(*whole, "i", "j", "node", "vec", "root", F.lit(side).alias("side"))

    both = dealt(some, "i", "j", "m", "n", 0).union(dealt(points.select(*whole, "node", "vec", "root"), "j", "i", "n", "m", 1))
    groups = both.groupBy(*whole, "i", "j").agg(F.collect_list(F.struct("node", "vec", "root", "side")).alias("g")).select("g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in b.column(0):
                _, x, more = _vectors(group, ("root", "side"))
                root, side = more["root"], more["side"]
                a, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = np.nonzero((x[a] @ x[c].T >= THRESHOLD) & (root[a][:, None] != root[c][None]))
                if len(i):
                    met = np.unique(np.sort(np.stack([root[a[i]], root[c[j]]], axis=1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(met[:, 0].copy()), pa.array(met[:, 1].copy())], ["a", "b"])

    return groups.mapInArrow(compare, "a long, b long").distinct()


def audit(points: DataFrame, counts: DataFrame, most: int = AUDIT) -> float:
    """Recall of the links of at most `most` classes (the lowest hashes) against brute force over all others; 1 if they have none."""
    asked = points.join(counts, "node").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(most).select("label", "dims", "node", "vec", "linked").collect()
    if not asked:
        return 1.0
    groups: dict[tuple, tuple] = {}
    for r in asked:
        groups.setdefault((r.label, r.dims), ([], []))
        groups[r.label, r.dims][0].append(r.node)
        groups[r.label, r.dims][1].append(list(r.vec))
    # bounded by `most`
    sent = points.sparkSession.sparkContext.broadcast({g: (np.array(n), _matrix(v)) for g, (n, v) in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dims, node, size, vec = (C.column(b, n) for n in ("label", "dims", "node", "size", "vec"))
            for g, (ids, q) in sent.value.items():
                some = [i for i, at in enumerate(zip(label, dims, strict=True)) if at == g]
                if some:
                    sim = q @ _matrix([vec[i] for i in some]).T >= THRESHOLD
                    sim &= ids[:, None] != np.array([node[i] for i in some])[None]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sim @ np.array([size[i] for i in some]))], ["node", "n"])

    true = {r.node: r.n for r in points.select("label", "dims", "node", "size", "vec").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    total = sum(true.values())
    return 1.0 if not total else sum(min(r.linked, true[r.node]) for r in asked) / total


def groups(vectors: DataFrame, k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label)."""
    points = C.cut(classes(vectors), "points")
    found = None
    for attempt in range(TRIES + 1):
        exact = attempt == TRIES
        if not exact:
            born = attempt * (ROUNDS + 1)
            fresh = leaves(points, trees, k, SEED + attempt).withColumn("born", F.lit(born))
            graph = C.cut(nearest(fresh if found is None else found.union(fresh), k), "graph")
            links = graph.filter(F.col("sim") >= THRESHOLD).count()
            for step in range(1, ROUNDS + 1):
                more = refined(graph, points, k, born + step - 1).withColumn("born", F.lit(born + step))
                graph = C.cut(nearest(graph.union(more), k), "graph")
                before, links = links, graph.filter(F.col("sim") >= THRESHOLD).count()
                if links - before <= 0.001 * links:
                    break
            found = graph
            graph, caps = grown(graph, points, k, born + ROUNDS)
        linked = graph.filter(F.col("sim") >= THRESHOLD)
        edges = linked.select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        roots = C.components(edges)
        full = points.select("node") if exact else linked.groupBy("node").agg(F.count("*").alias("n")).join(caps, "node", "left").filter(F.col("n") >= F.coalesce("cap", F.lit(k))).select("node")
        rooted = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        across = C.cut(bridges(rooted, full), "bridges")
        if not across.isEmpty():
            roots = C.components(edges.union(across))
        wide = roots.join(full, "node", "left_semi").select("root").distinct()
        in_blocks = block_counts(points.join(roots.join(wide, "root", "left_semi"), "node").select(F.col("root").alias("grp"), "node", "vec", "size"))
        both = linked.select("node", "nbr").union(linked.select("nbr", "node")).distinct()
        listed = both.join(points.select(F.col("node").alias("nbr"), "size"), "nbr").groupBy("node").agg(F.sum("size").alias("listed"))
        counts = points.select("node").join(listed, "node", "left").join(in_blocks, "node", "left").select("node", F.coalesce("linked", "listed", F.lit(0).cast("long")).alias("linked"))
        counts = C.cut(counts, "counts")
        if exact or audit(points, counts) >= recall:
            break
    of = points.join(counts, "node").join(roots, "node", "left").select("label", "dims", "vec", (F.col("linked") + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    every = vectors.select("vec_id", "label", F.col("embedding").alias("vec"), F.size("embedding").alias("dims"))
    joined = every.filter(F.col("vec_id").isNotNull()).join(of, ["label", "dims", "vec"], "left").unionByName(every.filter(F.col("vec_id").isNull()), allowMissingColumns=True)
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
