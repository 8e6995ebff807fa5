"""Near-dedup of whole documents at a Jaccard similarity of their word shingles.

Rows with equal sets of shingles are one class. The first candidates come from SimHash, by the covering masks of
`simhash.links`: classes whose fingerprints over the same shingles are equal or differ in at most `simhash.RADIUS` bits. A pair at a similarity of 0.8
differs by more bits than that, as a rule, so what SimHash leaves apart meets by MinHash: `BANDS` bands of
`WIDTH` minima, so that a pair at similarity s shares a band but for a chance of (1 - s**WIDTH)**BANDS, 3.3e-6
at 0.8 and less above. Every link, of either, is checked with the exact Jaccard similarity (of 64-bit shingle hashes), in integers.

Links give components, so not all pairs are needed: in the first rounds of MinHash each class of a bucket is compared with one
pivot of it, first the smallest, then a random one. Most classes of a dense group are in one component then. The others of a
bucket, those outside its commonest component, meet all classes of the bucket, block against block, each pair of classes in the first bucket they
share. There the similarity is exact again, and what comes out is a spanning forest of the links. So no bucket is capped, none is one task, and rows grow with
the classes of a bucket, not with its pairs, but for those of blocks when many classes stay apart.

Of each component one row stays: that of the smallest id (null ids last), then of the smallest hash of the
row; of rows equal in all columns one. Texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash

SHINGLE, SIMILARITY, SEED = 5, Fraction(4, 5), simhash.SEED
BANDS, WIDTH, PIVOTS = 24, 4, 2
#: Bytes of shingles in a block, of which a class counts as LEAST_BYTES at least; shingles compared at once.
BLOCK_BYTES, LEAST_BYTES, COLUMNS = 1 << 22, 1 << 14, 4096
_RND = np.random.default_rng(SEED)
_XOR, _ODD = (_RND.integers(0, 1 << 64, (BANDS * WIDTH, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case; a shorter text is one shingle."""
    return np.unique(simhash.hashes(text, shingle))


def bands(items: np.ndarray) -> list[int]:
    """One signed key for each band; none for no items."""
    if not len(items):
        return []
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(items), 2048):
        least = np.minimum(least, ((items[None, low : low + 2048] ^ _XOR) * _ODD).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - (1 << 63) for i, part in enumerate(least.reshape(BANDS, WIDTH))]


def _node(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes(), SEED) - (1 << 63)


def prints(keyed: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row_key, node, n, bands, fp) of every row: its class, how many shingles it has, its keys and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            found = [simhash.hashes(t, shingle) for t in C.texts(b)]
            sets = [np.unique(h) for h in found]
            fp = np.array([simhash.majority(h) for h in found], np.uint64).view(np.int64)
            made = [pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64())), pa.array(fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "row_key", "node", "n", "bands", "fp"])

    return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", "text").mapInArrow(run, "doc_id long, row_key long, node long, n long, bands array<long>, fp long")


def sets_of(keyed: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of the classes in firsts(node, d, k), read from the texts of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            sets = [shingles(t, shingle).view(np.int64) for t in C.texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    met = keyed.join(firsts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")))
    return met.select("node", "text").mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def _apart(similarity: Fraction) -> Column:
    """What two classes must be to be a candidate: in different components, and of sizes that allow the similarity."""
    p, q = similarity.numerator, similarity.denominator
    return (F.col("ra") != F.col("rb")) & (F.least("na", "nb") * q >= F.greatest("na", "nb") * p)


def linked(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""
    p, q = similarity.numerator, similarity.denominator
    one, two = (sets.select(F.col("node").alias(x), F.col("items").alias(f"i{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("inter", F.size(F.array_intersect("ia", "ib")))
    return both.filter(F.col("inter") * q >= (F.size("ia") + F.size("ib") - F.col("inter")) * p).select("a", "b")


def simhash_pairs(rows: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(a, b) with a < b: classes of rows(node, n, fp) with equal fingerprints, each with the smallest of them, and a spanning forest of the fingerprints that differ in at most `radius` bits."""
    of = rows.filter("n > 0").select("fp", "node").distinct()
    # a row for each fingerprint, whatever the number of its classes
    heads = C.cut(of.groupBy("fp").agg(F.min("node").alias("node")), "heads")
    same = of.join(heads.select("fp", F.col("node").alias("b")), "fp").select(F.col("node").alias("a"), "b")
    met = same.union(simhash.links(heads, radius)).filter("a <> b")
    return C.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash")


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many items each set of one shares with each of two."""
    out = np.zeros((len(one), len(two)), np.int64)
    flat = [np.concatenate(x) for x in (one, two)]
    owner = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (one, two)]
    common = np.intersect1d(*flat)
    at = [np.searchsorted(common, x) for x in flat]
    met = [np.append(common, 0)[p] == x if len(common) else np.zeros(len(x), bool) for p, x in zip(at, flat, strict=True)]
    turn = [np.argsort(np.where(m, p, len(common)), kind="stable") for p, m in zip(at, met, strict=True)]
    cols, rows = [np.where(m, p, len(common))[t] for p, m, t in zip(at, met, turn, strict=True)], [o[t] for o, t in zip(owner, turn, strict=True)]
    for low in range(0, len(common), COLUMNS):
        high = min(len(common), low + COLUMNS)
        held = []
        for c, r, n in zip(cols, rows, (len(one), len(two)), strict=True):
            first, last = np.searchsorted(c, [low, high])
            m = np.zeros((n, high - low), np.float32)
            m[r[first:last], c[first:last] - low] = 1
            held.append(m)
        out += np.rint(held[0] @ held[1].T).astype(np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> list[int]:
    """Which of the links (a, b) join components that none before joins."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for i, (x, y) in enumerate(zip(ra.tolist(), rb.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(i)
    return out


def linked_in_blocks(at: DataFrame, keys: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b): links that join components, for all pairs of classes that share a bucket. at(band, key, node, n, root); keys(node, bands)."""
    p, q = similarity.numerator, similarity.denominator
    common = at.groupBy("band", "key", "root").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.max(F.struct("c", "root")).alias("top")).select("band", "key", "top.root").withColumnRenamed("root", "top")
    weight = F.greatest(F.col("n") * 8, F.lit(LEAST_BYTES))
    asks = F.col("root") != F.col("top")
    at = at.join(common, ["band", "key"])
    sizes = at.groupBy("band", "key").agg(F.ceil(F.sum(weight) / F.lit(float(BLOCK_BYTES))).cast("int").alias("of"), F.ceil(F.sum(F.when(asks, weight)) / F.lit(float(BLOCK_BYTES))).cast("int").alias("asking"))
    at = at.withColumn("asks", asks).join(sizes, ["band", "key"])

    def side(df: DataFrame, own: str, mine: str, all_: str, other: str, left: bool) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1)))
        return dealt.select("band", "key", "i", "j", "node", "root", "asks", F.lit(left).alias("left"))

    both = side(at.filter("asks"), "i", "asking", "of", "j", True).union(side(at, "j", "of", "asking", "i", False))
    entry = F.struct("node", "root", "asks", "left", "bands", "items")
    groups = both.join(keys, "node").join(sets, "node").groupBy("band", "key", "i", "j").agg(F.collect_list(entry).alias("m")).select("band", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for band, group in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = group.values
                node, root, asks, left = (v.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                held = v.field(4).flatten().to_numpy().reshape(len(node), BANDS)
                one, two = np.flatnonzero(left), np.flatnonzero(~left)
                same = held[one][:, None] == held[two][None]
                ok = (same.argmax(axis=2) == band) & (root[one][:, None] != root[two][None]) & (~asks[two][None] | (node[one][:, None] < node[two][None]))
                one, two = one[ok.any(axis=1)], two[ok.any(axis=0)]
                if not len(one):
                    continue
                ok = ok[ok.any(axis=1)][:, ok.any(axis=0)]
                items = [v.field(5)[int(k)].values.to_numpy() for k in np.concatenate([one, two])]
                n = np.array([len(x) for x in items])
                inter = _shared(items[: len(one)], items[len(one) :])
                ok &= inter * q >= (n[: len(one), None] + n[None, len(one) :] - inter) * p
                i, j = np.nonzero(ok)
                i, j = one[i], two[j]
                some = _forest(node[i], node[j], root[i], root[j])
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(node[i[some]]), pa.array(node[j[some]])], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def components(met: DataFrame, sets: DataFrame, similarity: Fraction = SIMILARITY, edges: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of the classes that link; None if none do. met(band, key, node, n); edges(a, b): links found before, of which components are taken first."""
    keys = C.cut(met.groupBy("node").agg(F.collect_list(F.struct("band", "key")).alias("k")).select("node", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries("k"), i), F.xxhash64("node", i))).alias("bands")), "keys")
    roots = None if edges is None else C.components(edges)
    for step in range(PIVOTS + 1):
        at = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = at.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").drop("lo", "hi")
        at = C.cut(at.join(open_, ["band", "key"]), "open")
        if step < PIVOTS:
            left = at.select("band", "key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
            order = F.col("node") if step == 0 else F.xxhash64("node", F.lit(step))
            pivot = at.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))).alias("p")).select("band", "key", "p.b", "p.nb", "p.rb")
            pairs = left.join(pivot, ["band", "key"]).filter(_apart(similarity))
            pairs = C.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            found = C.cut(linked(pairs, sets, similarity), "links")
        else:
            found = C.cut(linked_in_blocks(at, keys, sets, similarity), "links")
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            roots = C.components(edges)
    return roots


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row of docs(doc_id, text and any other columns) of each group of near duplicates."""
    keyed = docs.withColumn("row_key", F.xxhash64(*docs.columns))
    rows = C.cut(prints(keyed, shingle), "prints")
    classes = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("row_key").alias("k"))).alias("first"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    classes = C.cut(classes, "classes")
    keys = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    met = C.cut(keys.join(shared, ["band", "key"]), "met")
    near = simhash_pairs(rows)
    asked = met.select("node").union(near.select("a")).union(near.select("b")).distinct()
    firsts = classes.join(asked, "node", "left_semi").select("node", "first.d", "first.k")
    sets = C.cut(sets_of(keyed, firsts, shingle), "sets")
    links = C.cut(linked(near, sets, similarity), "links")
    roots = components(met, sets, similarity, None if links.isEmpty() else links)
    of = rows.select("doc_id", "row_key", "node")
    of = of.withColumn("root", F.col("node")) if roots is None else of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ranked = C.cut(of.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("r")), "ranked")
    stays = ranked.groupBy("root").agg(F.min("r").alias("best"))
    same = ranked.groupBy("root", "r").agg(F.count("*").alias("copies")).join(stays, "root").withColumn("gone", F.col("r") != F.col("best"))
    marks = C.cut(same.filter("gone or copies > 1").select(F.col("r.doc_id").alias("_d"), F.col("r.row_key").alias("_k"), "gone"), "marks")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k"))
    once = keyed.join(marks, on, "left_anti").select(*docs.columns)
    return once.union(keyed.join(marks.filter("not gone"), on, "left_semi").dropDuplicates(["row_key"]).select(*docs.columns))
