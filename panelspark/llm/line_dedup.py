"""Line dedup with a segment-partition edit join.

A line goes if an earlier one, by (doc_id, hash of the text, line number), is within
`edits` edits of bytes (insert, delete, replace). Lines are what stands between newlines; blank ones (white space alone) are never judged,
lines under `least` bytes only against equal ones, since two edits make other words of short lines. Decisions are made on the input: a line that goes still makes later ones go.

Equal lines are one class, found by map-side combined minima, so hot lines cost one
row. Classes that differ are joined by partition: a line of length n is cut
into edits+1 segments, and of two lines within `edits` one has a segment that
the other holds, at a place that its length and number bound (multi-match-aware
windows). Every line puts its segments into an index under (length, segment number, text) and
probes the indexes of its own and the next smaller lengths. Lines that meet there are filtered by
a sketch of their bytes, and pairs that pass are verified by banded bit-parallel edit distance.

A line needs one earlier partner, not all. First the lines of an index entry are dealt into blocks of
about `BLOCK_LINES`, and in its block each names its `FIRST` likeliest earlier partners. Lines that none of these
settles, and that have more partners there or elsewhere under the entry, meet all lines of the entry: blocks
of open lines against blocks of all lines, each pair of blocks a group of bounded size. There partners are verified from the
likeliest on until one holds, and only the lines that are settled come out. So nothing is lost, dense groups don't give their pairs, and no group is one task.

Edge cases: null texts have no lines and stay null; null ids come last; repeated rows have all their
lines judged alike (the first copy in the order of ids keeps them, equal rows are one place, so both
keep theirs); texts that lose all lines become empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

EDITS = 2
LEAST = 16
FIRST = 4
#: Lines in a block; every line counts as LINE_BYTES bytes at least, so that blocks of long lines have fewer.
BLOCK_LINES, LINE_BYTES = 256, 16384
NO_ID = (1 << 63) - 1
_MASK = (1 << 63) - 1


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits+1 segments of a line of n bytes: even, the longer ones last."""
    k = edits + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def windows(n: int, m: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment number, length, first and last start) at which a line of n bytes can hold a segment of one of m <= n bytes."""
    out, more = [], n - m
    for i, (at, size) in enumerate(segments(m, edits)):
        low = max(0, at - i, at + more - (edits - i))
        high = min(n - size, at + i, at + more + (edits - i))
        if size and low <= high:
            out.append((i, size, low, high))
    return out


def sketch(line: bytes) -> int:
    """Counts of bytes in 7 classes, modulo 16, four bits each."""
    n = np.bincount(np.frombuffer(line, np.uint8) % 7, minlength=7) & 15
    return int((n << _PLACES).sum())


_PLACES = 4 * np.arange(7)
_PROBE = 1 << 28


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most twice the edits between lines of these sketches."""
    total = np.zeros(np.broadcast(a, b).shape, np.int16)
    for k in _PLACES.tolist():
        d = ((a >> k) - (b >> k)) & 15
        total += np.minimum(d, 16 - d).astype(np.int16)
    return total


def within(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """For pairs of lines: whether their edit distance is at most edits. Banded and bit-parallel, for pairs whose bytes allow it.

    For each number of errors a word holds the 2*edits+1 diagonals around the main one;
    a bit says that the prefixes that end there are that close. All pairs move one byte at a time.
    """
    out = np.zeros(len(a), bool)
    lines = list(dict.fromkeys([*a, *b]))
    place = dict(zip(lines, range(len(lines)), strict=True))
    i, j = (np.fromiter((place[x] for x in y), np.int64, len(a)) for y in (a, b))
    counts = np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in lines]).astype(np.int32) if lines else np.zeros((0, 256), np.int32)
    # an edit changes two counts of bytes by one at most
    able = [np.abs(counts[i[low : low + 4096]] - counts[j[low : low + 4096]]).sum(axis=1) <= 2 * edits for low in range(0, len(a), 4096)]
    order = np.flatnonzero(np.concatenate(able)) if able else np.zeros(0, np.int64)
    order = order[np.argsort([len(a[k]) for k in order], kind="stable")]
    for low in range(0, len(order), 2048):
        some = order[low : low + 2048]
        out[some] = _within([a[k] for k in some], [b[k] for k in some], edits)
    return out


def _within(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width, band = int(max(n.max(), m.max())), 2 * edits + 1
    word = np.uint8 if band <= 8 else np.uint64
    # different padding, so that it never matches; row by row of bytes for speed
    left, right = np.full((width + 2 * edits + 1, len(a)), 256, np.int16), np.full((width, len(a)), 257, np.int16)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[edits : edits + len(x), i] = np.frombuffer(x, np.uint8)
        right[: len(y), i] = np.frombuffer(y, np.uint8)
    # bit k of a column j stands for the prefix of a of j + k - edits bytes
    states = [np.full(len(a), sum(1 << k for k in range(band) if 0 <= k - edits <= e), word) for e in range(edits + 1)]
    at = np.clip(n - m + edits, 0, band - 1).astype(word)
    close = np.abs(n - m) <= edits
    out = close & (m == 0)
    for j in range(width):
        eq = np.zeros(len(a), word)
        for k in range(band):
            eq |= (left[j + k] == right[j]).astype(word) << word(k)
        below = states[0]
        states[0] = moved = below & eq
        for e in range(1, edits + 1):
            old = states[e]
            states[e] = moved = ((old & eq) | below | (below >> word(1)) | (moved << word(1))) & word((1 << band) - 1)
            below = old
        done = m == j + 1
        if done.any():
            out |= done & close & ((moved >> at) & word(1)).astype(bool)
    return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), C.row_key().alias("row_key"), "text")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, line, h, g): place and 128-bit hash of every line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            doc, key, no, hashes = [], [], [], []
            for d, k, text in zip(C.column(b, "doc_id"), C.column(b, "row_key"), C.texts(b), strict=True):
                for i, line in enumerate((text or b"").split(b"\n")):
                    if line and not line.isspace():
                        doc.append(d)
                        key.append(k)
                        no.append(i)
                        hashes.append(xxhash.xxh3_128_digest(line))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(no, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "row_key", "line", "h", "g"])

    return docs.mapInArrow(run, "doc_id long, row_key long, line int, h long, g long")


def entries(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h, s) of lines: their segments, and where they probe; s is the sketch, with a bit set for probes. Lines that a worker met lately are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple] = {}
        seen: set[bytes] = set()
        digest, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for b in C.slices(batches, most=1_000_000):
            keys: list[int] = []
            names: list[bytes] = []
            marks: list[int] = []
            counts: list[int] = []
            if len(seen) > 200_000:
                seen.clear()
            for text in C.texts(b):
                for line in (text or b"").split(b"\n"):
                    n = len(line)
                    if n < least or line.isspace() or (name := whole(line)) in seen:
                        continue
                    seen.add(name)
                    if n not in plans:
                        own = [(at, at + size, digest(f"{n},{i}")) for i, (at, size) in enumerate(segments(n, edits)) if size]
                        probes = {(at, at + size, digest(f"{m},{i}")) for m in range(max(1, n - edits), n + 1) for i, size, low, high in windows(n, m, edits) for at in range(low, high + 1)}
                        plans[n] = own, sorted(probes - set(own))
                    own, probes = plans[n]
                    s = sketch(line)
                    keys += [digest(line[x:y], seed) for x, y, seed in own]
                    keys += [digest(line[x:y], seed) for x, y, seed in probes]
                    names.append(name)
                    marks += (s, s | _PROBE)
                    counts += (len(own), len(probes))
            if keys:
                h = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)[:, 0]
                per = np.array(counts).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(h, per.sum(axis=1))), pa.array(np.repeat(np.array(marks, np.int32), per.reshape(-1)))], ["key", "h", "s"])

    return docs.select("text").mapInArrow(run, "key long, h long, s int")


def meetings(found: DataFrame) -> DataFrame:
    """The entries whose key several lines have, at least one as its own segment.

    One shuffle by key. Sketches stay below the probe bit, so sorted by s a key's own
    segments come first, and one row is held at most.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, (0, 0)  # the key of the last row, and its first row if nothing has met it yet
        open_, good = False, False
        for b in batches:
            key, h, s = (b.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            start = np.append(True, key[1:] != key[:-1])
            carried = last_key is not None and key[0] == last_key
            if carried:
                start[0] = False
            group = np.cumsum(start)
            at = np.flatnonzero(start)
            # by group: whether its first row is an own segment, and its first line
            first_own = np.append(good, s[at] < _PROBE)
            first_h = np.append(last[0], h[at])
            differs = h != first_h[group]
            met = np.zeros(len(first_own), bool)
            np.logical_or.at(met, group, differs)
            was_open = carried and not open_ and good
            met[0] = met[0] or (carried and open_)
            keep = met[group] & first_own[group]
            rows = [(key[keep], h[keep], s[keep])]
            if was_open and met[0] and first_own[0]:
                rows.append((np.array([last_key]), np.array([last[0]]), np.array([last[1]], np.int32)))
            if len(rows[0][0]) or len(rows) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["key", "h", "s"])
            g = int(group[-1])
            open_, good = bool(met[g]), bool(first_own[g])
            last_key = key[-1]
            if g:
                i = int(at[-1])
                last = (h[i], s[i])

    return found.repartition(n, "key").sortWithinPartitions("key", "s", "h").mapInArrow(run, "key long, h long, s int")


def _passing(s: np.ndarray, probe: np.ndarray, order: np.ndarray, mine: np.ndarray, others: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(gap, ok) of lines `mine` with `others`: what their sketches differ by, and whether the others may be earlier partners."""
    gap = sketch_gap(s[mine, None], s[None, others])
    return gap, (gap <= 2 * edits) & (order[None, others] < order[mine, None]) & ~(probe[mine, None] & probe[None, others])


def _columns(group: pa.ListScalar) -> list[np.ndarray]:
    """h, g, sketch, probe and place in the order of first places, of the lines of a group."""
    v = group.values.flatten()
    h, g, doc, row, no, s, probe = (v[i].to_numpy(zero_copy_only=False) for i in range(7))
    order = np.empty(len(h), np.int64)
    turn = np.lexsort((no, row, doc))
    # the same line twice in a group, by two of its entries, has one place
    order[turn] = np.cumsum(np.append(0, (np.diff(doc[turn]) != 0) | (np.diff(row[turn]) != 0) | (np.diff(no[turn]) != 0)))
    return [h, g, s, probe, order]


def _entry(*more: Column | str) -> Column:
    return F.struct("h", "g", "rank.doc_id", "rank.row_key", "rank.line", (F.col("s") % _PROBE).alias("sketch"), (F.col("s") >= _PROBE).alias("probe"), *more)


def candidates(met: DataFrame, edits: int, first: int) -> DataFrame:
    """Pairs of classes (h, g, eh, eg, more), the second earlier, that share an index entry and a block of it and may be close by their sketches.

    Each line and entry gives its `first` closest ones; more tells whether it has others. met(key, h, g, s, rank, blocks).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[np.ndarray] = []
            for group in b.column(0):
                h, g, s, probe, order = _columns(group)
                every = np.arange(len(h))
                for low in range(0, len(h), BLOCK_LINES):
                    mine = every[low : low + BLOCK_LINES]
                    gap, ok = _passing(s, probe, order, mine, every, edits)
                    near = np.argsort(np.where(ok, gap, 1000), axis=1, kind="stable")[:, :first]
                    i, j = np.repeat(np.arange(len(mine)), near.shape[1]), near.reshape(-1)
                    keep = ok[i, j]
                    i, j = i[keep], j[keep]
                    if len(i):
                        out.append(np.stack([h[mine[i]], g[mine[i]], h[j], g[j], ok.sum(axis=1)[i] > first]))
            if out:
                *ends, more = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(more.astype(bool))], ["h", "g", "eh", "eg", "more"])

    lists = met.groupBy("key", F.pmod(F.xxhash64("h"), "blocks").alias("block")).agg(F.collect_list(_entry()).alias("m"))
    return lists.select("m").mapInArrow(run, "h long, g long, eh long, eg long, more boolean").groupBy("h", "g", "eh", "eg").agg(F.max("more").alias("more"))


def settled_in_blocks(met: DataFrame, edits: int) -> DataFrame:
    """(h, g) of the asked classes that have an earlier partner under one of their entries. met(key, h, g, s, rank, ask, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 64):
                found = settle([partners(group) for group in b.column(0).slice(low, 64)])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["h", "g"])

    def partners(group: pa.ListScalar) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of a group: the asking lines' h and g, all texts, the asking lines' places, their partners from the likeliest on, how many these are."""
        h, g, s, probe, order = _columns(group)
        asks = group.values.field("asks").to_numpy(zero_copy_only=False)
        mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        gap, ok = _passing(s, probe, order, mine, others, edits)
        near = np.argsort(np.where(ok, gap, 1000), axis=1, kind="stable")
        return np.stack([h[mine], g[mine]], axis=1), group.values.field("t").to_pylist(), mine, others[near], ok.sum(axis=1)

    def settle(groups: list[tuple]) -> np.ndarray:
        """(h, g) of the asking lines of the groups that have a partner; all groups go one step at a time, so that many pairs are verified at once."""
        done = [np.zeros(len(n), bool) for *_, n in groups]
        at, step = 0, FIRST
        while True:
            a: list[bytes] = []
            b: list[bytes] = []
            of: list[tuple[int, np.ndarray]] = []
            for k, (_, t, mine, near, n) in enumerate(groups):
                left = np.flatnonzero(~done[k] & (n > at))
                i, j = (x.reshape(-1) for x in np.broadcast_arrays(left[:, None], np.arange(at, min(at + step, near.shape[1]))[None]))
                i, j = i[j < n[i]], j[j < n[i]]
                if len(i):
                    a += [t[x] for x in mine[i].tolist()]
                    b += [t[x] for x in near[i, j].tolist()]
                    of.append((k, i))
            if not of:
                break
            good, start = within(a, b, edits), 0
            for k, i in of:
                done[k][i[good[start : start + len(i)]]] = True
                start += len(i)
            at, step = at + step, step * 2
        return np.concatenate([named[x] for (named, *_), x in zip(groups, done, strict=True)])

    weight = F.greatest(F.length("t").cast("long"), F.lit(LINE_BYTES))
    most = float(BLOCK_LINES * LINE_BYTES)
    sizes = met.groupBy("key").agg(F.ceil(F.sum(weight) / most).cast("int").alias("of"), F.ceil(F.sum(F.when(F.col("ask"), weight)) / most).cast("int").alias("asking"))
    at = met.join(sizes, "key")

    def side(df: DataFrame, own: str, mine: str, all_: str, other: str, asks: bool) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("h"), mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1)))
        return dealt.select("key", "i", "j", _entry(F.lit(asks).alias("asks"), "t").alias("e"))

    groups = side(at.filter("ask"), "i", "asking", "of", "j", True).union(side(at, "j", "of", "asking", "i", False)).groupBy("key", "i", "j").agg(F.collect_list("e").alias("m"))
    return groups.select("m").mapInArrow(run, "h long, g long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Those (h, g) of the pairs that are within `edits` of their partner. texts: h, g, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "t"):
            ok = within(C.texts(b, "t"), C.texts(b, "et"), edits)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["h", "g"])

    other = texts.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("t").alias("et"))
    return pairs.join(texts, ["h", "g"]).join(other, ["eh", "eg"]).select("h", "g", "t", "et").mapInArrow(run, "h long, g long").distinct()


#: Places of lines that may be broadcast; more of them are joined.
BROADCAST_LINES = 100_000


def texts_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, g, t): the lines of the asked classes. firsts(doc_id, row_key, line, h, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            h, g, t = [], [], []
            for text, asks in zip(C.texts(b), C.column(b, "asked"), strict=True):
                rows = (text or b"").split(b"\n")
                for ask in asks:
                    h.append(ask["h"])
                    g.append(ask["g"])
                    t.append(rows[ask["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(t, pa.binary())], ["h", "g", "t"])

    firsts = C.cut(firsts, "asked")
    lists = firsts.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("line", "h", "g")).alias("asked"))
    if firsts.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    return docs.join(lists, ["doc_id", "row_key"]).select("text", "asked").mapInArrow(run, "h long, g long, t binary").dropDuplicates(["h", "g"])


def removed(rows: DataFrame, edits: int = EDITS, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(doc_id, row_key, line) of the lines to remove. rows: doc_id, row_key, text, see `_plain`."""
    every = C.cut(lines(rows), "lines")
    classes = C.cut(every.groupBy("h", "g").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("rank"), F.count("*").alias("copies")), "classes")
    places = classes.select("rank.*", "h", "g")
    # lines that share the first half of their hashes come apart here
    met = C.cut(meetings(entries(rows, edits, least)).join(classes.drop("copies"), "h"), "met")
    blocks = met.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_LINES))).cast("int").alias("blocks"))
    met = met.join(blocks, "key")
    pairs = C.cut(candidates(met, edits, first), "pairs")
    wanted = pairs.select("h", "g").union(pairs.select("eh", "eg")).distinct()
    texts = C.cut(texts_of(rows, places.join(wanted, ["h", "g"], "left_semi")), "texts")
    settled = C.cut(verified(pairs.drop("more"), texts, edits), "settled")
    # not settled, with partners not tried yet: in their blocks, or in other blocks of an entry
    untried = pairs.filter("more").select("h", "g").union(met.filter("blocks > 1").select("h", "g")).distinct()
    open_ = C.cut(untried.join(settled, ["h", "g"], "left_anti").withColumn("ask", F.lit(True)), "open")
    again = met.join(open_, ["h", "g"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    keys = again.filter("ask").select("key").distinct()
    again = C.cut(again.join(keys, "key", "left_semi"), "again")
    unread = again.select("h", "g").distinct().join(texts, ["h", "g"], "left_anti")
    known = texts.union(texts_of(rows, places.join(unread, ["h", "g"], "left_semi")))
    late = settled.union(settled_in_blocks(again.join(known, ["h", "g"]), edits)).distinct().withColumn("late", F.lit(True))
    judged = classes.join(late, ["h", "g"], "left").select("h", "g", F.col("rank").alias("first_at"), F.coalesce("late", F.lit(False)).alias("late"), "copies").filter("late or copies > 1")
    return every.join(judged, ["h", "g"]).filter(F.col("late") | (F.struct("doc_id", "row_key", "line") != F.col("first_at"))).select("doc_id", "row_key", "line")


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """docs (doc_id, text and any other columns) with `text` without removed lines and, last, n_lines and n_removed."""
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_key", C.row_key())
    gone = removed(_plain(docs), edits, least, first).groupBy(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).agg(F.collect_set("line").alias("_gone"))
    joined = keyed.join(gone, (F.col("_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    n_lines = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    n_gone = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    return joined.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), n_gone.alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
