"""Statistics over groups and windows that stay null where pandas has NaN, and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans import store
from .scalars import col, div


def sums(x: Column | str, y: Column | str) -> dict[str, Column]:
    """The sums from which correlation and regression of pairs follow; pairs with a null don't count."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}


def pearson(x: Column | str, y: Column | str, least: int = 2, over: WindowSpec | None = None) -> Column:
    """Correlation; null with fewer than `least` pairs or a constant side."""
    s = sums(x, y)
    if over is not None:
        s = {k: v.over(over) for k, v in s.items()}
    n = s["n"].cast("double")
    vx, vy = n * s["sxx"] - s["sx"] * s["sx"], n * s["syy"] - s["sy"] * s["sy"]
    # sums of squares leave a little of a constant's variance
    ok = (s["n"] >= least) & (vx > 1e-12 * n * s["sxx"]) & (vy > 1e-12 * n * s["syy"])
    return F.when(ok, div(n * s["sxy"] - s["sx"] * s["sy"], F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))


def slope(y: Column | str, x: Column | str, least: int = 2, over: WindowSpec | None = None) -> Column:
    s = sums(x, y)
    if over is not None:
        s = {k: v.over(over) for k, v in s.items()}
    n = s["n"].cast("double")
    vx = n * s["sxx"] - s["sx"] * s["sx"]
    return F.when((s["n"] >= least) & (vx > 1e-12 * n * s["sxx"]), div(n * s["sxy"] - s["sx"] * s["sy"], vx))


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1 within `by`, ties sharing their mean; null for null."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    # ties are the rows of equal order, so one sort serves both
    tied = order.rangeBetween(Window.currentRow, Window.currentRow)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(tied) - 1) / 2.0))


def first_rank(value: Column | str, by: list[str], pos: str = "code", descending: bool = True) -> Column:
    """Row numbers from 1 within `by`; ties go to the lower `pos`, nulls come last."""
    v = col(value)
    return F.row_number().over(Window.partitionBy(*by).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last(), pos))


def rows(by: list[str] | str, order: str, lo: int | None, hi: int | None = 0) -> WindowSpec:
    """A frame of rows around the current one; None is unbounded."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


def full(agg: Column, counted: Column | str, over: WindowSpec, least: int) -> Column:
    """A windowed aggregate, null while fewer than `least` values are there."""
    return F.when(F.count(col(counted)).over(over) >= least, agg.over(over))


def trailing(df: DataFrame, value: str, by: str, order: str, lo: int, hi: int, name: str, made: Callable[..., np.ndarray], *others: str) -> DataFrame:
    """df with `name`: a double for each row, NaN as null, from the values of the rows lo to hi (0: itself) before or at it within `by`.

    made(window, there, own, *others) takes whole batches: the windows as a matrix, which places of it hold a value that isn't null, and for each row its own value and the `others` columns (NaN for null).
    A key is one ordered stream, of which the last rows are carried from batch to batch. An aggregate over a sliding frame of rows would be
    worked out anew for each row, and a list of the frame's values would be carried along with it.
    """
    back = -lo
    width = hi - lo + 1
    at, wanted = df.columns.index(by), [df.columns.index(c) for c in (value, *others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, known = None, np.zeros(0), np.zeros(0, bool)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at).dictionary_encode("encode")
            ids = keys.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            own, *rest = (b.column(i).cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy() for i in wanted)
            valid = b.column(wanted[0]).is_valid().to_numpy(zero_copy_only=False)
            first = keys[0].as_py()
            if key is None or first != key[0]:
                held, known = np.zeros(0), np.zeros(0, bool)
            # `back` places ahead of the batch: what is carried of its first key, empty places before that
            gap = back - len(held)
            x, v = np.concatenate([np.zeros(gap), held, own]), np.concatenate([np.zeros(gap, bool), known, valid])
            since = np.repeat(starts, np.diff(np.append(starts, len(own)))) + back
            since[: starts[1] if len(starts) > 1 else len(own)] = gap
            window = np.lib.stride_tricks.sliding_window_view(x, width)[: len(own)]
            places = np.arange(len(own))[:, None] + np.arange(width)[None]
            there = np.lib.stride_tricks.sliding_window_view(v, width)[: len(own)] & (places >= since[:, None])
            out = made(window, there, own, *rest)
            key, low = (keys[len(own) - 1].as_py(),), max(since[-1], len(x) - back)
            held, known = x[low:], v[low:]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64(), from_pandas=True)], [*b.schema.names, name])

    ordered = df.repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInArrow(run, df.schema.add(name, "double") if name not in df.columns else df.schema)


#: Bits of a value that a step of `medians` tells apart: a group has at most 65,536 counts at a time.
STEP = 16


def _ordered_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the doubles of the last column `_bits`, whole numbers in the same order, NaN last and NULL for NULL."""
    for b in batches:
        v = b.column(b.num_columns - 1)
        none = v.is_null().to_numpy(zero_copy_only=False)
        x = v.fill_null(0.0).to_numpy() + 0.0
        x[np.isnan(x)] = np.nan
        bits = np.abs(x).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(x < 0, ~bits, bits), mask=none)], [*b.schema.names, "_bits"])


def medians(df: DataFrame, by: list[str], value: str, total: bool = False) -> DataFrame:
    """(by, n, median): rows, and the exact median as `percentile` gives it, the mean of the two in the middle; with `total` a row for all of df as well, its `by` NULL as in grouping sets.

    An aggregate that holds a group's values grows with them. Here the two in the middle are found by their bits, 16 at a time from the highest on: each step counts, in tasks, the values that begin like
    one of them, and keeps where in the counts they are. Groups are few; what is held is a row for each group and beginning.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    rows = store.cut(rows.mapInArrow(_ordered_bits, rows.withColumn("_bits", F.lit(None).cast("long")).schema), "bits").withColumn("_all", F.lit(False))
    if total:
        own = F.struct(*by, F.lit(False).alias("_all"))
        every = F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by], F.lit(True).alias("_all"))
        rows = rows.select(F.explode(F.array(own, every)).alias("_g"), "_v", "_bits").select("_g.*", "_v", "_bits")
    keys = [*by, "_all"]
    mine = [f"_key{i}" for i in range(len(keys))]

    def same(a: DataFrame, b: DataFrame) -> Column:
        out = a["_in"].eqNullSafe(b["_of"])
        for c, k in zip(keys, mine, strict=True):
            out &= a[c].eqNullSafe(b[k])
        return out

    # a row for each group
    size = store.cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_v").alias("_n")), "sizes")
    middle = F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))
    found = size.filter("_n > 0").select(*keys, F.posexplode(middle).alias("_at", "_k"), F.lit(None).cast("long").alias("_in"))
    for shift in range(64 - STEP, -1, -STEP):
        # two rows for each group
        found = store.cut(found, "middle")
        renamed = [F.col(c).alias(k) for c, k in zip(keys, mine, strict=True)] + [F.col("_in").alias("_of")]
        near = rows.filter("_v is not null").withColumn("_in", F.shiftright("_bits", shift + STEP) if shift + STEP < 64 else F.lit(None).cast("long"))
        if shift + STEP < 64:
            wanted = found.select(*renamed).distinct()
            near = near.join(F.broadcast(wanted), same(near, wanted), "left_semi")
        counts = near.groupBy(*keys, "_in", F.shiftright("_bits", shift).alias("_next")).agg(F.count("*").alias("_c"), F.max("_v").alias("_v"))
        until = F.sum("_c").over(Window.partitionBy(*keys, "_in").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_before", until - F.col("_c")).select(*renamed, "_next", "_c", "_v", "_before")
        hit = same(found, counts) & (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))
        found = counts.join(F.broadcast(found.drop("_v")), hit).select(*keys, "_at", (F.col("_k") - F.col("_before")).alias("_k"), F.col("_next").alias("_in"), "_v")
    half = found.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, mine, strict=True)]).agg(F.when(F.min("_v") == F.max("_v"), F.max("_v")).otherwise(F.sum(F.col("_v") * 0.5)).alias("median"))
    alike = F.lit(True)
    for c, k in zip(keys, mine, strict=True):
        alike &= size[c].eqNullSafe(half[k])
    return size.join(F.broadcast(half), alike, "left").select(*by, "n", "median")
