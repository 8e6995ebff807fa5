"""Places and running sums over a whole table in one order, spread over tasks.

The table is range partitioned by the order and sorted; each task sums up its own range and the result is written. What
lies before a range is then a sum over the ranges: one row for each shuffle partition, however many rows the table has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """df with `place` (from 1) and, for each column of `sums` (long, no nulls), `<column>_upto`: the sum up to and with the row.

    The order must tell rows apart, or rows that are alike come in any order; rows of one key lie in one range only where all order columns are equal.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = ["place", *(f"{c}_upto" for c in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), [0] * len(added)
        for b in batches:
            if not b.num_rows:
                continue
            made = []
            for i, c in enumerate((None, *sums)):
                up = np.cumsum(np.ones(b.num_rows, np.int64) if c is None else b.column(b.schema.get_field_index(c)).to_numpy()) + before[i]
                before[i] = int(up[-1])
                made.append(pa.array(up, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *made], [*b.schema.names, "_part", *added])

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, f"{kept}, _part int, " + ", ".join(f"{c} long" for c in added))
    ranges = C.cut(ranges, "ranges")
    # one row for each range
    ends = sorted(ranges.groupBy("_part").agg(*[F.max_by(c, "place").alias(c) for c in added]).collect())
    before, starts = [0] * len(added), []
    for end in ends:
        starts.append((end["_part"], *before))
        before = [x + end[c] for x, c in zip(before, added, strict=True)]
    table = df.sparkSession.createDataFrame(starts, "_part int, " + ", ".join(f"_b{i} long" for i in range(len(added))))
    return ranges.join(F.broadcast(table), "_part").select(*df.columns, *[(F.col(c) + F.col(f"_b{i}")).alias(c) for i, c in enumerate(added)])
