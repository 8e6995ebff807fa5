"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows are dealt into blocks of `block_rows`. With q of Q slots as its
target, block j of a source is released at floor(j * Q / q) and due at
ceil((j + 1) * Q / q); every slot goes to the released block with the earliest
deadline. Targets add up to Q, so every deadline is met and a source is always less than one block from
its share. The schedule repeats after Q slots; one period is computed by a fold
over Q slots (a fixed number), and block j of a source takes slot
(j div q) * Q + the slot of its (j mod q)-th block in the period.

Ranks within a source come in two levels: buckets of the hash of doc_id, counted
and summed up, then rows within a bucket. So a source with a third of all rows is
spread over all tasks.

The mix is exact up to its horizon: the first slot whose source has no block
left. Rows of later slots are marked, not dropped; `select` keeps those before it, `ordered` keeps all.

Edge cases: null sources are a source of their own; the last block of a source may
be short; rows with one id keep separate places; no rows give none. Target
weights that are missing, null or not positive are zero, and their source's rows are
never in the mix (slot null). Sources are few enough for one row of each in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK_ROWS = 16
SLOTS = 1000
TEMPER = 0.5
BUCKET_DIGITS = 3


def tempered(docs: DataFrame, temper: float = TEMPER) -> DataFrame:
    """(source, weight): sizes to a power; 1 leaves the natural shares, 0 makes them equal."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(temper)).alias("weight"))


def targets(weights: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, q, i): whole slots of each source by largest remainders, at least one; Q, their sum, is `slots` or the number of sources if that is more."""
    some = weights.groupBy("source").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    every = Window.partitionBy(F.lit(0))
    shares = some.withColumn("n", F.count("*").over(every)).withColumn("total", F.greatest(F.lit(slots), F.col("n").cast("int")))
    # one slot each, the rest in proportion
    shares = shares.withColumn("exact", F.col("weight") / F.sum("weight").over(every) * (F.col("total") - F.col("n")))
    shares = shares.withColumn("exact", F.round("exact", 6))  # sums of doubles may differ in the last place
    shares = shares.withColumn("whole", F.floor("exact")).withColumn("left", F.col("total") - F.col("n") - F.sum("whole").over(every))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 6)), F.col("source").asc_nulls_first())
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_first())
    q = 1 + F.col("whole") + F.when(F.row_number().over(order) <= F.col("left"), 1).otherwise(0)
    return shares.select("source", q.cast("long").alias("q"), (F.row_number().over(by_name) - 1).alias("i"), F.col("total").cast("long").alias("total"))


def period(shares: DataFrame) -> DataFrame:
    """(source, k, slot): earliest deadline first over one period; slot of the k-th block of each source."""
    row = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "source", "q"))).alias("s"), F.max("total").alias("total")).filter("total is not null")
    # released blocks of the fold's state, an array of blocks done, as (deadline, source)
    due = "array_min(transform(a.done, (c, i) -> if(c * total div s[i].q <= t, struct(((c + 1) * total + s[i].q - 1) div s[i].q as due, i as i), null)))"
    fold = f"""aggregate(sequence(0L, total - 1), struct(transform(s, x -> 0L) as done, cast(array() as array<struct<i:int,k:bigint>>) as out),
        (a, t) -> transform(array({due}), p -> struct(transform(a.done, (c, i) -> if(i = p.i, c + 1, c)) as done, array_append(a.out, struct(p.i as i, a.done[p.i] as k)) as out))[0],
        a -> a.out)"""
    taken = row.select("s", F.expr(fold).alias("out")).select("s", F.posexplode("out").alias("slot", "o"))
    return taken.select(F.expr("s[o.i].source").alias("source"), F.col("o.k").alias("k"), F.col("slot").cast("long").alias("slot"))


def schedule(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, temper: float = TEMPER) -> DataFrame:
    """docs (any columns; doc_id and source are read) with mix_block (of its source), mix_place (in the block), mix_slot and in_mix.

    weights(source, weight): default `tempered`.
    """
    hashed = docs.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    sizes = hashed.groupBy(F.col("source").alias("_s"), F.col("_b").alias("_sb")).agg(F.count("*").alias("_n"))
    before = sizes.select("_s", "_sb", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_sb")) - F.col("_n")).alias("_before"))
    placed = hashed.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb"))).drop("_s", "_sb")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id")) - 1
    blocks = placed.withColumn("_rank", rank).withColumn("mix_block", F.expr(f"_rank div {block_rows}")).withColumn("mix_place", F.expr(f"_rank % {block_rows}"))

    shares = targets(tempered(docs, temper) if weights is None else weights, slots)
    plan = period(shares).withColumnsRenamed({"source": "_s", "slot": "_slot"})
    one = shares.withColumnsRenamed({"source": "_t", "q": "_q", "total": "_total"}).drop("i")
    # the first slot that finds its source empty
    held = docs.groupBy(F.col("source").alias("_c")).agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("_blocks"))
    ends = one.join(held, F.col("_t").eqNullSafe(F.col("_c")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(0).cast("long")))
    ends = ends.join(plan, F.col("_t").eqNullSafe(F.col("_s")) & (F.col("k") == F.expr("_blocks % _q"))).agg(F.min(F.expr("_blocks div _q * _total + _slot")).alias("_horizon"))

    table = plan.join(one, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    # at most `slots` rows, or one for each source: small by construction
    table = F.broadcast(table.crossJoin(ends))
    wanted = blocks.withColumn("_null", F.col("source").isNull())
    # block mod q needs q: a table of one row for each source first, then the period
    with_q = wanted.join(F.broadcast(one.withColumnRenamed("_total", "_o")), F.col("source").eqNullSafe(F.col("_t")), "left").withColumn("_k", F.expr("mix_block % _q")).drop("_t", "_q", "_o", "_null")
    out = with_q.join(table, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("k")), "left")
    out = out.withColumn("mix_slot", F.expr("mix_block div _q * _total + _slot")).withColumn("in_mix", F.coalesce(F.col("mix_slot") < F.col("_horizon"), F.lit(False)))
    return out.select(*docs.columns, "mix_block", "mix_place", "mix_slot", "in_mix")


def select(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are in the mix, with their columns."""
    return schedule(docs, **how).filter("in_mix").select(*docs.columns)


def ordered(docs: DataFrame, **how) -> DataFrame:
    """All rows of docs whose source has a weight, with their columns, by slot and place: slots of empty sources are passed over."""
    return schedule(docs, **how).filter("mix_slot is not null").orderBy("mix_slot", "mix_place").select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(C.documents(spark, sf_dir).select("doc_id", "source"))


OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT source, power(count(*)::DOUBLE, {TEMPER}) AS weight, count(*) AS n_rows FROM documents GROUP BY source),
 a AS (SELECT source, n_rows, count(*) OVER () AS n, greatest({SLOTS}, count(*) OVER ()) AS total, weight / sum(weight) OVER () AS share FROM w),
 b AS (SELECT *, round(share * (total - n), 6) AS exact FROM a),
 c AS (SELECT *, floor(exact) AS whole, total - n - sum(floor(exact)) OVER () AS rest FROM b),
 q AS (SELECT source, n_rows, total, (1 + whole + CASE WHEN row_number() OVER (ORDER BY round(exact - whole, 6) DESC, source ASC NULLS FIRST) <= rest THEN 1 ELSE 0 END)::BIGINT AS q,
         row_number() OVER (ORDER BY source ASC NULLS FIRST) AS i FROM c),
 s AS (SELECT list(q ORDER BY i) AS qs, max(total)::BIGINT AS total FROM q),
 sim AS (
   SELECT 0::BIGINT AS t, list_transform(qs, lambda x: 0::BIGINT) AS done, qs, total, 0::BIGINT AS took, 0::BIGINT AS k FROM s
   UNION ALL
   SELECT t + 1, list_transform(done, lambda c, i: CASE WHEN i = p THEN c + 1 ELSE c END), qs, total, p, done[p]
   FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(qs) + 1), lambda i: done[i] * total // qs[i] <= t),
           lambda i: {{'due': ((done[i] + 1) * total + qs[i] - 1) // qs[i], 'i': i}})).i AS p FROM sim WHERE t < total)),
 plan AS (SELECT q.source, q.q, q.total, q.n_rows, sim.k, sim.t - 1 AS slot FROM sim JOIN q ON sim.took = q.i WHERE sim.t > 0),
 horizon AS (SELECT min(((n_rows + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) // q * total + slot) AS h FROM plan WHERE k = ((n_rows + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) % q),
 r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM documents),
 d AS (SELECT doc_id, source, rank // {BLOCK_ROWS} AS mix_block, rank % {BLOCK_ROWS} AS mix_place FROM r)
SELECT d.doc_id, d.source, d.mix_block, d.mix_place, d.mix_block // q * total + slot AS mix_slot, d.mix_block // q * total + slot < h AS in_mix
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND p.k = d.mix_block % p.q, horizon
"""
