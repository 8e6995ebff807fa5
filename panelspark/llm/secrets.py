"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans are strong on their own (fixed formats below). Parts that mean little
alone are weak: logins, opaque blobs, service endpoints. They are reported only
where complementary parts co-occur within a scope, an interval of `SCOPE`
characters around the part:
* a login needs a secret (assigned value, hexadecimal key or blob) near it,
* a blob needs an access identifier or a login near it,
* an endpoint needs both an identifier (access or login) and a secret (assigned or hexadecimal).
A weak part that lies over a base span is not reported.

The interval join is a sweep: within a document parts are sorted by start, and for
each kind the furthest end before and the nearest start after tell whether an
interval of that kind lies in reach. No pairs of parts are made. Positions come from the
gaps and matches of each pattern, laid out as rows and summed up in order.

Edge cases: a null text is an empty one; repeated rows each get the result; a null
id stays null; texts without any span have zero counts and empty strings. Lengths count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

# Kinds in order with pattern, the group that counts and its least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("login", r"""(?i:(user(?:name|_?id)?|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3),
    ("blob", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}", 0, 32),
    ("endpoint", r"""(?i:(https?|ftps?|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?))://([^\x20\x09-\x0D"'<>]+)""", 2, 3),
]
SCOPE = 400
NO_ID = (1 << 63) - 1
BASE_KINDS = [k for k, *_ in BASE]
KINDS = [k for k, *_ in BASE + WEAK]


def _layout(text: Column, kind: str, pattern: str, group: int) -> Column:
    """An array of (kind, pos, gap, whole, part): code points before each match since the last one, in it, and in its group; empty without a match."""
    lit = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    part = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    rows = F.arrays_zip(gaps.alias("g"), whole.alias("w"), part.alias("p"))
    made = F.transform(
        rows,
        lambda r, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.char_length(r["g"]).cast("long").alias("gap"), F.coalesce(F.char_length(r["w"]), F.lit(0)).cast("long").alias("whole"), F.coalesce(F.char_length(r["p"]), F.lit(0)).alias("part")),
    )
    return F.when(F.rlike(text, lit), made)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, kind, start, end): base spans, and weak ones with complementary parts in scope. docs: doc_id, row_key, text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, (_, _, _, m) in enumerate(BASE + WEAK) for x in (k, m)]), F.col("kind"))
    found = reduce(lambda df, p: df.withColumn(f"_{p[0]}", _layout(F.col("text"), *p[:3])), BASE + WEAK, docs.select("doc_id", "row_key", F.coalesce("text", F.lit("")).alias("text")))
    layouts = F.concat(*[F.coalesce(f"_{k}", F.array().cast("array<struct<kind:int,pos:int,gap:long,whole:long,part:int>>")) for k in KINDS])
    rows = found.select("doc_id", "row_key", F.explode(layouts).alias("m")).select("doc_id", "row_key", "m.*")
    rows = rows.repartition(n, "doc_id", "row_key").dropDuplicates(["doc_id", "row_key", "kind", "pos"])
    sofar = Window.partitionBy("doc_id", "row_key", "kind").orderBy("pos")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(sofar)).withColumn("start", F.col("end") - F.col("whole"))
    parts = placed.filter((F.col("whole") > 0) & (F.col("part") >= least)).select("doc_id", "row_key", "kind", "start", "end")

    # what follows is what comes before in the reverse order: a frame that only grows costs a step a row
    by = Window.partitionBy("doc_id", "row_key")
    before = by.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)

    def near(*kinds: str) -> Column:
        is_it = F.col("kind").isin([KINDS.index(k) for k in kinds])
        last = F.max(F.when(is_it, F.col("end"))).over(before)
        following = F.min(F.when(is_it, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= SCOPE, F.lit(False)) | F.coalesce(following - F.col("end") <= SCOPE, F.lit(False))

    base = F.col("kind") < len(BASE)
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    flags = parts.select("*", covered.alias("covered"), near("assign", "hex").alias("secret"), near("blob").alias("blob"), near("access", "login").alias("holder"))
    kept = F.when(base, True).when(F.col("covered"), False)
    kept = kept.when(F.col("kind") == KINDS.index("login"), F.col("secret") | F.col("blob"))
    kept = kept.when(F.col("kind") == KINDS.index("blob"), F.col("holder")).otherwise(F.col("holder") & F.col("secret"))
    return flags.filter(kept).select("doc_id", "row_key", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text) with n_assign, n_access, n_hex, base (kind:start:end, comma-joined) and spans (base and weak alike)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), C.row_key().alias("row_key"), "text")
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = spans(rows).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))

    def joined(only_base: bool) -> Column:
        some = F.filter("found", lambda s: s["kind"] < len(BASE)) if only_base else F.col("found")
        return F.coalesce(F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))), F.lit(0)).cast("long").alias(f"n_{kind}")

    out = rows.select("doc_id", "row_key").join(listed, ["doc_id", "row_key"], "left")
    return out.select(F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), *[count(k) for k in BASE_KINDS], joined(True).alias("base"), joined(False).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
