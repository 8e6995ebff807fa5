"""A training corpus from `documents`: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents. The order of a stage's rows is that of its files and of the rows in them: the mix reaches the sequences that way.

Edge cases, stage by stage: null and empty texts have no language and go in the first stage; a null id is kept and matches no other row; rows that repeat an id with other
text are rows of their own, rows equal in all columns are one document from the third stage on; a null source is a source; an empty table gives none.
"""

from __future__ import annotations

import uuid

from panelspark.llm import common, language_id, line_dedup, mixing, near_dedup, packing, tokens
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SCORE = 0.5
#: Chunks that a Python worker of the packing stage remembers: memory against time.
KEPT_CHUNKS = 250_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of at least LEAST_SCORE; the labels learned from are their own."""
    common.small_batches(spark)
    found = language_id.predict(docs, language_id.learn(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those that lose all they had go."""
    common.small_batches(spark)
    found = line_dedup.dedup(docs)
    kept = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near duplicates: a Jaccard similarity of 0.8 of their five-word shingles. Candidates by SimHash, then by MinHash for what its 3 bits don't reach."""
    common.small_batches(spark)
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources at their target weights, the others going on by theirs where one has run out."""
    common.small_batches(spark)
    return mixing.ordered(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences in the order of the mix, which is the order of the files that it wrote and of the rows in them; by doc_id where docs comes from no files."""
    common.small_batches(spark)
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return packing.pack(docs, tokens.public_path(), kept=KEPT_CHUNKS)
    return packing.pack(placed, tokens.public_path(), order=["file", "row"], kept=KEPT_CHUNKS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder."""
    at = f"{common.shared_dir(spark)}/panelspark/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs


#: SQL can't express the model, the hashes and the packing; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None
