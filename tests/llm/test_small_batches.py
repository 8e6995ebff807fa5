"""The pipeline's stages bound the bytes of the Arrow batches that Python gets, and the chunks that its workers remember."""

import corpus_pipeline
import pyarrow as pa
from panelspark.llm import common, tokens
from pyspark.serializers import CloudPickleSerializer


def test_stages_bound_the_bytes_of_batches(spark):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 300) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.pack_sequences(spark, docs, "")
    try:
        got = docs.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(r.n for r in got) == 4000
    assert max(r.size for r in got) < 2 * common.ARROW_BYTES


def test_a_sent_encoder_keeps_its_bound():
    s = CloudPickleSerializer()
    assert s.loads(s.dumps(tokens.Held("x", 7))).kept == 7
    assert s.loads(s.dumps(tokens.Held("x"))).kept == tokens.KEPT_CHUNKS
