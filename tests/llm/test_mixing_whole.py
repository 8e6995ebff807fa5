"""The mixing stage keeps every document, however small a source is."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("large", [3000, 40000])
@pytest.mark.parametrize("tiny", ["tiny", None])
def test_a_tiny_source_does_not_end_the_mix(spark, large, tiny):
    rows = [(d, "t", "en", "large", 1) for d in range(large)] + [(large, "t", "en", tiny, 1)] + [(large + 1 + d, "t", "en", "small", 1) for d in range(100)]
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    # the small sources come by their weights first and the large one goes on alone
    assert {r.source for r in out[: len(out) // 2]} == {"large", "small", tiny}
    assert {r.source for r in out[-large // 4 :]} == {"large"}
