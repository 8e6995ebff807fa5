import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelspark.llm import idcoder, token_files, tokens
from tests.llm.test_packing import ODD, plain


def back(*coded: bytes) -> list[list[int]]:
    return [ids.tolist() for _, ids in sorted(idcoder.decode(list(coded)), key=lambda r: r[0])]


@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, (1 << 32) - 1)), max_size=300), min_size=1, max_size=4), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_round_trip(segments, block):
    assert back(*[idcoder.encode(np.array(ids, np.int64), block) for ids in segments]) == segments


def test_blocks_longer_than_a_chunk():
    rnd = np.random.default_rng(1)
    x = rnd.zipf(1.2, 5000) % 3000
    x[2000:3500] = x[:1500]
    assert back(idcoder.encode(x, 1700), idcoder.encode(x[:10], 1700)) == [x.tolist(), x[:10].tolist()]


def test_a_segment_is_smaller_than_its_entropy_and_zlib():
    """The documents of the test tables: below order-0 entropy, though blocks start anew."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate(tokens.Encoder(tokens.public_path()).encode([(t or "").encode() for t in texts]))
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    coded = idcoder.encode(ids)
    assert len(coded) < -(p * np.log2(p)).sum() / 8 * len(ids)
    assert len(coded) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    assert back(coded) == [ids.tolist()]


def test_damage_is_seen():
    rnd = np.random.default_rng(0)
    x = rnd.zipf(1.3, 20_000) % 49408
    bad = bytearray(idcoder.encode(x, 4096))
    bad[-2000] ^= 255
    with pytest.raises(ValueError):
        back(bytes(bad))


def test_files(spark, tmp_path):
    rows = list(enumerate(ODD)) + [(100 + d, f"some words {d} again and again.") for d in range(300)] + [(100, "some words")]
    df = spark.createDataFrame([(t, d, 0) for d, t in rows], "text string, doc_id long, start int")
    at = f"file://{tmp_path}/ids"
    token_files.write(df, at, tokens.public_path(), segment=5000)
    got = token_files.read(spark, at).collect()
    want = sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ((d, [*plain(t), 1]) for d, t in rows))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: (r.start)):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(d for d, _ in rows)


def test_no_documents(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", tokens.public_path())
    assert token_files.read(spark, f"{tmp_path}/none").collect() == []
