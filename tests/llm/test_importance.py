"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from panelspark.llm import importance as I

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall(re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, longest=1, buckets=10000, percent=10, least=20, seed=2024):
    of = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, runs(text, longest)[0]))
    for text in target:
        t.update(map(of, runs(text, longest)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in set(s) | set(t)}
    out = []
    for d, text in docs:
        found, n = runs(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[of(f)] for f in found)
        out.append([d, n, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    draw = len(able) * percent // 100
    rank = {id(r): i + 1 for i, r in enumerate(able[:draw])}
    return [(d, f, w, score, rank.get(id(r))) for r in out for d, _, f, w, score in [r]]


def key(r):
    return tuple((x is None, x) for x in r)


def made(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "naïve", "it's", "A1-b2", "日本", "\x7f", "ÀB"]
    docs = [(d, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 5, 19, 20, 60, 200])))) for d in range(n)]
    docs += [(None, "alone here with words " * 8), (n, None), (n + 1, ""), (n + 2, "...!?"), (n + 3, "Same Word " * 30_000)]
    docs += [(n + 4, docs[5][1] + " extra")] + [(n + 10 + k, "a copy of one text that many documents hold, in all " * 3) for k in range(90)]
    rnd.shuffle(docs)
    return docs, [" ".join(rnd.choices(vocabulary[:60], k=50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("longest,buckets,block", [(1, 10000, 4_000_000), (2, 97, 3000), (1, 3, 200)])
def test_equals_brute_force(spark, monkeypatch, longest, buckets, block):
    monkeypatch.setattr(I, "BLOCK_BYTES", block)
    monkeypatch.setattr(I, "HELD_POSTINGS", 50 if block == 200 else 4_000_000)
    docs, target = made(longest)
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, bucket string, block int, rank long").repartition(3)
    got = I.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, target, longest, buckets), key=key)


def test_repeats_and_empty_tables(spark):
    schema, target = "doc_id long, text string", spark.createDataFrame([("one two",)], "text string")
    text = " ".join(f"w{i}" for i in range(25))
    twice = I.resample(spark.createDataFrame([(1, text)] * 10 + [(1, text + " w")] * 10, schema), target).collect()
    assert sorted(r["rank"] for r in twice if r["rank"]) == [1, 2] and len(twice) == 20
    assert I.resample(spark.createDataFrame([], schema), target).collect() == []
    alone = I.resample(spark.createDataFrame([(1, text)], schema), target.limit(0)).collect()
    assert [(r.n_features, r["rank"]) for r in alone] == [(25, None)]
