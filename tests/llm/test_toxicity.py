"""The toxicity grammar: its machine against the parts, learning from labels, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from panelspark.llm import toxicity as T

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, clauses int"


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_composition_equals_its_machines():
    after, gives = T.composed()
    rnd = random.Random(3)
    state, parts = 0, (0,) * len(T.MACHINES)
    seen = set()
    for _ in range(5000):
        s = rnd.randrange(T.SYMBOLS)
        assert gives[state * T.SYMBOLS + s] == T.emitted(parts, s)
        seen.add(gives[state * T.SYMBOLS + s])
        parts = tuple(m(x, s) for m, x in zip(T.MACHINES, parts))
        state = after[state * T.SYMBOLS + s]
    assert seen == {-1, *range(T.LATE + 1)}


def pattern(kind, target, negated, told):
    return T.PATTERNS.index((kind, target, negated, told))


@pytest.mark.parametrize(
    "text,want",
    [
        ("You are an idiot.", {pattern(T.INSULT, 1, 0, 0): 1}),
        ("You are not an idiot.", {pattern(T.INSULT, 1, 1, 0): 1}),
        ('Someone said "idiot" once.', {pattern(T.INSULT, 0, 0, 1): 1}),
        ("Idiot, idiot idiot! What an IDIOT", {pattern(T.INSULT, 0, 0, 0): 3}),
        ("idiot, that is you", {pattern(T.INSULT, 0, 0, 0): 1}),
        ("what an idiot he is", {pattern(T.INSULT, 0, 0, 0): 1, T.LATE: 1}),
        ("I will kill. you. I will hurt you", {pattern(T.THREAT, 0, 0, 0): 2, T.LATE: 1}),
        ("kind words", {}),
        ("", {}),
        (None, {}),
        ("id***iot!!! IDIOT*** 123", {pattern(T.INSULT, 0, 0, 0): 1}),
    ],
)
def test_clauses(text, want):
    counts = T.Grammar({"idiot"}).counts(None if text is None else text.encode())
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == want


def test_negation_and_reporting_excuse_by_default():
    g = T.Grammar({"idiot"})
    plain, targeted, negated, told = (float(g.score(g.counts(t)[None])[0]) for t in (b"an idiot.", b"you idiot.", b"not an idiot.", b"he wrote of one. she said idiot."))
    assert targeted > plain > negated and plain > told


def made(seed=5, n=900):
    """Documents with an insult of an invented language, near copies of toxic ones, and negations that excuse."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmn", k=rnd.randrange(2, 8))) for _ in range(300)]
    out, labels = [], []
    for d in range(n):
        text = rnd.choices(words, k=rnd.randrange(5, 80))
        kind = rnd.random()
        toxic = int(kind < 0.15)
        for _ in range(2 if toxic else 0):
            text.insert(rnd.randrange(len(text)), "zqx" + rnd.choice(["orum", "ia", "ett"]))
        if kind > 0.95:  # excused
            text[2:2] = ["not", "zqxorum"]
        out.append((d, " ".join(text), "xx", 0.5, 1))
        labels.append((d, 1, toxic))
    copied = next(o for o, x in zip(out, labels) if x[2] and not held(o[0]) and len(o[1]) > 200)
    for d in range(n, n + 60):
        out.append((d, copied[1] + " " + words[d % 9], "xx", 0.5, 1))
        labels.append((d, 1, 1))
    return out, labels, copied


def test_learns_a_stem_and_what_excuses(spark):
    docs, labels, copied = made()
    docs += [(None, "zqxia zqxia", None, None, None), (5000, None, None, None, None), (5001, "", None, None, None), (5002, "zqxett " * 40_000, None, None, None)]
    labels += [(7, 1, None), (7777, 1, 1), (None, 1, 1)]
    df, ls = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = T.learn(df, ls)
    own = g.stems - set(T.INSULTS.split())
    # copies of one toxic document teach no word of it
    assert own and all(s.startswith("zqx") for s in own)
    got = {r.doc_id: r for r in T.score(df.select("doc_id", "text"), g).collect()}
    truth = {d: t for d, _, t in labels if t is not None and d is not None and d in got}
    wrong = [d for d in truth if held(d) and (got[d]["score"] >= T.THRESHOLD) != truth[d]]
    assert len(wrong) <= 2 and sum(held(d) for d in truth) > 150
    assert got[None]["score"] >= T.THRESHOLD and got[5002]["score"] > 0.9
    assert got[5000]["score"] == got[5001]["score"] < T.THRESHOLD
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_that_are_held_out_teach_nothing(spark):
    docs, labels, _ = made(6, 300)
    ls = spark.createDataFrame([x for x in labels if not held(x[0])], "doc_id long, quality int, toxic int")
    all_ = spark.createDataFrame([x if not held(x[0]) else (x[0], x[1], 1 - x[2]) for x in labels], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, SCHEMA)
    a, b = T.learn(df, ls), T.learn(df, all_)
    assert a.stems == b.stems and np.allclose(a.weights, b.weights)


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "you idiot", None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.learn(df, none).stems == set(T.INSULTS.split())
    g = T.learn(df.limit(0), none)
    assert T.score(df.select("doc_id", "text").limit(0), g).collect() == []
    assert T.score(df.select("doc_id", "text"), g).collect()[0]["score"] > T.THRESHOLD


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in T.op11_toxicity(spark, SMALL).collect()}
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert got.keys() == docs.keys() and all(r.predicted == int(r["score"] >= 0.3) and r.held_out == held(d) for d, r in got.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if held(r.doc_id)]
    # too few examples in the other languages to learn from here
    english = [(got[d].predicted, t) for d, t in labels if docs[d] == "en"]
    assert sum(p == t for p, t in english) >= 0.95 * len(english)
    assert sum(p for p, t in english if t) >= 0.75 * sum(t for _, t in english)
