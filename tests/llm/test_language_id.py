import math
import random
import zlib

import pytest
from panelspark.llm import language_id as L

A, B = ["the", "and", "house", "when", "which"], ["der", "und", "haus", "wenn", "für"]


def docs(spark, n=200):
    rnd = random.Random(0)
    rows = []
    for d in range(n):
        lang, words = rnd.choice([("en", A), ("de", B)])
        rows.append((d, " ".join(rnd.choices(words, k=rnd.randrange(3, 60))), lang, "s", 1.0))
    rows += [(900, None, "en", "s", 0.0), (901, "", "en", "s", 0.0), (902, "12 34 !?", "de", "s", 0.0), (903, "für " * 50_000, None, None, 0.0), (None, "the and the", "xx", "s", 0.0), (904, "É", "de", None, 0.0), (905, "the und", "en", "s", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def slow_cost(counts, text, order=3):
    """PPM with exclusion, one byte at a time. counts: {context: {byte: n}} for every order."""
    padded = b" " * order + text
    return -sum(math.log2(probability(counts, padded, i, order)[padded[i]]) for i in range(order, len(padded)))


def probability(counts, text, i, k):
    if k < 0:
        return [1 / 256] * 256
    seen = counts.get((k, text[i - k : i]), {})
    lower = probability(counts, text, i, k - 1)
    if not seen:
        return lower
    n, t = sum(seen.values()), len(seen)
    if t == 256:
        return [seen[s] / n for s in range(256)]
    rest = 1 - sum(lower[s] for s in seen)
    return [seen[s] / (n + t) if s in seen else t / (n + t) * lower[s] / rest for s in range(256)]


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_code_lengths_equal_a_plain_ppm(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rnd = random.Random(1)
    train = [bytes(rnd.choices(b"abcd ", weights=[5, 3, 2, 1, 2], k=300)) for _ in range(3)] + [bytes(range(256)) * 2, b"", b"x"]
    for texts in (train[:3], train):
        counts = {}
        for t in texts:
            s = b"   " + t.lower()
            for i in range(3, len(s)):
                for k in range(4):
                    c = counts.setdefault((k, s[i - k : i]), {})
                    c[s[i]] = c.get(s[i], 0) + 1
        model = L.Model(["x", "y"], [L.grams(texts), L.grams([b"q"])])
        asked = [b"q", b"abcABz d", b"", b"zzz", b"dddda", train[0], bytes(range(256))]
        got = model.score(asked)[:, 0]
        for g, t in zip(got, asked):
            assert abs(g - slow_cost(counts, t.lower())) < 1e-6 * (1 + len(t))


def test_many_languages_keep_their_order(spark):
    """Twelve labels: every byte's context is still of three bytes, and rare letters count."""
    rnd = random.Random(3)
    words = {f"l{k:02d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzßéø", k=6)) for _ in range(8)] for k in range(12)}
    rows = [(d, " ".join(rnd.choices(words[f"l{d % 12:02d}"], k=12)), f"l{d % 12:02d}") for d in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(df)
    assert len(model.languages) == 12
    got = {r.doc_id: r.lang_pred for r in L.predict(df.drop("lang"), model).collect()}
    assert all(got[d] == lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 4 == 2)


def test_ties_and_letters(spark):
    """Languages of one text each, the same: the first in order. Number characters are no letters."""
    learned = spark.createDataFrame([(d, "same words here", lang) for d, lang in enumerate(["b", "a", "b", "a", "a", "b", "a", "b"])], "doc_id long, text string, lang string")
    model = L.learn(learned)
    asked = spark.createDataFrame([(1, "same words"), (2, "½ ² ① Ⅷ"), (3, "ʰ"), (4, "漢")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.predict(asked, model).collect()}
    assert got[2] == "und" and {got[3], got[4]} <= {"a", "b"} and got[1] in ("a", "b")
    assert L.predict(asked.limit(0), model).collect() == []


def test_predictions(spark):
    df = docs(spark)
    model = L.learn(df)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in L.predict(df.drop("score"), model).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(got[d].lang_pred == truth[d] for d in held)
    assert [got[d].lang_pred for d in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "de"]
    assert got[900].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    flags = {r.doc_id: r.h for r in df.select("doc_id", L.held_out().alias("h")).collect()}
    assert all(flags[d] == (d in held) for d in range(200)) and flags[None] is False


def test_nothing_to_learn_from(spark):
    df = docs(spark).drop("score")
    assert L.learn(df.limit(0)) is None
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}


def test_labels_are_no_inputs(spark):
    df = docs(spark).drop("score")
    model = L.learn(df)
    swapped = df.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.predict(x, model).collect()} for x in (df, swapped))
    assert a == b
