import hashlib
import random
import re

import pytest
from panelspark.llm import substring_dedup as S


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


SCHEMA = "text string, doc_id long, lang string, start string, end string, anchor string"


def ours(spark, rows, **kw):
    df = spark.createDataFrame([(t, d, None, "x", "y", "z") for d, t in rows], SCHEMA)
    return sorted(tuple(r) for r in S.dedup(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 200))] for _ in range(12)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randrange(0, 4)):
            part = list(rnd.choice(base))
            a = rnd.randrange(len(part))
            part = part[a : a + rnd.randrange(1, 120)]
            if rnd.random() < 0.5:
                part[rnd.randrange(len(part))] = "changedé"
            w += part
        rows.append((rnd.randrange(0, 50), rnd.choice([" ", "\n", "\t \x0b"]).join(w) if rnd.random() > 0.05 else None))
    rows += [rows[0], (7, "same " * 300), (8, "same " * 200), (9, ""), (10, None)]
    assert ours(spark, rows) == brute(rows, 50)
    assert ours(spark, rows, window=20, gram=6) == brute(rows, 20)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    rnd = random.Random(5)
    long = [str(rnd.randrange(1000)) for _ in range(500)]
    rows = [(1, " ".join(long)), (2, " ".join(["x"] * 13 + long)), (3, " ".join(long[77:300] + ["q"] + long[300:420]))]
    one = sorted(brute(rows, 50))
    out = []
    for d, t in rows:
        w = t.encode().split()
        out += [(int(f), int(n)) for x in S.blocks_of(w, 50, 12) for f, n in zip(x[0], x[1])]
    assert sum(n for _, n in out) == sum(len(t.split()) - 49 for _, t in rows)
    assert ours(spark, rows) == one


def test_empty_and_null_ids(spark):
    assert ours(spark, []) == []
    t = " ".join(map(str, range(60)))
    got = S.dedup(spark.createDataFrame([(None, t), (3, t), (None, t)], "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == [(3, 0), (None, 60), (None, 60)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_factors_give_the_documents_back(spark):
    rnd = random.Random(11)
    base = [[str(rnd.randrange(5000)) for _ in range(rnd.randrange(60, 400))] for _ in range(6)]
    texts = {}
    for d in range(40):
        w = []
        for _ in range(3):
            part = rnd.choice(base)
            a = rnd.randrange(len(part) - 30)
            w += part[a : a + rnd.randrange(30, 300)] + ["own%d" % rnd.randrange(9)] * rnd.randrange(3)
        texts[d] = w
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    seen = 0
    for r in S.dedup(df).collect():
        kept, out = iter(words_of(r.kept)), []
        for f in r.factors:
            assert f.ref_doc < r.doc_id and f.start >= len(out)
            out += [next(kept) for _ in range(f.start - len(out))]
            out += texts[f.ref_doc][f.ref_start : f.ref_start + f.end - f.start]
            seen += 1
        assert out + list(kept) == texts[r.doc_id]
    assert seen > 40


def test_factors_are_the_longest(spark):
    rnd = random.Random(3)
    w = [str(rnd.randrange(10**6)) for _ in range(500)]
    rows = [(1, w), (2, ["x"] * 13 + w[20:200] + ["y"]), (3, w[77:300] + ["q"] + w[300:420]), (4, w[400:449]), (5, w[400:500] + w[0:100])]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in S.dedup(df).collect()}
    assert got == {1: [], 2: [(13, 193, 1, 20)], 3: [(0, 223, 1, 77), (224, 344, 1, 300)], 4: [], 5: [(0, 100, 1, 400), (100, 200, 1, 0)]}


def test_parse_takes_the_farthest_and_goes_on_at_the_boundary():
    np = pytest.importorskip("numpy")
    a = [np.array(x) for x in ([0, 5, 3, 30], [5, 5, 20, 1], [1, 1, 2, 1], [100, 105, 0, 7])]
    assert S.parse(*a, 10) == [(0, 19, 1, 100), (19, 32, 2, 16), (32, 40, 1, 9)]
    assert S.parse(*(x[:0] for x in a), 10) == []
