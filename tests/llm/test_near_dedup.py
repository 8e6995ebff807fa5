"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from panelspark.llm import near_dedup as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    """The row that stays of each component of pairs at 0.8 or more: the smallest id, null ids last."""
    sets = [shingles(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return list(groups.values())


@pytest.mark.parametrize("pivots,block", [(N.PIVOTS, N.BLOCK_BYTES), (0, 1 << 16)])
def test_equals_brute_force_jaccard(spark, monkeypatch, pivots, block):
    """As it is, and with all links found in blocks, few classes in each."""
    monkeypatch.setattr(N, "PIVOTS", pivots)
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    monkeypatch.setattr(N, "COLUMNS", 4096 if pivots else 100)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, d = [], 0
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.choice([8, 60, 200, 700]))
        for edits in (0, 0, 1, 2, 4, 6, 9, 14):
            words = list(base)
            for _ in range(min(edits, len(base) // 20)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((d, " ".join(words), "en", rnd.choice("ab"), 5))
            d += 1
    # rows of one id, equal in all or not, null ids, no words
    rows += [(5000, "one two three four five six seven", "en", "a", 1)] * 3 + [(5000, "One two three four five six seven", "en", "b", 1)]
    rows += [(None, "alpha beta gamma delta", "en", "a", 1)] * 2 + [(None, rows[0][1], "en", "a", 1), (6000, None, "en", "a", 1), (6001, " ", "en", "a", 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "").collect()]
    groups = brute(rows)
    assert len(got) == len(groups) < len(rows) - 100
    for g in groups:
        stays = [r for r in g if r in got]
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert len(set(stays)) == 1 and (stays[0][0] is None, stays[0][0] or 0) == least
    assert len(got) == len(set(got))


def test_a_chain_and_a_dense_group_in_one_bucket(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(120):  # neighbours are near, the ends are not
        words[rnd.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words), "en", "a", 1))
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r.doc_id for r in got] == [0]
    assert 5 * len(shingles(rows[0][1]) & shingles(rows[-1][1])) < 4 * len(shingles(rows[0][1]) | shingles(rows[-1][1]))


def test_simhash_finds_candidates_that_are_checked(spark, monkeypatch):
    """Fingerprints within 3 bits link where the similarity is 0.8, with no help of MinHash; below that they don't."""
    rnd = random.Random(8)
    rows = []
    for k in range(30):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
        rows += [(1000 * k + i, " ".join([*words[:i], "x", *words[i + 1 :]] if i else words), "en", "a", 1) for i in (0, 5, 300)]
    # equal fingerprints (a phrase and its repeats outweigh the rest), little in common
    loud = "one two three four five " * 100
    rows += [(10**6 + i, loud + " ".join(f"y{i}-{j}" for j in range(40)), "en", "a", 1) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    printed = N.prints(df.withColumn("row_key", N.F.xxhash64(*df.columns)), N.SHINGLE)
    at = {r.node: (r.fp & (1 << 64) - 1, r.doc_id) for r in printed.collect()}
    pairs = [(r.a, r.b) for r in N.simhash_pairs(printed).collect()]
    assert all(a < b and (at[a][0] ^ at[b][0]).bit_count() <= 3 for a, b in pairs)
    reached = {frozenset((at[a][1], at[b][1])) for a, b in pairs}
    loudest = [p for p in reached if min(p) >= 10**6]
    near_pairs = [p for p in reached if min(p) < 10**6]
    assert loudest and len(near_pairs) >= 10 and all(len({d // 1000 for d in p}) == 1 for p in near_pairs)
    # no class shares a bucket by MinHash
    monkeypatch.setattr(N, "prints", lambda keyed, k, of=N.prints: of(keyed, k).withColumn("bands", N.F.array().cast("array<long>")))
    left = {r.doc_id for r in N.dedup(df).collect()}
    gone = {max(p) for p in near_pairs}
    assert not gone & left and {10**6 + i for i in range(4)} <= left
