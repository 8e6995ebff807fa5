import random
import re
from itertools import combinations

import pytest
import xxhash
from panelspark.llm import simhash as S


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, prints, radius=3):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, p), (j, q) in combinations(zip(ids, prints), 2):
        if (p ^ q).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 3])
def test_masks_cover(radius):
    rnd = random.Random(0)
    masks = S.covering((1 << 64) - 1, radius)
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(m & d == 0 for m in masks)
    for free in (0b1111, 0xFF00FF, 0x8000000000000001 | 0b1110):
        assert all(0 < m and m | free == free for m in S.covering(free, 3))


def test_fingerprints():
    for t in ["", None, "a", "A b", "Ärger ÄB cd \x0b ef\x1cgh", "x y z " * 50, "one Two three four five"]:
        assert S.fingerprint(None if t is None else t.encode()) == plain_print(t)


def nodes(spark, prints):
    return spark.createDataFrame([(S._signed(p), i) for i, p in enumerate(prints)], "fp long, node long")


@pytest.mark.parametrize("bucket", [4, 1024])
def test_links_give_all_components(spark, bucket):
    """Random families, chains, and buckets so full that they are covered again and again."""
    rnd = random.Random(bucket)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 25])):
            prints.add(base)
            x = base
            for b in rnd.sample(range(64), rnd.randrange(8)):
                x ^= 1 << b
            prints.add(x)
            base = x if rnd.random() < 0.1 else base
    base = rnd.getrandbits(64)
    prints |= {base ^ d for d in range(16)} | {base ^ (1 << 60) ^ (d << 30) for d in range(8)}
    prints = sorted(prints)
    edges = S.links(nodes(spark, prints), bucket=bucket)
    got = {r.node: r.root for r in S.C.components(edges).collect()}
    want = brute(range(len(prints)), prints)
    assert {i: got.get(i, i) for i in range(len(prints))} == want
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 3 for r in edges.collect())


def test_groups(spark):
    rnd = random.Random(2)
    words = [str(i) for i in range(500)]
    rows = []
    for d in range(40):
        w = rnd.choices(words, k=200)
        rows.append((d * 3, " ".join(w)))
        w[5] = "changed"
        rows.append((d * 3 + 1, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "tiny"), (2, "TINY"), (0, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.groups(df).collect()), key=str)
    prints = [plain_print(t) for _, t in rows]
    ids = list(range(len(rows)))
    comp = brute([i for i in ids if rows[i][0] is not None], [p for i, p in zip(ids, prints) if rows[i][0] is not None])
    least = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, 1 << 60), rows[i][0])
    want = sorted(((rows[i][0], prints[i], least[comp[i if i in comp else 0]]) for i in ids), key=str)
    assert got == want
    assert S.groups(df.limit(0)).collect() == []
