import random
import zlib

import numpy as np
from panelspark.llm import packing as P
from panelspark.llm import tokens


def brute_force(places: list[int], kinds: list[int], size: int) -> float:
    """Least cost by trying every transition."""
    f = {0: 0.0}
    for c, kind in zip(places, kinds, strict=True):
        f[c] = min(f[i] + (0 if c - i in (size, size // 2, size // 4) else size - (c - i)) for i in f if c - i <= size) + P._COST[kind] + P.WINDOW_COST
    return f[places[-1]]


def cost(path: list[int], places: list[int], kinds: list[int], size: int) -> float:
    kind, total, at = dict(zip(places, kinds, strict=True)), 0.0, 0
    for c in path:
        total += (0 if c - at in (size, size // 2, size // 4) else size - (c - at)) + P._COST[kind[c]] + P.WINDOW_COST
        at = c
    return total


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path())
    return t.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "a", "Ça va? <|endoftext|> x<|startoftext|>y", "é é   x y ΑΣ ΣΑΣ", "don't!! stop... I'll; 12345 ½ \x1c z", "word " * 9000, "日本語 text 🙂", "x" * 3000, "Été, ÉTÉ! İstanbul ŉ ǅ straße: ªº µ don't. a.b, .. , Word. wORD word; <|STARTOFTEXT|> A. É? ﬁ ½.", "A\u030angstrom I\u0307 e\u0301t, n\u0303"]


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.public_path(), kept=5)
    for _ in range(2):
        for t in ODD:
            assert e.encode([None if t is None else t.encode()])[0].tolist() == plain(t)
    assert [x.tolist() for x in e.encode([(t or "").encode() for t in ODD])] == [plain(t) for t in ODD]


def test_best_cuts_are_optimal():
    rnd = random.Random(1)
    for _ in range(200):
        size = 64
        places = sorted(rnd.sample(range(1, 400), 60)) + [401, 440, 480]
        places = [p for i, p in enumerate(places)]
        if any(b - a > size for a, b in zip([0, *places], places)):
            continue
        kinds = [rnd.randrange(3) for _ in places]
        got = P.best_cuts(places, kinds, size)
        assert got[-1] == places[-1] and all(b - a <= size for a, b in zip([0, *got], got))
        assert cost(got, places, kinds, size) == brute_force(places, kinds, size)


def check(rows, pieces, size=4096, place=None):
    """Every id lies in one piece, sequences are gapless and in the order of ids or of `place`; the share of padding."""
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*plain(t), 2])
    whole = {d: x[0] for d, x in ids.items()}
    seen = {}
    for p in pieces:
        x = whole[p.doc_id]
        assert p.doc_tokens == len(x)
        part = x[p.start : p.start + p.length]
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
    assert set(seen) == set(whole)
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == len(whole[d])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.doc_id))
    padding = total = 0
    last = -1
    for k in sorted(sequences):
        at = 0
        for o, n, d in sorted(sequences[k]):
            assert o == at
            at += n
            here = d if place is None or d is None else place[d]
            assert d is None or here >= last
            last = last if d is None else here
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / total


def test_pack(spark):
    rnd = random.Random(3)
    rows = list(enumerate(ODD))
    rows += [(d, " ".join(rnd.choice(["the", "and", "house", "a.", "end!", "x,"]) for _ in range(rnd.randrange(3000)))) for d in range(20, 80)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, start string, length int")
    pieces = P.pack(df, tokens.public_path(), horizon=4 * 4096).collect()
    assert check(rows, pieces) < 0.02
    assert P.pack(df.limit(0), tokens.public_path()).collect() == []


def test_no_boundaries_and_repeated_rows(spark):
    rows = [(1, "1" * 20000), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, P.pack(df, tokens.public_path()).collect())
    twice = P.pack(df.union(df), tokens.public_path()).collect()
    assert sum(p.length for p in twice) == 2 * (20001 + 1)
