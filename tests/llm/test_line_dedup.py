import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelspark.llm import line_dedup as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


pairs = st.lists(st.tuples(st.binary(max_size=9).map(lambda x: bytes(c % 3 + 97 for c in x)), st.binary(max_size=9).map(lambda x: bytes(c % 3 + 97 for c in x))), min_size=1, max_size=30)


@given(pairs, st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_banded_distance(ab, edits):
    a, b = [x for x, _ in ab], [y for _, y in ab]
    assert D.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in ab]
    gaps = D.sketch_gap(np.array([D.sketch(x) for x in a]), np.array([D.sketch(y) for y in b]))
    assert all(g <= 2 * distance(x, y) for g, (x, y) in zip(gaps.tolist(), ab))


@given(st.binary(min_size=4, max_size=14).map(lambda x: bytes(c % 2 + 97 for c in x)), st.data(), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_windows_find_a_segment(line, data, edits):
    other = bytearray(line)
    for _ in range(data.draw(st.integers(0, edits))):
        at = data.draw(st.integers(0, len(other)))
        kind = data.draw(st.integers(0, 2))
        if kind == 0 or at == len(other):
            other.insert(at, data.draw(st.sampled_from(b"abc")))
        elif kind == 1:
            del other[at]
        else:
            other[at] = data.draw(st.sampled_from(b"abc"))
    long, short = sorted([bytes(line), bytes(other)], key=len, reverse=True)
    if len(short) > edits:
        segs = D.segments(len(short), edits)
        assert any(long[p : p + size] == short[segs[i][0] : segs[i][0] + size] for i, size, lo, hi in D.windows(len(long), len(short), edits) for p in range(lo, hi + 1))


def brute(rows, edits, least):
    import xxhash

    every = []
    for d, t in rows:
        key = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
        key -= (1 << 64) * (key >> 63)
        every.append([((d if d is not None else D.NO_ID, key, i), x.encode()) for i, x in enumerate(t.split("\n"))] if t is not None else [])
    flat = sorted({x for doc in every for x in doc if x[1] and not x[1].isspace()})
    gone = set()
    for i, (p, x) in enumerate(flat):
        if any(q < p and (x == y or (min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits)) for q, y in flat[:i]):
            gone.add(p)
    return [(d, None if t is None else "\n".join(x.decode() for p, x in doc if p not in gone)) for (d, t), doc in zip(rows, every)]


@pytest.mark.parametrize("edits,first,block", [(2, 4, 256), (1, 1, 256), (2, 1, 4)])
def test_matches_brute_force(spark, monkeypatch, edits, first, block):
    monkeypatch.setattr(D, "BLOCK_LINES", block)
    rnd = random.Random(edits)
    base = ["".join(rnd.choices("abcdefg é", k=rnd.randrange(12, 40))) for _ in range(12)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(rnd.randrange(0, 5)):
            x = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                x[rnd.randrange(len(x))] = rnd.choice("xyz") * rnd.randrange(3)
            out.append("".join(x))
        rows.append((d, "\n".join(out)))
    rows += [(3, rows[5][1]), (100, None), (101, ""), (102, "\n\n"), (None, base[0] + "\nshort"), (5, rows[5][1])]
    rows += [(103, "short\n  \nshort\nshorn"), (104, "  \nshort\n\n  ")]  # short lines: equal ones go, blank ones never do
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, h string, line int")
    got = D.dedup(df, edits=edits, least=10, first=first).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute(rows, edits, 10), key=key)
    for r in got:
        assert r.h == "k" and r.n_lines == (0 if r.text is None else r.n_lines)


def test_dense_groups(spark):
    """Lines that are all close to each other, and lines that share all but one segment and are not."""
    rows = [(d, f"a line that is found all over the place, number {d:03d} of a thousand") for d in range(120)]
    rows += [(d, "some long beginning of a line that many share " + "".join(random.Random(d).choices("qrstuv", k=12)) + " and its end too") for d in range(200, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in D.dedup(df).collect())
    assert got == sorted(brute(rows, 2, 16))


def test_rows_of_a_dense_group_are_linear(spark, monkeypatch):
    """Lines that share all but one segment and are far apart: each names few partners, and blocks give back what is settled only."""
    monkeypatch.setattr(D, "BLOCK_LINES", 32)
    for n in (40, 160):
        rows = [(d, "some long beginning of a line that many share " + "".join(random.Random(d).sample("qrstuvwxyz", 10)) + " and its end too") for d in range(n)]
        named = []
        real = D.candidates
        monkeypatch.setattr(D, "candidates", lambda *a, real=real, named=named: named.append(real(*a)) or named[-1])
        got = D.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        monkeypatch.setattr(D, "candidates", real)
        assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows, 2, 16))
        # three entries of a line, each with FIRST partners at most
        assert named[0].count() <= 3 * D.FIRST * n


def test_no_rows(spark):
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("batch", ["2", "3"])
def test_meetings_across_batches(spark, batch):
    rnd = random.Random(int(batch))
    rows = [(rnd.randrange(12), rnd.randrange(4), rnd.randrange(3) + rnd.choice([0, D._PROBE])) for _ in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in D.meetings(spark.createDataFrame(rows, "key long, h long, s int")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key in range(12):
        mine = [r for r in rows if r[0] == key]
        if len({r[1] for r in mine}) > 1 and any(r[2] < D._PROBE for r in mine):
            want |= set(mine)
    # rows of the first line seen may be left out but for one
    assert got <= want and {(k, h) for k, h, _ in got} == {(k, h) for k, h, _ in want}
