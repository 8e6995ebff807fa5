"""The conversation trie against a plain one, and its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from panelspark.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, node int, parent string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].add(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    saved = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        ids = ",".join(map(str, sorted(ends[n])))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), sum(not kids[x] for x in below), sum(saved[x] for x in below), hashlib.sha256(ids.encode()).hexdigest()))
    return out


def made(seed, convs=70):
    rnd = random.Random(seed)
    lines = ["hello there", "how are  you", "", None, "a\tb\nc", "ünï çé", "x" * 5000, "yes"]
    out = []
    for c in rnd.sample(range(-45, 130), convs):
        for k in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            turn = rnd.choice([k, k, k, None, 1])
            out.append((c, turn, rnd.choice(["user", "bot", None]), rnd.choice(lines[:3] if rnd.random() < 0.6 else lines), 7, "clash"))
    out += [(None, 0, "user", "no conversation", 1, None)] * 2 + out[:9]
    # copies of a conversation, and a long one
    out += [(200 + k, t, "user", f"copy {t}", 0, None) for k in range(15) for t in range(4)]
    out += [(300, t, "user", f"turn {t}", 0, None) for t in range(400)] + [(301, t, "user", f"turn {t}", 0, None) for t in range(350)]
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in T.trie(df).drop("preorder", "end").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_preorder_intervals(spark):
    got = T.trie(spark.createDataFrame(made(3), SCHEMA)).collect()
    place = {r.preorder: r for r in got}
    assert sorted(place) == list(range(1, len(got) + 1)) and place[1].depth == 0 and place[1].end == len(got)
    for p in range(2, len(got) + 1):
        # in preorder a node follows its parent's subtree or goes one down
        assert place[p].depth <= place[p - 1].depth + 1
        after = next((q for q in range(p + 1, len(got) + 1) if place[q].depth <= place[p].depth), len(got) + 1)
        assert place[p].end == after - 1


def test_sql(spark):
    rows = made(4)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    found = con.execute(T.OP12_SQL)
    names = [d[0] for d in found.description]
    got = T.trie(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(found.fetchall(), key=key)


def test_no_rows_and_turnless(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # 21 starts with three turns of 20, which isn't there, and has none of its own after them
    c = next(c for c in range(21, 39) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, t, "user", "hi", 0, None) for t in range(2)]
    assert [tuple(r) for r in T.trie(spark.createDataFrame(rows, SCHEMA)).drop("preorder", "end").collect()] == brute(rows)
