"""The corpus pipeline, stage by stage, against plain versions; then as a whole."""

import random

import corpus_pipeline
import duckdb
from panelspark.llm import language_id, mixing

from .test_line_dedup import brute as lines_left
from .test_near_dedup import brute as near
from .test_packing import check as packed_well

ENGLISH = ["the", "and", "house", "when", "which", "through", "morning", "people", "Water", "light"]
GERMAN = ["der", "und", "haus", "wenn", "für", "durch", "Morgen", "leute", "wasser", "licht"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(7)
    shared = "this line stands in very many of the documents"
    out = []
    for d in range(60):
        lang, words = rnd.choice([("en", ENGLISH), ("de", GERMAN)])
        made = [" ".join(rnd.choices(words, k=rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 8))]
        if rnd.random() < 0.3:
            made.insert(rnd.randrange(len(made)), shared + rnd.choice(["", "!", "s"]))
        out.append((d, "\n".join(made), rnd.choice([lang, lang, None]), rnd.choice(["hot", "hot", "web", "book", None])))
    short = "\n".join(" ".join(rnd.choices(ENGLISH, k=2))[:15] for _ in range(9))  # lines that line dedup doesn't judge
    out += [(100 + k, short, "en", "hot") for k in range(5)]
    out += [(110, out[3][1], "en", "web"), (111, None, "en", "web"), (112, "", "de", "web"), (113, "12 34\n!?", "en", "hot"), (114, "the house " * 3000, None, "book")]
    # null ids and repeated rows; a text of two languages
    out += [(None, "the house and the people of the morning", "en", "web")] * 2
    out += [(120, "the light of which people and water", "en", "book")] * 2 + [(121, "the house through der Morgen und wasser the", "en", "web")]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


def by_all(rows):
    return sorted(rows, key=str)


def mix_order(rows):
    """The rows' ids in the order of the mix, by the SQL of the schedule."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[3]) for r in rows])
    return [r[0] for r in con.execute(f"select doc_id from ({mixing.OP10_SQL}) order by mix_slot, mix_place").fetchall()]


def test_every_stage_and_all_of_them(spark, tmp_path):
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(before, SCHEMA)
        got_df = stage(spark, df, str(tmp_path))
        assert got_df.columns == df.columns
        got = [tuple(r) for r in got_df.collect()]
        if name == "language_id":
            scored = {r.doc_id: r.score for r in language_id.predict(df, language_id.learn(df)).collect() if r.doc_id is not None}
            want = [r for r in before if any(c.isalpha() for c in r[1] or "") and scored.get(r[0], 1.0) >= corpus_pipeline.LEAST_SCORE]
            assert len(want) < len(before)
        elif name == "line_dedup":
            left = lines_left([(r[0], r[1]) for r in before], 2, 16)
            want = [(r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]) for r, (_, t) in zip(before, left) if t == r[1] or t.split()]
            assert len(want) < len(before) and any(r not in before for r in want)
        elif name == "near_dedup":
            want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in near(before)]
            assert len(want) < len(before)
        else:
            want = before
            assert [r[0] for r in got] == mix_order(before)
        assert by_all(got) == by_all(want), name
        before = want
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    place = {d: i for i, d in enumerate(mix_order(before)) if d is not None}
    # every document lies where the mix puts it, which isn't the order of ids
    packed_well([(r[0], r[1]) for r in before], pieces, place=place)
    assert list(place) != sorted(place)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_documents_in_no_known_language_go(spark, monkeypatch):
    """The cut at LEAST_SCORE: texts whose best language isn't clear enough."""
    rows = [(d, "the house and the people when morning" if d % 2 else "der und haus wenn für durch Morgen", "en" if d % 2 else "de", "s", 5) for d in range(40)]
    rows += [(100, "r", None, "s", 1), (101, "the house", None, "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    scored = {r.doc_id: r.score for r in language_id.predict(df, language_id.learn(df)).collect()}
    cut = (scored[100] + scored[101]) / 2
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", cut)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert kept == {d for d in scored if scored[d] >= cut} and 101 in kept and 100 not in kept


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
