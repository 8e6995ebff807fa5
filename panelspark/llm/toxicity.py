"""Toxicity by a weighted finite-state pattern grammar.

A tagger turns a text into symbols: insults, threats, targets, negations, reporting verbs, quotes, ends of clauses and of sentences, other words. Four small
machines read them side by side: how far back the last target lies, whether a negation reaches here, whether what is said is reported
or quoted, whether an insult still waits for its target. Their composition is one machine whose arcs give patterns: an insult or a
threat, with a target or not, negated or not, reported or not, and a target that comes late. A document counts the clauses in which each pattern
is found; its score is the logistic function of a bias and the patterns' weights times the logarithms of one plus their counts. So a word counts by its clause, not by itself.

What is learned, from labelled rows that are not held out:
* stems of insults: prefixes of words (STEM letters) that are much more common in toxic documents, and suspect ones, of which that holds only where they occur
  twice or more in a document: their words count from the second on, wherever they stand. Stems are taken one by one, each time the one that
  adds most; a document counts half for each stem that it has already, and near copies (equal minima of hashed shingles) count as one,
  so that words which toxic documents share by being copies aren't taken. They join a short list of common insults.
* the patterns' weights: logistic regression drawn towards prior weights, in which negation and reporting excuse; what data shows otherwise overrides it.
The sample is bounded: `rows_per_label` labelled documents of each label, lowest hashes of ids. What reaches the driver are the counts of stems that pass and
vectors of patterns of these rows. Labels and ids play no part in scoring; any letters may be learned, in any language.

Edge cases: a null or empty text, one without words, has the score of no pattern; a null label is none, of several labels of an id the largest
counts; a null id is never learned from and not held out; repeated rows score alike; without labels the prior weights and the list alone
decide; no rows give none. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .language_id import held_out

ROWS_PER_LABEL = 3000
THRESHOLD = 0.3
BUCKET_BITS = 16
#: Letters of a stem; documents that it needs, near copies being one; how much commoner it must be in toxic ones; what it must add.
STEM, SUPPORT, LOG_ODDS, ADDS = (3, 9), 4.0, 3.0, 2.0
SHINGLE = 5
KEPT_WORDS = 500_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SUSPECT, QUOTE, CLAUSE, SENTENCE = range(10)
SYMBOLS = 10
#: Common words of each kind in four languages.
INSULTS = "idiot moron stupid loser scum dumb fool jerk trash pathetic worthless disgusting trottel arschloch abschaum dummkopf imbécile crétin abruti connard imbécil estúpido idiota basura"
THREATS = "kill murder hurt destroy shoot stab umbringen töten verprügeln tuer massacrer matar matarte golpear"
TARGETS = "you your yours he she they him her them people du dich dir euch ihr sie tu toi vous elle ils elles tú usted ustedes ella ellos ellas"
NEGATIONS = "not no never isn't aren't don't doesn't wasn't nicht kein keine nie ne pas jamais no nunca"
REPORTS = "said says wrote writes called calls claimed told quoted sagte schrieb nannte dit écrit déclaré dijo dice escribió llamó"
_KNOWN = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INSULT, INSULTS)) for w in words.split()}
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]|[,;:]|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")

NEAR_TARGET, NEGATED_FOR, WAITS = 4, 3, 3


def scope(on: tuple[int, ...], reach: int, ends: tuple[int, ...]) -> Callable[[int, int], int]:
    """A machine that remembers for `reach` symbols that one of `on` was read, or until one of `ends`."""
    return lambda state, symbol: reach if symbol in on else 0 if symbol in ends else max(0, state - 1)


def reported(state: int, symbol: int) -> int:
    """1 from a reporting verb to the end of the sentence, 2 within quotes."""
    if symbol == QUOTE:
        return 0 if state == 2 else 2
    if state == 2:
        return 2
    return 1 if symbol == REPORT else 0 if symbol == SENTENCE else state


BREAKS = (CLAUSE, SENTENCE)
# who reports is no target
MACHINES = (scope((TARGET,), NEAR_TARGET, (*BREAKS, REPORT)), scope((NEGATION,), NEGATED_FOR, BREAKS), reported, scope((INSULT, THREAT), WAITS, (*BREAKS, TARGET)))
#: kind, with a target, negated, reported; then the late targets, and suspect words after the first.
PATTERNS = [(k, t, n, r) for k in (INSULT, THREAT) for t in (0, 1) for n in (0, 1) for r in (0, 1)]
LATE, REPEATED = len(PATTERNS), len(PATTERNS) + 1
SIZE = REPEATED + 1
BIAS = -4.0
#: Ends a stem that is only suspect.
WEAK = "+"


def prior() -> np.ndarray:
    """Weights before data: the bias, then the patterns."""
    kinds = [(3.0 if k == INSULT else 1.0) + (2.0 if t else 0.0) - (2.0 if n else 0.0) - (1.5 if r else 0.0) for k, t, n, r in PATTERNS]
    return np.array([BIAS, *kinds, 1.0, 3.0])


def emitted(states: tuple[int, ...], symbol: int) -> int:
    """The pattern that the symbol completes in these states, or -1."""
    target, negated, told, waits = (int(s > 0) for s in states)
    if symbol in (INSULT, THREAT):
        return PATTERNS.index((symbol, target, negated, told))
    return LATE if symbol == TARGET and waits else -1


def composed() -> tuple[list[int], list[int]]:
    """The product of the machines, as far as it is reached: the next state and the pattern, by state * SYMBOLS + symbol."""
    number = {(0,) * len(MACHINES): 0}
    queue, after, gives = list(number), [], []
    for states in queue:
        for symbol in range(SYMBOLS):
            new = tuple(m(s, symbol) for m, s in zip(MACHINES, states, strict=True))
            if new not in number:
                number[new] = len(number)
                queue.append(new)
            after.append(number[new])
            gives.append(emitted(states, symbol))
    return after, gives


class Tagger(dict):
    """Symbols by token: marks, known words, words that begin with a stem."""

    def __init__(self, stems: set[str]):
        super().__init__()
        self.strong, self.weak = {s for s in stems if not s.endswith(WEAK)}, {s[:-1] for s in stems if s.endswith(WEAK)}
        self.lengths = [sorted({len(s) for s in x}) for x in (self.strong, self.weak)]

    def __missing__(self, token: str) -> int:
        if token in ".!?\n":
            out = SENTENCE
        elif token in ",;:":
            out = CLAUSE
        elif token in '"“”«»':
            out = QUOTE
        elif any(token[:n] in self.strong for n in self.lengths[0]):
            out = INSULT
        elif any(token[:n] in self.weak for n in self.lengths[1]):
            out = SUSPECT
        else:
            out = _KNOWN.get(token, OTHER)
        self[token] = out
        return out


class Grammar:
    """A tagger with its stems, the composed machine and the weights."""

    def __init__(self, stems: set[str], weights: np.ndarray | None = None):
        self.stems, self.weights = stems, prior() if weights is None else weights
        self.tagger = Tagger(stems)
        self.after, self.gives = composed()

    def __reduce__(self):
        return Grammar, (self.stems, self.weights)

    def counts(self, text: bytes | None) -> np.ndarray:
        """By pattern, the clauses of a text in which it is found."""
        out = np.zeros(SIZE, np.int64)
        if not text:
            return out
        tagger = self.tagger
        if len(tagger) > KEPT_WORDS:
            tagger.clear()
        symbols = bytes(map(tagger.__getitem__, _TOKENS.findall(text.decode("utf-8", "replace").lower())))
        out[REPEATED] = max(0, symbols.count(SUSPECT) - 1)
        if INSULT not in symbols and THREAT not in symbols:
            return out
        state, found = 0, set()
        for s in symbols:
            at = state * SYMBOLS + s
            state, pattern = self.after[at], self.gives[at]
            if pattern >= 0:
                found.add(pattern)
            if s >= CLAUSE and found:
                out[list(found)] += 1
                found.clear()
        out[list(found)] += 1
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.weights[0] + np.log1p(counts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """(doc_id, text, toxic, stands_for): the documents to learn from, one row for each id; each stands for that many labelled documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    able = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))
    sizes = able.groupBy("toxic", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("toxic")
    before = sizes.withColumn("before", F.sum("n").over(w.orderBy("bucket")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    last = before.filter(F.col("before") < rows_per_label).groupBy("toxic").agg(F.max("bucket").alias("last"), F.max("total").alias("total"))
    # two rows; then at most 2 * rows_per_label of them
    few = able.join(F.broadcast(last), "toxic").filter("bucket <= last").withColumn("r", F.row_number().over(w.orderBy("h", "doc_id"))).filter(F.col("r") <= rows_per_label)
    few = few.select("doc_id", "toxic", (F.col("total") / F.least("total", F.lit(rows_per_label))).alias("stands_for"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    return some.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("stands_for").alias("stands_for"))


def near_copies(text: bytes | None) -> int:
    """The least hash of the text's shingles: near copies have it in common, other texts hardly ever."""
    words = (text or b"").lower().split()
    grams = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return min(map(xxhash.xxh64_intdigest, grams)) - (1 << 63)


def stems_of(text: bytes | None) -> set[str]:
    """The stems of a text's words, and with WEAK at the end those that it has more than once."""
    found: dict[str, int] = {}
    for w, k in Counter(_WORD.findall((text or b"").decode("utf-8", "replace").lower())).items():
        for n in range(STEM[0], min(len(w), STEM[1]) + 1):
            found[w[:n]] = found.get(w[:n], 0) + k
    return found.keys() | {s + WEAK for s, k in found.items() if k > 1}


def candidates(rows: DataFrame, totals: dict[int, float]) -> dict[str, float]:
    """The stems that are commoner in toxic documents, by the documents' weights, and their weight in clean ones. rows(text, toxic, weight): a bounded sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, most=2_000_000):
            sums = (Counter(), Counter())
            for text, toxic, weight in zip(C.texts(b), C.column(b, "toxic"), C.column(b, "weight"), strict=True):
                side = sums[int(toxic > 0)]
                for s in stems_of(text):
                    side[s] += weight
            names = sorted(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([float(sums[1][s]) for s in names]), pa.array([float(sums[0][s]) for s in names])], ["stem", "toxic", "clean"])

    found = rows.select("text", "toxic", "weight").mapInArrow(counted, "stem string, toxic double, clean double").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.ln((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.ln((F.col("clean") + 0.5) / (totals[0] + 1))
    return dict(tuple(r) for r in found.filter((F.col("toxic") >= SUPPORT - 1e-6) & (odds >= LOG_ODDS)).select("stem", "clean").collect())


def taken(having: list[tuple[float, list[str]]], clean: dict[str, float]) -> list[str]:
    """Stems one by one, each the one that adds most to (weight, stems) of toxic documents, less twice its weight in clean ones; on ties the stronger, then the longer one."""
    of: dict[str, list[int]] = {}
    for i, (_, stems) in enumerate(having):
        for s in stems:
            of.setdefault(s, []).append(i)
    worth = np.array([w for w, _ in having])
    left = {s: np.array(docs) for s, docs in of.items()}

    def adds(s: str) -> float:
        return round(float(worth[left[s]].sum()) - 2 * clean.get(s, 0.0), 6)

    out: list[str] = []
    while left:
        best = max(left, key=lambda s: (adds(s), not s.endswith(WEAK), len(s), s))
        if adds(best) < ADDS:
            break
        out.append(best)
        worth[left[best]] /= 2
        core = best.rstrip(WEAK)
        left = {s: docs for s, docs in left.items() if not (s.startswith(core) or core.startswith(s.rstrip(WEAK))) and adds(s) >= ADDS}
    return out


def fitted(counts: np.ndarray, toxic: np.ndarray, weight: np.ndarray, pull: float = 0.3) -> np.ndarray:
    """The weights that maximise the likelihood less `pull` times half the squared distance from the prior, by Newton steps."""
    x = np.column_stack([np.ones(len(counts)), np.log1p(counts)])
    start = prior()
    w, hold = start.copy(), np.full(len(start), pull)
    hold[0] = 0.02
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (weight * (p - toxic)) + hold * (w - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Grammar:
    spark = docs.sparkSession
    rows = C.cut(sample(docs, labels, rows_per_label), "labelled")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(near_copies, C.texts(b)), pa.int64())], ["doc_id", "sig"])

    signs = rows.select("doc_id", "text").mapInArrow(signed, "doc_id long, sig long")
    marked = rows.join(F.broadcast(signs), "doc_id").withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("toxic", "sig")))
    marked = C.cut(marked, "weighed")
    totals = {r[0]: r[1] for r in marked.groupBy((F.col("toxic") > 0).cast("int")).agg(F.sum("weight")).collect()}
    if not totals:
        return Grammar(set(INSULTS.split()))
    clean = candidates(marked, {0: 0.0, 1: 0.0} | totals)
    sent = spark.sparkContext.broadcast(set(clean))

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(stems_of(t) & sent.value) for t in C.texts(b)], pa.list_(pa.string()))], ["weight", "stems"])

    toxic = marked.filter("toxic > 0").select("text", "weight").mapInArrow(having, "weight double, stems array<string>")
    # at most rows_per_label rows; sorted, so that ties don't depend on their order
    stems = taken(sorted((r[0], r[1]) for r in toxic.collect()), clean)
    plain = Grammar({*stems, *INSULTS.split()})
    shipped = spark.sparkContext.broadcast(plain)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([shipped.value.counts(t).tolist() for t in C.texts(b)], pa.list_(pa.int64()))], ["toxic", "weight", "n"])

    seen = marked.select("text", (F.col("toxic") > 0).cast("double").alias("toxic"), (F.col("weight") * F.col("stands_for")).alias("weight")).mapInArrow(vectors, "toxic double, weight double, n array<long>").toArrow()
    weight = seen["weight"].to_numpy()
    counts = np.array(seen["n"].to_pylist(), np.int64).reshape(-1, SIZE)
    return Grammar(plain.stems, fitted(counts, seen["toxic"].to_numpy(), weight * len(weight) / weight.sum()))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with `score` and `clauses` (matched clauses by pattern); reads `text` alone."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            counts = np.array([sent.value.counts(t) for t in C.texts(b)]).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(counts)), pa.array(counts.tolist(), pa.list_(pa.int64()))], [*names, "score", "clauses"])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kept}, score double, clauses array<long>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    grammar = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), grammar)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
