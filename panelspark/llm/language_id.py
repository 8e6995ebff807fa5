"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of order 0 to 3 counts what follows each
context. A byte seen in a context costs -log2(count / (total + distinct)); the
rest of the probability, distinct / (total + distinct), is the escape to the next shorter
context, where bytes that the longer one offers are excluded. Below order 0 all 256 bytes are alike. The
statistics are frozen after training, so every byte's exact code length is known
in advance and a text's cost is a sum of table look-ups. A text gets the language with the
shortest code; its score is that language's share of 2**-length over all languages. A-Z are taken in lower case.

Training reads a bounded sample, `rows_per_language` labelled rows of each
language (lowest hashes of doc_id, then text); the trees are counted by Spark. What reaches the driver and the workers are the
counts of the byte 4-grams of these rows. A worker unfolds them, language by language, into one row of
costs for each context that was seen and one column for each byte that was seen, with one more for all bytes that were not, which are alike.
So memory grows with the contexts of a language and in proportion to the number of languages, whose order stays 3.

Edge cases: a null text, one without a letter, and any text when nothing was
learned are `und` with score 0; rows with a null id or label are never learned from;
ties go to the language first in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

ROWS_PER_LANGUAGE = 600
#: The hashes of the rows of a language are counted in 2**BUCKET_BITS buckets.
BUCKET_BITS = 16
ORDER, BYTES = 3, 256
#: Bytes of text looked up at once.
PIECE = 1 << 18
_ASCII = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """(lang, text): the rows to learn from.

    Counts by language and bucket of the hash of doc_id tell the last bucket needed, so that only
    the few rows up to it are ranked in one task for each language, however many rows a language has.
    """
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    able = able.select("lang", "text", F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))
    sizes = able.groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")) - F.col("n"))
    last = before.filter(F.col("before") < rows_per_language).groupBy("lang").agg(F.max("bucket").alias("last"))
    # one row for each language
    few = able.join(F.broadcast(last), "lang").filter("bucket <= last").withColumn("t", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    return few.withColumn("r", rank).filter(F.col("r") <= rows_per_language).select("lang", "text")


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, ORDER spaces before each, in lower case; where each text starts and ends."""
    gap = b" " * ORDER
    n = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(n + ORDER)
    return np.frombuffer((gap + gap.join(texts)).lower(), np.uint8), end - n, end


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts with the ORDER bytes before it, as one number, and how often it occurs."""
    whole, start, end = laid_out(texts)
    code = np.zeros(len(whole), np.int64)
    for k in range(ORDER + 1):
        code[k:] |= whole[: len(whole) - k].astype(np.int64) << (8 * k)
    inside = np.zeros(len(code) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    return np.unique(code[np.cumsum(inside[:-1]) > 0], return_counts=True)


class Tree:
    """Code lengths of one language, unfolded from the counts of its byte 4-grams."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        seen = np.unique(code & 255)
        #: bytes never seen share the last column
        self.column = np.full(BYTES, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        self.width = w = len(seen) + 1
        # bytes that occur only before others are in a column of their own kind too: contexts hold bytes, not columns
        levels = []  # by order: contexts, costs' rows
        p = np.full((1, w), 1 / BYTES)
        contexts = np.zeros(1, np.int64)
        for k in range(ORDER + 1):
            mine, at = np.unique(code >> 8 & ((1 << 8 * k) - 1), return_inverse=True)
            c = np.zeros((len(mine), w))
            np.add.at(c, (at, self.column[code & 255]), count)
            shorter = np.searchsorted(contexts, mine & ((1 << 8 * max(0, k - 1)) - 1))
            p, contexts = _escaped(c, p[shorter]), mine
            levels.append((mine, p))
        base = np.cumsum([0, *(len(m) for m, _ in levels)])
        self.costs = -np.log2(np.concatenate([p for _, p in levels])).reshape(-1)
        (one, two, three), (b1, b2, b3) = (m for m, _ in levels[1:]), base[1:4]
        # by the last two bytes: the row of their longest context
        every = np.arange(BYTES)
        short = np.zeros(BYTES, np.int64)
        short[one] = b1 + np.arange(len(one))
        pairs = np.broadcast_to(short, (BYTES, BYTES)).copy()
        pairs[two >> 8, two & 255] = b2 + np.arange(len(two))
        # by the two bytes before the last: a line of rows, own ones where a longer context was seen, else that of the second
        heads, head = np.unique(three >> 8, return_inverse=True)
        self.line = np.broadcast_to(every, (BYTES, BYTES)).reshape(-1).copy()
        self.line[heads] = BYTES + np.arange(len(heads))
        rows = np.concatenate([pairs, pairs[heads & 255]])
        rows[BYTES + head, three & 255] = b3 + np.arange(len(three))
        self.rows = (rows * w).reshape(-1).astype(np.int32)
        self.line = (self.line << 8).astype(np.int32)

    def bits(self, whole: np.ndarray) -> np.ndarray:
        """Code length of every byte after the first ORDER ones."""
        x = whole.astype(np.int32)
        line = self.line[x[:-3] << 8 | x[1:-2]]
        line |= x[2:-1]
        return self.costs[self.rows[line] + self.column[x[3:]]]


def _escaped(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of contexts with the counts c, and those of their shorter contexts, p, where they escape. The last column stands for all bytes never seen."""
    seen = c > 0
    alike = np.ones(c.shape[1])
    alike[-1] = BYTES + 1 - c.shape[1]
    distinct = seen.sum(axis=1, keepdims=True)
    escape = np.where(distinct < BYTES, distinct, 0)
    total = c.sum(axis=1, keepdims=True) + escape
    rest = (p * ~seen * alike).sum(axis=1, keepdims=True)
    return np.where(seen, c / total, p * (escape / total / np.where(rest > 0, rest, 1)))


class Model:
    """Languages and the counts of their byte 4-grams; unfolds on the workers."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.counts = languages, counts
        self.trees: list[Tree] | None = None

    def __reduce__(self):
        # what is unfolded stays where it is; a worker drops it with the first task that doesn't use the broadcast
        return Model, (self.languages, self.counts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        if self.trees is None:
            self.trees = [Tree(*c) for c in self.counts]
        whole, start, end = laid_out(texts)
        out = np.zeros((len(texts), len(self.trees)))
        for low in range(ORDER, len(whole), PIECE):
            high = min(len(whole), low + PIECE)
            # the texts with bytes in this piece; the spaces between them belong to none
            first, last = int(np.searchsorted(end, low, "right")), int(np.searchsorted(start, high))
            a, b = np.maximum(start[first:last], low), np.minimum(end[first:last], high)
            edges = np.stack([a, b], axis=1).reshape(-1) - low
            some = np.flatnonzero(a < b)
            for k, tree in enumerate(self.trees):
                bits = np.append(tree.bits(whole[low - ORDER : high]), 0.0)
                sums = np.add.reduceat(bits, edges)[::2] if len(edges) else np.zeros(0)
                out[first + some, k] += sums[some]
        return out


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    rows = C.cut(sample(docs, rows_per_language), "labelled")

    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, most=1_000_000):
            langs, texts = C.column(b, "lang"), C.texts(b)
            for lang in sorted(set(langs)):
                code, n = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    table = rows.mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    place = {x: k for k, x in enumerate(languages)}
    language = np.array([place[x] for x in table["lang"].to_pylist()], np.int32)
    code, n = table["code"].to_numpy(), table["n"].to_numpy()
    turn = np.lexsort((code, language))
    cuts = np.searchsorted(language[turn], np.arange(1, len(languages)))
    return Model(languages, list(zip(np.split(code[turn], cuts), np.split(n[turn], cuts), strict=True)))


PREDICTION = "lang_pred string, score double, bits_per_byte double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (of the best language; null for `und`) after its columns; reads `text` alone."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in C.slices(batches):
            texts = C.texts(b)
            fit = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            lang, score, per_byte = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if fit:
                bits = model.score([texts[i] for i in fit])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(fit)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                for i, k, s, n in zip(fit, best.tolist(), share.tolist(), least.tolist(), strict=True):
                    lang[i], score[i], per_byte[i] = model.languages[k], s, n / len(texts[i])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score), pa.array(per_byte, pa.float64())], [*names, "lang_pred", "score", "bits_per_byte"])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kept}, {PREDICTION}")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
