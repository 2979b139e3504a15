r"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its distinct lower-cased words (`\w+`), a word the bag of
itself and of its character n-grams, marked at the word's ends. Each n-gram has
an embedding of DIM numbers; a word is the mean of its n-grams, a text the mean
of its words, and a softmax over the two classes reads the text. Embeddings and
softmax are trained together in numpy, by full passes with momentum over a
sample. So a misspelling that no label has shown shares most of its vector with
the word it is made of. Each bag also holds EMPTY words that say nothing, so that
a text of a few odd words isn't judged by them alone.

The mean of a bag and the softmax are linear, so in scoring each n-gram is one
number, the product of its embedding with the difference of the classes; n-grams
that the sample doesn't hold say nothing. Those numbers, at most 2^BITS, are
what is broadcast. Distinct words keep a word repeated a thousand times from
filling the bag.

The driver trains on about TOXIC toxic and CLEAN clean labelled documents at
most (expectations, drawn by a hash of the id, the smallest text of an id that
repeats); scores cover all documents, whole. Of conflicting labels of one
document the toxic one counts; null labels aren't labels. A null text is empty,
and a text without words scores as the constant alone says. Rows that repeat
are scored each on its own and alike. Without labels of both kinds every score
is 0; an empty table gives no row. A row without an id is scored and not held
out. Further columns aren't looked at, whatever their names. A text needs memory
for its distinct words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import fold, small, table, tidy

TOXIC, CLEAN = 1_500, 3_000
#: Lengths of n-grams, numbers of an embedding, bits of an n-gram's number.
GRAMS, DIM, BITS = (3, 4, 5), 8, 19
ROUNDS, RATE, MOMENTUM = 200, 0.1, 0.9
#: Words of no meaning in each bag.
EMPTY = 20
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
#: Characters of a text whose words are listed at once.
LISTED = 1 << 20
WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    text = (text or "").lower()
    return set(WORD.findall(text)) if len(text) <= LISTED else {m.group() for m in WORD.finditer(text)}


def grams(word: str) -> Iterator[int]:
    """Numbers of a word and of its n-grams."""
    marked, mask = f"<{word}>", (1 << BITS) - 1
    yield zlib.crc32(marked.encode("utf-8", "replace")) & mask
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            yield zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) & mask


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Classifier:
    """What each n-gram and the constant say for toxic against clean."""

    def __init__(self, numbers: np.ndarray, constant: float, usable: bool = True):
        self.numbers, self.constant, self.usable = numbers, constant, usable

    def of_word(self, word: str) -> float:
        total = n = 0
        for g in grams(word):
            total += float(self.numbers[g])
            n += 1
        return total / n


class Scores(dict):
    """Words to what they say, kept for short ones."""

    def __init__(self, model: Classifier):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self.model.of_word(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = score
        return score

    def text(self, text: str | None) -> float:
        bag = words(text)
        return math.fsum(self[w] for w in bag) / (len(bag) + EMPTY) + self.model.constant


def train(bags: Iterable[list[str]], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Classifier:
    """Fit embeddings and softmax to bags of distinct words; toxic is 1 or 0 for each."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(1 << BITS, np.float32), -30.0, usable=False)
    number: dict[str, int] = {"": 0}
    columns = [np.fromiter((number.setdefault(w, len(number)) for w in bag), np.int32) for bag in bags]
    sizes = np.array([len(c) for c in columns])
    of_doc, of_pair = np.concatenate(columns), np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    share = (1 / (sizes + EMPTY))[of_pair]
    parts = [np.fromiter(grams(w), np.int32) for w in number]
    lengths = np.array([len(p) for p in parts])
    kept, of_gram = np.unique(np.concatenate([*parts, np.zeros(0, np.int32)]), return_inverse=True)
    of_gram, begins = of_gram.astype(np.int32), np.cumsum(lengths) - lengths
    del parts, columns, number

    rng, n_words, n_grams = np.random.default_rng(seed), len(lengths), len(kept)
    embeddings = rng.normal(0, 0.01, (n_grams, DIM)).astype(np.float32)
    softmax, constant = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    pace, size = [np.zeros_like(embeddings), np.zeros_like(softmax), np.zeros_like(constant)], [0.0] * 3
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5  # half-way to equal classes
    weight /= weight.sum()

    for step in range(1, rounds + 1):
        between = (softmax[:, 1] - softmax[:, 0]).astype(np.float32)
        said = np.add.reduceat((embeddings @ between)[of_gram], begins) / lengths
        z = np.bincount(of_pair, share * said[of_doc], len(y)) + constant[1] - constant[0]
        residual = weight * (sigmoid(z) - y)
        by_word = np.bincount(of_doc, share * residual[of_pair], n_words) / lengths
        slope = np.bincount(of_gram, np.repeat(by_word, lengths), n_grams).astype(np.float32)
        classes = np.array([-1.0, 1.0])
        slopes = [None, np.outer(slope @ embeddings, classes), classes * residual.sum()]  # of an embedding: its n-gram's slope times `between`
        # One scale for all of a layer: the steps keep the proportions of the slopes, so rare n-grams don't learn the sample by heart.
        squares = [float((slope * slope).mean() * (between * between).mean()), *(float((g * g).mean()) for g in slopes[1:])]
        rate = RATE * min(1.0, 2 * (1 - step / (rounds + 1))) / (1 - MOMENTUM**step)
        for k, theta in enumerate((embeddings, softmax, constant)):
            size[k] = 0.99 * size[k] + 0.01 * squares[k]
            pace[k] *= MOMENTUM
            pace[k] += (1 - MOMENTUM) * (slopes[k] if k else np.multiply.outer(slope, between))
            theta -= (rate / (math.sqrt(size[k] / (1 - 0.99**step)) + 1e-12)) * pace[k]
    numbers = np.zeros(1 << BITS, np.float32)
    numbers[kept] = embeddings @ (softmax[:, 1] - softmax[:, 0])
    return Classifier(numbers, float(constant[1] - constant[0]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, may: Column | None = None, toxic: int = TOXIC, clean: int = CLEAN) -> Classifier:
    """Train on documents and labels (doc_id, toxic), of the ids that `may` (of doc_id) allows."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = (known.where(may) if may is not None else known).groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return train([], np.zeros(0))
    place = lambda c: F.pmod(fold(c, 5), F.lit(1 << 30))
    parts = {1: toxic / counts[1], 0: clean / counts[0]}
    most = {k: math.ceil(min(1.0, p) * (1 << 30)) for k, p in parts.items()}
    some = known.where(place(F.col("l_id")) < F.when(F.col("toxic") == 1, most[1]).otherwise(most[0]))  # toxic + clean ids, so they are broadcast
    drawn = docs.select("doc_id", "text").where(place(F.col("doc_id")) < max(most.values())).join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    drawn = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lists = pa.array([sorted(words(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "bag", "toxic"])

    got = drawn.select("doc_id", "text", "toxic").mapInArrow(tidy(bags), "doc_id long, bag array<string>, toxic int").toArrow().sort_by("doc_id")
    return train(got.column("bag").to_pylist(), got.column("toxic").to_numpy())


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = Scores(own)
        for batch in small(batches):
            z = np.array([scores.text(t) for t in batch.column(2).to_pylist()]) if own.usable else np.full(batch.num_rows, -np.inf)
            p = sigmoid(z) if own.usable else np.zeros(batch.num_rows)
            arrays = [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(tidy(each), "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"))))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE_SQL: dict[str, str] = {}
