"""Quality classification by co-training two views of a document.

The content view sees words: which occur, how often words repeat, how many are
odd in form. The metadata view sees the page around them and no word: source,
declared language, length, lines and their length. Both are logistic models, fitted on a
sample of labelled documents. Over ROUNDS rounds each view labels the
unlabelled documents of a pool that it is surest of, and hands them to the
other view as further training rows. Then each view's output is calibrated on
labelled documents that neither was fitted on, and a last logistic model of the
two calibrated outputs scores every document.

A document is labelled bad if it has quality 0 or is toxic; of conflicting
labels of one document the bad one counts. Bad documents are rejected.

The driver fits on at most about TRAIN labelled and POOL unlabelled documents
(both expectations, drawn by a hash of the id) of a few hundred numbers each;
scoring covers all documents, whole. Null texts are scored as empty; null
metadata is a value of its own. With no labels, or labels of one kind, nothing
is rejected and every score is 1; an empty table gives no row. Rows that repeat
are scored each on its own, and equal rows alike; of rows that share an id, too,
the same ones are held out in every run. Further columns are not looked
at, whatever their names. A very long text needs memory for its own words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import ddl, fold, small, table, tidy

TRAIN, POOL, ROUNDS = 8_000, 4_000, 3
#: Share of labelled rows kept for calibration, and of the pool that a view may label in a round.
HELD, CONFIDENT = 0.25, 0.1
SURE = 0.95
#: A document is rejected if it is at least so likely bad.
REJECT = 0.6
BITS = 18
LEAST_DOCS = 8  # of the sample, for a word to count
CACHED_WORDS = 300_000

ROW = "doc_id long, words binary, content array<double>, page array<double>, lang string, source string, bad int"


class Chunks(dict):
    """White-space-separated chunks to (word number, form): packed 32-bit integers."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        word = chunk.strip(".,;:!?\"'()")
        letters = sum(map(str.isalpha, chunk))
        odd = len(chunk) - letters > 2 or not letters
        form = (chunk.isupper() and letters > 1) + 2 * odd
        number = zlib.crc32(word.lower().encode("utf-8", "replace")) & ((1 << BITS) - 1)
        self[chunk] = out = number.to_bytes(4, "little") + int(form).to_bytes(4, "little")
        return out


def features(text: str | None, n_chars: int | None, chunks: Chunks) -> tuple[np.ndarray, list[float], list[float]]:
    """Distinct word numbers, content measures, page measures."""
    text = text or ""
    split = text.split()
    both = np.frombuffer(b"".join(map(chunks.__getitem__, split)), np.int32).reshape(-1, 2)
    words, form, n = both[:, 0], both[:, 1], max(1, len(split))
    once = np.unique(words)
    repeated = float((words[1:] == words[:-1]).sum()) / n
    odd, upper = float((form >= 2).sum()) / n, float((form & 1).sum()) / n
    lines, size = text.count("\n") + 1, len(text)
    content = [repeated, len(once) / n, odd, upper, math.log1p(len(split)), size / n / 10]
    page = [math.log1p(n_chars if n_chars is not None and n_chars >= 0 else size), math.log1p(lines), math.log1p(size / lines)]
    return once, content, page


def extract(docs: DataFrame) -> DataFrame:
    """The features of documents (doc_id, text, lang, source, n_chars, bad)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in small(batches):
            got = [features(t, n, chunks) for t, n in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1] for g in got], lists),
                 pa.array([g[2] for g in got], lists), batch.column(2), batch.column(3), batch.column(5)],
                names=["doc_id", "words", "content", "page", "lang", "source", "bad"],
            )

    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), "bad").mapInArrow(tidy(each), ROW)


class Logistic:
    """Logistic regression on sparse 0/1 columns beside standardised dense ones."""

    def fit(self, sparse: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, penalty: float = 2e-3, rounds: int = 120):
        self.mean, self.deviation = dense.mean(axis=0), dense.std(axis=0) + 1e-9
        x = self.scaled(dense)
        sizes = np.array([len(s) for s in sparse])
        columns = np.concatenate([np.zeros(0, np.int64), *sparse]).astype(np.int64)
        rows = np.repeat(np.arange(len(y)), sizes)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        weight /= weight.sum()
        theta = [np.zeros(width), np.zeros(x.shape[1]), np.zeros(1)]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, rounds + 1):
            z = np.bincount(rows, theta[0][columns], len(y)) + x @ theta[1] + theta[2]
            residual = weight * (sigmoid(z) - y)
            slopes = [np.bincount(columns, residual[rows], width) + penalty / 10 * theta[0], x.T @ residual + penalty * theta[1], residual.sum(keepdims=True)]
            for k, g in enumerate(slopes):  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                theta[k] = theta[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        self.sparse, self.dense, self.constant = theta[0], theta[1], float(theta[2][0])
        return self

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.deviation, -8, 8)

    def logits(self, sparse: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        own = np.array([self.sparse[s].sum() for s in sparse])
        return own + self.scaled(dense) @ self.dense + self.constant


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """The two views, their calibration and their combination."""

    def __init__(self, rows: pa.Table):
        content, page = (np.array(rows.column(c).to_pylist(), float) for c in ("content", "page"))
        words = [np.frombuffer(w, np.int32) for w in rows.column("words").to_pylist()]
        n = np.bincount(np.concatenate([np.zeros(0, np.int32), *words]), minlength=1 << BITS)
        common = n >= LEAST_DOCS
        self.column = np.where(common, np.cumsum(common), 0).astype(np.int32)  # 0: no column of its own
        self.width = int(common.sum()) + 1
        metadata = list(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True))
        seen: dict[tuple, int] = {}
        for pair in metadata:
            for key in enumerate(pair):
                seen[key] = seen.get(key, 0) + 1
        self.values = {k: i + 1 for i, k in enumerate(sorted((k for k, n in seen.items() if n >= LEAST_DOCS), key=str))}

        views = [([self.own(w) for w in words], content), ([self.page_columns(*m) for m in metadata], page)]
        widths = [self.width, len(self.values) + 1]
        bad = np.array([-1 if b is None else b for b in rows.column("bad").to_pylist()])
        held = np.arange(len(bad)) % round(1 / HELD) == 0
        labelled, pool = np.flatnonzero((bad >= 0) & ~held), np.flatnonzero(bad < 0)
        check = np.flatnonzero((bad >= 0) & held)
        self.usable = bool(len(np.unique(bad[labelled])) == 2 and len(np.unique(bad[check])) == 2)
        if not self.usable:
            return
        given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view trains on
        for turn in range(ROUNDS + 1):
            self.models = []
            for (sparse, dense), width, extra in zip(views, widths, given, strict=True):
                at = np.concatenate([labelled, np.array(list(extra), np.int64)]).astype(np.int64)
                y = np.concatenate([bad[labelled], np.array(list(extra.values()), float)])
                self.models.append(Logistic().fit([sparse[i] for i in at], dense[at], y, width))
            if turn == ROUNDS or not len(pool):
                break
            most = max(1, int(CONFIDENT * len(pool)))
            for k, (model, (sparse, dense)) in enumerate(zip(self.models, views, strict=True)):
                p = sigmoid(model.logits([sparse[i] for i in pool], dense[pool]))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    for i in np.argsort(-sure, kind="stable")[:most]:
                        if sure[i] >= SURE:
                            given[1 - k].setdefault(int(pool[i]), label)
        outputs = [m.logits([s[i] for i in check], d[check]) for m, (s, d) in zip(self.models, views, strict=True)]
        y = bad[check].astype(float)
        self.calibrations = [platt(z, y) for z in outputs]
        calibrated = [a * z + b for (a, b), z in zip(self.calibrations, outputs, strict=True)]
        self.weights = combine(np.stack(calibrated, axis=1), y)

    def own(self, words: np.ndarray) -> np.ndarray:
        columns = np.unique(self.column[words])
        return columns[columns > 0]

    def page_columns(self, lang, source) -> np.ndarray:
        return np.array([self.values.get(k, 0) for k in enumerate((lang, source))])

    def bad(self, words, content, page, metadata) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How likely documents are bad: by content, by metadata, by both."""
        outputs = [self.models[0].logits([self.own(w) for w in words], content), self.models[1].logits([self.page_columns(*m) for m in metadata], page)]
        z = [a * o + b for (a, b), o in zip(self.calibrations, outputs, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(z[0] * self.weights[0] + z[1] * self.weights[1] + self.weights[2])


def combine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic weights and a constant, by Newton's method; a little shrunk, so that separable data end too."""
    x1 = np.column_stack([np.clip(x, -15, 15), np.ones(len(y))])
    theta = np.zeros(x1.shape[1])
    for _ in range(30):
        p = sigmoid(x1 @ theta)
        slope = x1.T @ (p - y) / len(y) + penalty * theta
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + penalty * np.eye(len(theta))
        theta = theta - np.linalg.solve(curve, slope)
    return theta


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = combine(z[:, None] / (z.std() + 1e-9), y, 1e-4)
    return float(max(a, 0.0) / (z.std() + 1e-9)), float(b)


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN, pool: int = POOL) -> CoTrained:
    """Co-train on a bounded sample of documents and labels (doc_id, quality, toxic)."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(bad.alias("bad"))
    n_labels, n_docs = labels.count(), docs.count()
    drawn = lambda c, n, of, salt: F.pmod(fold(c, salt), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, n / max(1, of)) * (1 << 30)))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*columns)
    some = labels.where(drawn(F.col("l_id"), train, n_labels, 1))
    labelled = docs.where(drawn(F.col("doc_id"), train, n_labels, 1)).join(some, F.col("doc_id") == F.col("l_id")).select(*columns, "bad")
    rest = docs.where(drawn(F.col("doc_id"), pool, n_docs, 2)).join(labels, F.col("doc_id") == F.col("l_id"), "left_anti")
    rows = extract(labelled).unionByName(extract(rest.withColumn("bad", F.lit(None).cast("int"))))
    return CoTrained(in_order(rows.toArrow()))


def in_order(rows: pa.Table) -> pa.Table:
    """Rows in an order that is the same in every run: rows that tie are alike in all that is looked at. Nulls are last."""
    keys = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "bad", "lang", "source", "words", "content", "page")), strict=True)
    keys = [[(x is None, x) for x in key] for key in keys]
    return rows.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))


def score(docs: DataFrame, model: CoTrained, keep: bool = False) -> DataFrame:
    """doc_id, quality (0 to 1), p_content, p_page and rejected; with keep, all columns of docs of the rows not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = [names.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, own = Chunks(), shared.value
        for batch in small(batches):
            if not batch.num_rows:
                continue
            ids, text, lang, source, n = (batch.column(i) for i in at)
            if own.usable:
                got = [features(t, k, chunks) for t, k in zip(text.to_pylist(), n.to_pylist(), strict=True)]
                words, content, page = zip(*got, strict=True)
                metadata = zip(lang.to_pylist(), source.to_pylist(), strict=True)
                by_content, by_page, both = own.bad(words, np.array(content), np.array(page), metadata)
            else:
                by_content = by_page = both = np.zeros(batch.num_rows)
            if keep:
                yield batch.filter(pa.array(both < REJECT))
                continue
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(1 - both), pa.array(1 - by_content), pa.array(1 - by_page), pa.array(both >= REJECT)],
                names=["doc_id", "quality", "p_content", "p_page", "rejected"],
            )

    if keep:
        return docs.mapInArrow(tidy(each), ddl(docs))
    return docs.mapInArrow(tidy(each), "doc_id long, quality double, p_content double, p_page double, rejected boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
