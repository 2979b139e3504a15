"""Benchmark decontamination: BM25 over test items, queried by every passage.

The test items are the indexed side: an inverted index with BM25 impacts,
divided by each item's own full score, so that an item whose words all stand in
a passage scores 1 there. Postings are cut into blocks with their largest
impacts. Items are indexed by classes of length, so that a long item doesn't
widen the passages that short ones are looked for in. For each class, every
document is cut into overlapping passages, wide enough that an item lies whole
in at least one, and each passage is a query. Words so common
that no item draws more than half the threshold from them can't lift an item
alone, so a first, vectorised look at the other (essential) words bounds every
item's score in every passage; where that bound falls short nothing can be
retrieved. In the passages that are left, block-max WAND skips the blocks that
can't lift an item to the threshold, and every item at or above it is retrieved.

A retrieved item is confirmed by the words that the document around the passage
holds in its order: wherever item and document share five words in a row, all
words of the item are compared at that offset. Question (what stands before the
last sentence) and answer (the last sentence) count together, by their lengths:
at least OVERLAP of all words must be held, so one changed word or a short
answer cut off doesn't hide an item. A part of fewer than five words is looked
for as a whole. An item of one sentence is all question.

The index is bounded by the benchmark, not by the corpus. Up to MAX_WORDS words
it is broadcast; larger benchmarks are cut into shards by item id, a pass over
the documents each, so no index of unbounded size is sent. Scores don't depend
on shards or classes: the counts behind them are taken over all items.

Null or empty texts hold no item, and null or empty items are in no document.
Items that repeat are each reported, and documents that repeat are each judged,
alike. An empty corpus gives no row; with an empty benchmark nothing is found and
every document is clean. Case and punctuation don't count. A very long text is
many passages, and needs memory for its own words. Retrieval has no rank and so
no ties: all items at or above the threshold are taken. Further columns are kept
by `clean` and not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import ddl, small, table, tidy, written

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score from which it is retrieved, and of its words from which it is confirmed; words in a row that tie it to a place.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
BLOCK = 64
#: Words of one broadcast index.
MAX_WORDS = 1_000_000
#: Words of the longest item of the first class, and how many times longer those of each next class may be.
LEAST_PASSAGE, LONGER = 64, 4
CACHED_WORDS = 300_000

OTHER = bytes(4)
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item before its last sentence, and of that sentence; of one sentence, all and none."""
    parts = [w for p in SENTENCE.split(text) if (w := WORD.findall(p.lower()))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def totals(counts: list[Counter]) -> tuple[int, float, dict[str, int]]:
    """How many items there are, their mean length, and the items by word."""
    return len(counts), sum(c.total() for c in counts) / max(1, len(counts)), Counter(w for c in counts for w in c)


class Index:
    """Postings of items by word, with block-max impacts; one copy a Python worker."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, counted: tuple[int, float, dict[str, int]] | None = None):
        """counted: items, mean length and items by word where `items` are a part of more."""
        self.threshold = threshold
        kept = [(i, q, a) for i, t in items if t for q, a in [question_and_answer(t)] if q]
        self.items = kept
        counts = [Counter(q + a) for _, q, a in kept]
        n, mean, df = counted or totals(counts)
        idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        for at, c in enumerate(counts):
            norm = K1 * (1 - B + B * c.total() / mean)
            own = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in c.items()}
            total = sum(own.values()) or 1.0
            for w, x in own.items():
                lists.setdefault(w, []).append((at, x / total))
        self.at = {w: k for k, w in enumerate(lists)}
        self.docs = [[d for d, _ in p] for p in lists.values()]
        self.impacts = [[x for _, x in p] for p in lists.values()]
        self.blocks = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = [max(x) for x in self.impacts]
        longest = max((len(q) + len(a) for _, q, a in kept), default=0)
        self.stride = max(LEAST_PASSAGE, longest)
        self.words = [np.array([self.at[w] + 1 for w in q + a], np.int32) for _, q, a in kept]
        self.essential(len(kept))

    def essential(self, n: int) -> None:
        """Postings of all but the commonest words, as arrays by word number + 1; 0 is for words that no item has."""
        drawn, common = np.zeros(max(1, n)), set()
        for w in sorted(range(len(self.docs)), key=lambda w: (-len(self.docs[w]), w)):
            more = drawn.copy()
            more[self.docs[w]] += self.impacts[w]
            if len(self.docs[w]) < 2 or more.max() > self.threshold / 2:
                break
            drawn = more
            common.add(w)
        self.need = self.threshold - drawn.max() - 1e-6
        own = [[] if w in common else d for w, d in enumerate(self.docs)]
        self.length = np.array([0, *map(len, own)])
        self.first = np.cumsum(self.length) - self.length
        self.item = np.array([d for x in own for d in x], np.int64)
        self.impact = np.array([x for w, p in enumerate(self.impacts) if w not in common for x in p])

    def passages(self, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, begin, end) of the passages in which some item's essential words may suffice."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *texts])
        where = np.flatnonzero(self.length[ids])
        if not len(where):
            return []
        size = self.length[ids[where]]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(self.first[ids[where]], size)
        text = np.repeat(np.arange(len(texts)), sizes)[where]
        block = (where - (np.cumsum(sizes) - sizes)[text]) // self.stride
        last = np.maximum(0, -(-(sizes - self.stride) // self.stride) - 1)  # passage of each text; each is two blocks long
        base = np.cumsum(last + 1) - last - 1
        block, end, begin = (np.repeat(x, size) for x in (block, last[text], base[text]))
        # Each posting counts once in a passage, however often the word stands there.
        passage, n = begin + np.minimum(block, end), len(self.item)
        both = (block > 0) & (block <= end)
        once = np.unique(np.concatenate([passage * n + at, (passage[both] - 1) * n + at[both]]))
        passage, at = np.divmod(once, n)
        found, inverse = np.unique(passage * len(self.items) + self.item[at], return_inverse=True)
        bound = np.bincount(inverse, self.impact[at])
        some = np.unique(found[bound >= self.need] // len(self.items))
        own = np.searchsorted(base, some, "right") - 1
        return [
            (t, k * self.stride, min(int(sizes[t]), (k + 2) * self.stride)) for t, k in zip(own.tolist(), (some - base[own]).tolist(), strict=True)
        ]

    def retrieve(self, words: list[int]) -> list[tuple[int, float]]:
        """Items that score at least the threshold against a set of words, by block-max WAND."""
        cursors = [[0, w] for w in words]
        out = []
        slack = 1e-9
        while cursors:
            cursors.sort(key=lambda c: self.docs[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for k, (_, w) in enumerate(cursors):
                bound += self.most[w]
                if bound >= self.threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.docs[cursors[pivot][1]][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and self.docs[cursors[pivot + 1][1]][cursors[pivot + 1][0]] == doc:
                pivot += 1
            # The blocks that hold the pivot bound what it can score.
            shallow, last = 0.0, None
            for p, w in cursors[: pivot + 1]:
                at = bisect_left(self.docs[w], doc, p)
                if at < len(self.docs[w]):
                    shallow += self.blocks[w][at // BLOCK]
                    end = self.docs[w][min(len(self.docs[w]), (at // BLOCK + 1) * BLOCK) - 1]
                    last = end if last is None else min(last, end)
            if shallow < self.threshold - slack:
                # Nothing up to the nearest block end can reach the threshold by these words alone.
                after = doc + 1 if last is None else max(doc + 1, last + 1)
                if pivot + 1 < len(cursors):
                    after = min(after, self.docs[cursors[pivot + 1][1]][cursors[pivot + 1][0]])
                target = max(after, doc + 1)
            elif self.docs[cursors[0][1]][cursors[0][0]] == doc:
                score = sum(self.impacts[w][p] for p, w in cursors[: pivot + 1])
                if score >= self.threshold - slack:
                    out.append((doc, score))
                target = doc + 1
            else:
                target = doc
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(self.docs[c[1]], target, c[0])
            cursors = [c for c in cursors if c[0] < len(self.docs[c[1]])]
        return out


def indexes(items: list[tuple[int, str]], threshold: float = THRESHOLD, counted: tuple[int, float, dict[str, int]] | None = None) -> list[Index]:
    """An index for each class of length that has items; what is counted is counted over all of them."""
    classes: dict[int, list[tuple[int, str]]] = {}
    counts = []
    for item, text in items:
        words = Counter(WORD.findall((text or "").lower()))
        if words:
            counts.append(words)
            size, last = 0, LEAST_PASSAGE
            while last < words.total():
                size, last = size + 1, last * LONGER
            classes.setdefault(size, []).append((item, text))
    counted = counted or totals(counts)
    return [Index(own, threshold, counted) for _, own in sorted(classes.items())]


class Chunks(dict):
    """White-space-separated chunks to the numbers of their words in the index (+1; 0 for other words), as 32-bit."""

    def __init__(self, index: Index, most: int = CACHED_WORDS):
        super().__init__()
        self.most = most
        self.numbers = {w: (k + 1).to_bytes(4, "little") for w, k in index.at.items()}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if chunk.isalnum():
            out = self.numbers.get(chunk, OTHER)
        else:
            out = b"".join([self.numbers.get(w, OTHER) for w in WORD.findall(chunk)])
        self[chunk] = out
        return out


def places(near: np.ndarray, size: int) -> dict[bytes, list[int]]:
    """Where each run of so many words begins."""
    raw, out = near.tobytes(), {}
    for i in range(len(near) - size + 1):
        out.setdefault(raw[4 * i : 4 * (i + size)], []).append(i)
    return out


def held(item: np.ndarray, cut: int, near: np.ndarray, runs: dict[int, dict[bytes, list[int]]]) -> np.ndarray:
    """Whether each word of an item (question up to `cut`) stands in a text at an offset that a shared run gives.

    runs: `places` in the text by size, filled as needed.
    """
    raw, offsets = item.tobytes(), set()
    parts = [(0, len(item)), *((a, b) for a, b in ((0, cut), (cut, len(item))) if 0 < b - a < SHINGLE)]
    for a, b in parts:
        size = min(SHINGLE, b - a)
        if size not in runs:
            runs[size] = places(near, size)
        for i in range(a, b - size + 1):
            offsets.update(p - i for p in runs[size].get(raw[4 * i : 4 * (i + size)], ()))
    out = np.zeros(len(item), bool)
    for d in offsets:
        a, b = max(0, -d), min(len(item), len(near) - d)
        out[a:b] |= item[a:b] == near[a + d : b + d]
    return out


def matches(texts: list[str | None], index: Index, chunks: Chunks) -> list[list[tuple[int, float, float, float]]]:
    """(item number, score, question overlap, answer overlap) of the items that each text holds."""
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    if index.items:
        for begin in range(0, len(texts), 256):
            ids = [
                np.frombuffer(b"".join(map(chunks.__getitem__, t.lower().split())) if t else b"", np.int32)
                for t in texts[begin : begin + 256]
            ]
            for at, a, b in index.passages(ids):
                confirm(ids[at], a, b, index, found[begin + at])
    return [[(item, *x) for item, x in sorted(f.items())] for f in found]


def held_items(texts: list[str | None], indexed: list[tuple[Index, Chunks]]) -> list[list[tuple[int, float, float, float]]]:
    """(item id, score, question overlap, answer overlap) of the items of any class that each text holds."""
    out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
    for index, chunks in indexed:
        for own, found in zip(out, matches(texts, index, chunks), strict=True):
            own += [(index.items[i][0], *x) for i, *x in found]
    return out


def with_chunks(items: list[tuple[int, str]], threshold: float, counted: tuple | None) -> list[tuple[Index, Chunks]]:
    own = indexes(items, threshold, counted)
    return [(x, Chunks(x, CACHED_WORDS // len(own))) for x in own]


def confirm(ids: np.ndarray, a: int, b: int, index: Index, found: dict[int, tuple[float, float, float]]) -> None:
    """Retrieve items by one passage and keep those that the words around it hold."""
    retrieved = index.retrieve([w - 1 for w in np.unique(ids[a:b]).tolist() if w])
    if not retrieved:
        return
    near = ids[max(0, a - index.stride) : b + index.stride]
    runs: dict[int, dict[bytes, list[int]]] = {}
    for item, score in retrieved:
        cut = len(index.items[item][1])
        has = held(index.words[item], cut, near, runs)
        if has.sum() >= OVERLAP * len(has) - 1e-9 and score > found.get(item, (0.0,))[0]:
            found[item] = (score, *(float(x.mean()) if len(x) else 1.0 for x in (has[:cut], has[cut:])))


def shards(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], tuple[int, float, dict[str, int]] | None]]:
    """The items, at most about MAX_WORDS words at a time, and what is counted over all where they are several times."""
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first().n
    n = max(1, math.ceil(size / MAX_WORDS))
    items = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("shard"))
    if n > 1:
        words = written(items.select("shard", "text").mapInArrow(item_words, "shard long, length long, word string"), "item-words")
        number, length = words.where("length > 0").agg(F.count("*"), F.avg("length")).first()  # a row an item holds its length
        df = words.groupBy("word").agg(F.count("*").alias("n"))
    for shard in range(n):
        own = items.where(F.col("shard") == shard)
        counted = None
        if n > 1:
            mine = words.where(F.col("shard") == shard).select("word").distinct()
            counted = (number, length or 0.0, {r.word: r.n for r in mine.join(df, "word").collect()})
        yield [(r.item_id, r.text) for r in own.collect()], counted


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, length, word) of the different words of each text; the length in words on the first of them alone."""
    for batch in batches:
        rows = []
        for shard, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = WORD.findall((text or "").lower())
            rows += [(shard, 0 if k else len(words), w) for k, w in enumerate(dict.fromkeys(words))]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "length", "word"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each item (item_id, text) that a document (doc_id, text) holds.

    Returns doc_id, item_id, score, question_overlap, answer_overlap.
    """
    out = None
    for own, counted in shards(items):
        one = against(docs, own, threshold, counted)
        out = one if out is None else out.unionByName(one)
    return out


def against(docs: DataFrame, items: list[tuple[int, str]], threshold: float, counted: tuple | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, threshold, counted))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = with_chunks(*shared.value)
        for batch in small(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            rows = [(d, *x) for d, found in zip(ids, held_items(texts, indexed), strict=True) for x in found]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        tidy(each), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    schema = ddl(docs)
    where = docs.columns.index("text")
    for own, counted in shards(items):
        shared = docs.sparkSession.sparkContext.broadcast((own, threshold, counted))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexed = with_chunks(*shared.value)
            for batch in small(batches):
                found = held_items(batch.column(where).to_pylist(), indexed)
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(tidy(each), schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
