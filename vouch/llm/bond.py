"""Hard negatives by BOND, a vertical scan with branch and bound.

A row's score is its integer inner product with an anchor. An anchor's positives
are the rows of its own label that score highest; for each positive, the hard
negatives are the rows of other labels that score highest within a window below
it (by default from 50 to 95 hundredths of the positive's score). Ties go to the
smaller id.

Rows are packed, where they are read, into blocks of columns: one array a
dimension, with its least and largest value, rows sorted by label. An anchor
reads a block's columns in the order of its own components, largest in size
first. After every few columns each row's score is known but for what the
remaining columns can add or take, which their least and largest values bound;
rows that by these bounds can be neither among the best nor in a window leave
the candidate bitmap, and later columns are read for the others only. Sums are
whole numbers below 2^63, so what remains is exact: no row is lost and no score
is rounded.

Anchors meet the blocks of all rows group by group, on an equi-join with group
numbers; each task carries the anchors' best scores from one block to the next.
First all positives are found, then, with their windows, the negatives. Nothing
is collected, no label has a task of its own, and the number of groups follows
the number of blocks.

Rows with a null id or label, a null or empty vector, or null or non-finite
components take no part, and neither do those of another dimension than most (of
equally common ones the smallest) or whose scaled components are so large (over
2^31 divided by the root of twice the dimension) that a score might not fit in 64
bits. Rows of the anchor's own id are not its partners. Rows that repeat stand
each for themselves, as anchors and as partners. With fewer positives or
negatives than asked for, all are returned; an empty table gives no row.
Further columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.common import table, tidy, written

#: Rows of a block and anchors of a block, at most; blocks of a group, about.
BLOCK, ANCHORS, GROUP = 8192, 256, 16
#: Columns between two looks at the bounds, and the share of rows that must have left before the rest is gathered.
COLUMNS, GATHER = 8, 0.25
#: Blocks of anchors whose best scores a task carries on.
CARRIED = 4096
SCALE = 256

BLOCKS = "block long, ids binary, labels binary, columns binary"


def scaled(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vec array<long>) of the rows that take part; components are floor(SCALE * x)."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes.d if sizes else 1
    most = math.isqrt((1 << 62) // (2 * d))
    rows = rows.where((F.size(v) == d) & F.forall(v, lambda x: F.abs(x.cast("double") * SCALE) < most))
    return rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"))


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (vec_id, label, vec), made where the rows are: nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (whole.column(c).to_numpy() for c in ("vec_id", "label"))
            x = np.asarray(whole.column("vec").combine_chunks().flatten()).reshape(len(ids), -1)
            order = np.lexsort((ids, labels))
            number += 1
            arrays = (ids[order], labels[order], np.ascontiguousarray(x[order].T, np.int32))
            values = [[(task << 32) + number], *([a.tobytes()] for a in arrays)]
            kinds = (pa.int64(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(values, kinds, strict=True)], names=["block", "ids", "labels", "columns"])

        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield block()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block()

    return rows.select("vec_id", "label", "vec").mapInArrow(tidy(each), BLOCKS)


class Block:
    """Rows in columns, sorted by label, as the shortest kind of number in which all sums are exact."""

    def __init__(self, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(columns, np.int32).reshape(-1, len(self.ids))
        self.low, self.high = self.whole.min(axis=1), self.whole.max(axis=1)
        self.most = max(abs(float(self.low.min())), abs(float(self.high.max())), 1.0)
        self.kinds: dict[type, np.ndarray] = {}

    def columns(self, anchor: np.ndarray) -> np.ndarray:
        """Floats hold whole numbers up to 2^24, doubles up to 2^53; larger sums are made of 64-bit integers."""
        size = 2 * float(np.abs(anchor.astype(float)).sum()) * self.most
        kind = np.float32 if size < 2.0**24 else np.float64 if size < 2.0**53 else np.int64
        if kind not in self.kinds:
            self.kinds[kind] = self.whole.astype(kind)
        return self.kinds[kind]

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def scan(block: Block, anchor: np.ndarray, part: slice, fit: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block and scores of the rows that stay candidates through all columns.

    Candidates are at first the rows of a part of the block that `fit` marks.
    `alive` is asked, from the candidates' scores so far and the least and the
    most that the remaining columns can add, for the least and the largest
    score so far that can matter.
    """
    columns = block.columns(anchor)[:, part]
    anchor = anchor.astype(columns.dtype)
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.low.astype(columns.dtype), anchor * block.high.astype(columns.dtype)])
    rest = lambda x: np.append(np.cumsum(x[order][::-1])[::-1], 0)
    least, largest = rest(ends.min(axis=0)), rest(ends.max(axis=0))
    may, score = np.arange(part.start, part.stop), np.zeros(columns.shape[1], columns.dtype)
    for at in range(0, len(order), COLUMNS):
        some, after = order[at : at + COLUMNS], min(at + COLUMNS, len(order))
        score += anchor[some] @ columns[some]
        low, high = alive(score[fit], least[after], largest[after])
        fit = fit & (score >= low) & (score <= high)
        left = int(fit.sum())
        if not left or after == len(order):
            return may[fit], score[fit]
        if left < (1 - GATHER) * len(may):
            may, score, columns, fit = may[fit], score[fit], columns[:, fit], np.ones(left, bool)
    return may, score


def kth(x: np.ndarray, k: int):
    """The k-th largest number, none if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties by the smaller id."""
    return np.lexsort((ids, -score))[:k]


def positives_of(block: Block, anchor: np.ndarray, anchor_id: int, label: int, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows of the label; rows below floor (none: all may) can be left out."""
    own = block.own(label)
    fit = block.ids[own] != anchor_id
    if not fit.any():
        return block.ids[:0], block.ids[:0]

    def alive(so_far: np.ndarray, least, most) -> tuple:
        best = kth(so_far, k)
        bounds = [x for x in (floor, None if best is None else best + least) if x is not None]
        return max(bounds) - most if bounds else -np.inf, np.inf

    may, score = scan(block, anchor, own, fit, alive)
    best = first(block.ids[may], score, k)
    return block.ids[may[best]], score[best].astype(np.int64)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest negative score of a positive's score, in hundredths of it: low * p <= 100 * n <= high * p."""
    return -(-low * positive // 100), high * positive // 100


def negatives_of(block: Block, anchor: np.ndarray, anchor_id: int, label: int, windows: np.ndarray, k: int, floors: list) -> list:
    """For each window (least, largest): ids and scores of the block's k best rows of other labels in it."""
    fit = block.ids != anchor_id
    fit[block.own(label)] = False
    if not fit.any() or not len(windows):
        return [(block.ids[:0], block.ids[:0])] * len(windows)

    def alive(so_far: np.ndarray, least, most) -> tuple:
        lows = []
        for (low, high), floor in zip(windows, floors, strict=True):
            # Rows that end in the window whatever follows: none while what may follow is wider than the window.
            sure = so_far[(so_far + least >= low) & (so_far + most <= high)] if most - least <= high - low else so_far[:0]
            best = kth(sure, k)
            lows.append(max(x for x in (low, floor, None if best is None else best + least) if x is not None))
        return min(lows) - most, max(high for _, high in windows) - least

    may, score = scan(block, anchor, slice(0, len(block.ids)), fit, alive)
    ids, out = block.ids[may], []
    for low, high in windows:
        fits = np.flatnonzero((score >= low) & (score <= high))
        best = fits[first(ids[fits], score[fits], k)]
        out.append((ids[best], score[best].astype(np.int64)))
    return out


class Carried:
    """The k best scores so far of each anchor (and window), for as many blocks of anchors as a task keeps."""

    def __init__(self, k: int):
        self.k, self.scores = k, {}

    def of(self, block: int) -> dict:
        if block not in self.scores and len(self.scores) >= CARRIED:
            self.scores.pop(next(iter(self.scores)))
        return self.scores.setdefault(block, {})

    def floor(self, own: dict, key):
        got = own.get(key)
        return got[-1] if got is not None and len(got) == self.k else None

    def add(self, own: dict, key, scores: np.ndarray) -> None:
        own[key] = sorted([*own.get(key, ()), *scores.tolist()], reverse=True)[: self.k]


def met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block beside each block of anchors: anchors are repeated for each group of blocks and met by its number."""
    groups = max(1, -(-blocks.count() // GROUP))
    rows = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    dealt = anchors.withColumn("a_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    return rows.join(dealt, F.col("group") == F.col("a_group")).drop("group", "a_group", "block")


def anchor_blocks(anchors: DataFrame, windows: bool) -> DataFrame:
    """Blocks of anchors (a, vec_id, label, vec and, with windows, an array `positives` of (rank, id, score))."""
    names = ["a", "vec_id", "label", "vec", *(["p_rank", "p_score"] if windows else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(begin, ANCHORS)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), *(pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns)], names=["a_block", *(f"a_{n}" for n in names)])

    kinds = {"a": "long", "vec_id": "long", "label": "long", "vec": "array<long>", "p_rank": "array<int>", "p_score": "array<long>"}
    return anchors.select(*names).mapInArrow(tidy(each), "a_block long, " + ", ".join(f"a_{n} array<{kinds[n]}>" for n in names))


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, a_block, the anchors' lists) of each row; a block that comes again in the next row is kept."""
    last, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, columns, number, *lists = (c[i] for c in batch.columns)
            key = ids.as_py()
            if key != last:
                last, block = key, Block(key, labels.as_py(), columns.as_py())
            yield block, number.as_py(), [x.as_py() for x in lists]


def positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(a, p_rank, positive_id, positive_score): each anchor's k best rows of its own label."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = Carried(k)
        for block, number, lists in taken(batches):
            own, out = carried.of(number), []
            for a, anchor_id, label, vec in zip(*lists, strict=True):
                ids, scores = positives_of(block, np.array(vec, np.int64), anchor_id, label, k, carried.floor(own, a))
                carried.add(own, a, scores)
                out.append((np.full(len(ids), a, np.int64), ids, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "positive_id", "positive_score"])

    scored = met(blocks, anchor_blocks(anchors, windows=False)).mapInArrow(tidy(each), "a long, positive_id long, positive_score long")
    rank = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    return scored.withColumn("p_rank", F.row_number().over(rank)).where(F.col("p_rank") <= k)


def negatives(blocks: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(a, p_rank, rank, negative_id, negative_score) of anchors with arrays p_rank, p_score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = Carried(k)
        for block, number, lists in taken(batches):
            own, out = carried.of(number), [(np.zeros(0, np.int64),) * 4]
            for a, anchor_id, label, vec, ranks, scores in zip(*lists, strict=True):
                windows = [window(s, low, high) for s in scores]
                some = [i for i, (x, y) in enumerate(windows) if x <= y]
                floors = [carried.floor(own, (a, ranks[i])) for i in some]
                got = negatives_of(block, np.array(vec, np.int64), anchor_id, label, [windows[i] for i in some], k, floors)
                for i, (ids, found) in zip(some, got, strict=True):
                    carried.add(own, (a, ranks[i]), found)
                    out.append((np.full(len(ids), a, np.int64), np.full(len(ids), ranks[i], np.int64), ids, found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "p_rank", "negative_id", "negative_score"])

    scored = met(blocks, anchor_blocks(anchors, windows=True)).mapInArrow(tidy(each), "a long, p_rank long, negative_id long, negative_score long")
    rank = Window.partitionBy("a", "p_rank").orderBy(F.desc("negative_score"), "negative_id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def mine(rows: DataFrame, asked: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, vec) that `asked` marks."""
    blocks = written(packed(rows), "bond-blocks")
    anchors = written(rows.where(asked).withColumn("a", F.monotonically_increasing_id()), "bond-anchors")
    best = written(positives(blocks, anchors, n_positives), "bond-positives")
    lists = best.groupBy(F.col("a").alias("p_a")).agg(F.sort_array(F.collect_list(F.struct("p_rank", "positive_score"))).alias("p"))
    asking = anchors.join(lists, F.col("a") == F.col("p_a")).select("a", "vec_id", "label", "vec", F.col("p.p_rank").alias("p_rank"), F.col("p.positive_score").alias("p_score"))
    hard = negatives(blocks, asking, n_negatives, low, high).select(F.col("a").alias("n_a"), F.col("p_rank").alias("n_rank"), "rank", "negative_id", "negative_score")
    pairs = best.join(anchors.select(F.col("a").alias("i"), F.col("vec_id").alias("anchor_id")), F.col("a") == F.col("i"))
    return pairs.join(hard, (F.col("a") == F.col("n_a")) & (F.col("p_rank") == F.col("n_rank"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(scaled(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {
    "op13_hard_negatives": """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as own, cast(list_inner_product(a.vec, b.vec) as bigint) as score
  from rows a join rows b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
}
