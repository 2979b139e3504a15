"""Approximate nearest neighbours by largest inner product.

An inverted file: k-means centroids, trained on a bounded sample, cut the space
into lists; each vector is stored in its list with its product-quantised residual
and the norm of what the codes miss. A query probes the lists whose centroids
have the largest inner products with it and scores their codes from tables of
partial products (asymmetric distance). No approximate score is more wrong than
the norms of query and miss allow, so every vector that by this bound can still
be among the k best is scored again exactly, in double precision; no count cuts
candidates off. Of the vectors in probed lists the k best are always found.

How many lists to probe is measured when the index is trained: the fewest that
hold the share COVER of the exact neighbours among the sample. Vectors in
clusters need few lists; vectors without structure need a large part of them,
and a search then costs in proportion to the vectors, whatever the index.

There are as many lists as the square root of the vectors, and neighbouring
lists form as many groups as the square root of the lists, so both grow with
the table: 10^9 vectors are 31,623 lists in 178 groups. A group is stored in
blocks of at most about BLOCK vectors, so a list that holds a third of all
vectors is many blocks on many tasks; queries meet blocks by an equi-join on
the group, and bring along which of its lists they probe. Each block yields a
query's k best of its own, and the last step keeps the k best of all. Of equal
vectors in a block only those are scored whose ids can be among the k smallest.
Only the centroids and codebooks reach the driver.

Vectors that are null, empty, zero or hold null or non-finite components, or
have a null id, take no part, and neither do those of another dimension than
most (of equally common ones the smallest). Rows that repeat an id are each a
candidate of their own and never their own id's answer. With fewer candidates
than k all found are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.common import fold, table, written

#: Vectors that centroids and codebooks are trained on (in expectation): so many, and PER_LIST for each list; of them
#: the lists to probe are measured on TRAIN. Lists that are trained, at most: those of 10^9 vectors.
TRAIN, PER_LIST = 24_576, 16
TRAINED_LISTS = 1 << 15
#: Products of vectors and centroids that are held at once.
CELLS = 1 << 22
BLOCK = 8192
QUERY_BLOCK = 256
SUB = 2  # dimensions of a sub-vector
COVER, NEIGHBOURS = 0.97, 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(whole & F.exists(v, lambda x: x != 0)).select("vec_id", v.cast("array<double>").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (sizes.d if sizes else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[rng.choice(len(x), empty.size)]
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest row of c for each row of x, in blocks."""
    half, step = (c * c).sum(axis=1) / 2, max(1, min(8192, CELLS // len(c)))
    return np.concatenate([(x[i : i + step] @ c.T - half).argmax(axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centroids and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.d = sample.shape[1]
        self.width = -(-self.d // SUB) * SUB
        x = self.pad(sample)
        self.centroids = kmeans(x, lists)
        rest = x - self.centroids[nearest(x, self.centroids)]
        self.books = [kmeans(rest[:, j : j + SUB], 256) for j in range(0, self.width, SUB)]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float32), ((0, 0), (0, self.width - self.d)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of vectors, and the norms of what these miss of them."""
        x = self.pad(x)
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = [nearest(rest[:, j * SUB : (j + 1) * SUB], b).astype(np.uint8) for j, b in enumerate(self.books)]
        for j, (b, code) in enumerate(zip(self.books, codes, strict=True)):
            rest[:, j * SUB : (j + 1) * SUB] -= b[code]
        return own, np.stack(codes, axis=1), np.sqrt((rest * rest).sum(axis=1))

    def calibrate(self, sample: np.ndarray, most: int = 256) -> int:
        """Lists to probe for the share COVER of the exact neighbours among the sample."""
        sample = sample[:: max(1, len(sample) // TRAIN)]
        q = sample[:: max(1, len(sample) // most)]
        exact = q @ sample.T
        exact[exact >= (q * q).sum(axis=1)[:, None] * (1 - 1e-12)] = -np.inf  # itself and its copies
        k = min(NEIGHBOURS, len(sample))
        near = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        order = np.argsort(-(self.pad(q) @ self.centroids.T), axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        own = nearest(self.pad(sample), self.centroids)
        need = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
        return int(need[max(0, math.ceil(COVER * len(need)) - 1)]) + 1

    def probed(self, q: np.ndarray, n: int) -> np.ndarray:
        """Whether each query (row) probes each list (column)."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        step = max(1, CELLS // len(self.centroids))
        for i in range(0, len(q), step):
            near = self.pad(q[i : i + step]) @ self.centroids.T
            np.put_along_axis(out[i : i + step], np.argsort(-near, axis=1, kind="stable")[:, :n], True, axis=1)
        return out

    @property
    def per(self) -> int:
        """Lists of a group."""
        return max(1, round(math.sqrt(len(self.centroids))))

    def scores(self, q: np.ndarray, probed: np.ndarray, first: int, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries (rows) with coded vectors (columns, by list); -inf where not probed.

        probed: whether each query probes each list from number `first` on.
        """
        q = self.pad(q)
        tables = [q[:, j * SUB : (j + 1) * SUB] @ b.T for j, b in enumerate(self.books)]
        out = np.full((len(q), len(lists)), -np.inf, np.float32)
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1), len(lists)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            asking = np.flatnonzero(probed[:, lists[a] - first]) if b > a else []
            if len(asking):
                part = np.repeat((q[asking] @ self.centroids[lists[a]])[:, None], b - a, axis=1)
                for table_, code in zip(tables, codes[a:b].T, strict=True):
                    part += table_[asking][:, code]
                out[asking, a:b] = part
        return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def copies(rows: list[tuple]) -> list[int]:
    """For rows (list, id, vector, ...) in order: so many rows of the same vector and a smaller id stand before one for any query.

    The rows of one id don't count, as a query of that id doesn't see them.
    """
    seen: dict[bytes, tuple[int, int, int, int]] = {}  # vector: rows, longest run of an id, the last id and its run
    out = []
    for _, i, v, *_ in rows:
        n, longest, last, run = seen.get(v, (0, 0, i, 0))
        out.append(n - longest)
        run = run + 1 if i == last else 1
        seen[v] = (n + 1, max(longest, run), i, run)
    return out


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; -inf in rows of fewer."""
    return -np.partition(-x, k - 1, axis=1)[:, k - 1] if x.shape[1] >= k else np.full(len(x), -np.inf)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, near: np.ndarray, miss: np.ndarray, k: int) -> tuple:
    """(query ids, ids, scores) of the k largest products of each query (rows of near) with the vectors (its columns).

    near are approximate products, -inf where a vector is no candidate, wrong
    by the norm of the query times `miss` at most, and by rounding.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(ids) or not len(q):
        return none
    norm = np.sqrt((q * q).sum(axis=1))
    size = np.sqrt((vecs * vecs).sum(axis=1)) + miss
    likely = np.argpartition(-near, min(k, len(ids)) - 1, axis=1)[:, :k]
    seed = np.where(np.isfinite(np.take_along_axis(near, likely, axis=1)), np.einsum("qkd,qd->qk", vecs[likely], q), -np.inf)
    reach = near + norm[:, None] * (miss + 1e-5 * size)
    may = np.isfinite(near) & (reach >= kth(seed, k)[:, None])
    some = np.flatnonzero(may.any(axis=0))
    product = np.where(may[:, some], q @ vecs[some].T, -np.inf)
    # Rounding of a matrix product depends on the place: what it can't tell apart is summed alike for all.
    at, column = np.nonzero(np.isfinite(product) & (product >= (kth(product, k) - 1e-12 * norm * size.max())[:, None]))
    column = some[column]
    score = np.concatenate([np.zeros(0), *((q[at[i : i + 65536]] * vecs[column[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536))])
    order = np.lexsort((ids[column], -score, at))
    at, column, score = at[order], column[order], score[order]
    own = np.arange(len(at)) - np.searchsorted(at, at) < k
    return q_ids[at[own]], ids[column[own]], score[own]


def build(rows: DataFrame, lists: int | None = None, train: int = TRAIN) -> tuple[Index, DataFrame] | None:
    """The index and its blocks (lists, ids, codes, misses, copies, vectors) of usable rows; none without rows.

    Every row is indexed; the sample is drawn by a hash of the id.
    """
    n = rows.count()
    if not n:
        return None
    lists = lists or max(1, min(TRAINED_LISTS, round(math.sqrt(n))))
    part = min(1.0, max(train, PER_LIST * lists) / n)
    drawn = rows.where(F.pmod(fold(F.col("vec_id"), 7), F.lit(1 << 20)) < F.lit(math.ceil(part * (1 << 20))))
    sample = drawn.select("vec").toArrow().column("vec").combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("vec").toArrow().column("vec").combine_chunks()
    d = len(sample[0])
    index = Index(matrix(sample, d), lists)
    index.probes = index.calibrate(matrix(sample, d))
    per = index.per
    shared = rows.sparkSession.sparkContext.broadcast(index)  # TRAINED_LISTS centroids at most and 256 codes a sub-vector

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), d)
                own, codes, miss = shared.value.encode(x)
                arrays = [pa.array(own, pa.int32()), batch.column(0), *(pa.array([c.tobytes() for c in y], pa.binary()) for y in (x, codes)), pa.array(miss, pa.float32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["list", "vec_id", "vec", "code", "miss"])

    coded = written(rows.mapInArrow(encode, "list int, vec_id long, vec binary, code binary, miss float"), "ann-codes")
    coded = coded.withColumn("group", F.floor(F.col("list") / per).cast("int"))
    counts = {r.group: r.n for r in coded.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row a group
    salts = F.array(*[F.lit(-(-counts.get(i, 1) // BLOCK)) for i in range(-(-len(index.centroids) // per))])
    dealt = coded.withColumn("salt", F.pmod(fold(F.col("vec_id"), 8), F.get(salts, F.col("group"))))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out(keys):
            got = []
            for key in list(keys):
                part = sorted(held.pop(key))  # by list, then id
                lists, ids, vecs, codes, miss = zip(*part, strict=True)
                numbers = [np.array(x, t).tobytes() for x, t in ((lists, np.int32), (ids, np.int64), (miss, np.float32), (copies(part), np.int32))]
                got.append((key[0], *numbers, b"".join(codes), b"".join(vecs)))
            kinds = (pa.int32(), *[pa.binary()] * 6)
            names = ["group", "lists", "ids", "miss", "copies", "codes", "vecs"]
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for g, salt, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held.setdefault((g, salt), []).append(tuple(row))
                if len(held[g, salt]) >= 2 * BLOCK:
                    yield out([(g, salt)])
        yield out(held)

    blocks = dealt.repartition("group", "salt").select("group", "salt", "list", "vec_id", "vec", "code", "miss")
    schema = "group int, lists binary, ids binary, miss binary, copies binary, codes binary, vecs binary"
    return index, written(blocks.mapInArrow(block, schema), "ann-blocks")


def search(queries: DataFrame, rows: DataFrame, built: tuple[Index, DataFrame] | None, k: int, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query of (vec_id, vec)."""
    spark = rows.sparkSession
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, blocks = built
    d, per = index.d, index.per
    probes = probes or index.probes
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = np.asarray(batch.column(0)), []
            x = matrix(batch.column(1), d) if batch.num_rows else np.zeros((0, d))
            probed = shared.value.probed(x, probes)
            for group in range(-(-probed.shape[1] // per)):
                part = probed[:, group * per : (group + 1) * per]
                asking = np.flatnonzero(part.any(axis=1))
                for i in range(0, len(asking), QUERY_BLOCK):
                    own = asking[i : i + QUERY_BLOCK]
                    out.append((group, ids[own].tobytes(), x[own].tobytes(), np.packbits(part[own], axis=1).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            names = ["q_group", "q_ids", "q_vecs", "q_lists"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int32, np.int64, np.float32, np.int32, np.uint8, np.float64, np.int64, np.float64, np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):  # a block and a few queries
                lists, ids, miss, before, codes, vecs, q_ids, q, probed = (
                    np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, kinds, strict=True)
                )
                first = lists[0] // per * per
                probed = np.unpackbits(probed.reshape(len(q_ids), -1), axis=1).astype(bool)
                few = np.flatnonzero(before < k)
                lists, ids, miss = lists[few], ids[few], miss[few]
                codes, vecs, q = codes.reshape(len(before), -1)[few], vecs.reshape(-1, d)[few], q.reshape(-1, d)
                near = shared.value.scores(q, probed, first, lists, codes)
                near[q_ids[:, None] == ids[None, :]] = -np.inf
                arrays = best(q_ids, q, ids, vecs, near, miss, k)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["query_id", "vec_id", "score"])

    dealt = queries.select("vec_id", "vec").mapInArrow(deal, "q_group int, q_ids binary, q_vecs binary, q_lists binary")
    met = blocks.join(dealt, F.col("group") == F.col("q_group")).select("lists", "ids", "miss", "copies", "codes", "vecs", "q_ids", "q_vecs", "q_lists")
    scored = met.mapInArrow(score, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows.where("vec_id % 20 = 0"), rows, build(rows), k=20)


QUERIES = {"op7_ann": op7_ann}
ORACLE_SQL: dict[str, str] = {}
