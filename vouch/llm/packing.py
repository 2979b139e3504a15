"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents one after another. In every
round each source earns a credit in proportion to its share of the mixture and
serves as many whole grains (of `grain` tokens) as its credit covers; what is
left over is its deficit, carried into the next round. The tokens in the order
of service fill windows of `window` tokens back to back, so every window but
the last is full and holds the sources in their target shares to within a
grain each.

As a queue that still has tokens is served exactly up to its credit, the round
in which a token leaves is ceil(grain's end / credit): a closed form of its
place in its queue. The whole sequence is all grains in the order of round,
queue and place, and a token's place in it is the number of tokens before it.
So no task walks the queues: rounds are arithmetic on columns, places are one
running sum, and deficits carry across windows and partitions by both.

Jobs: (1) tokenise, and write (ids, place in the task's part of the queue) to
the shared folder; (2) sum tokens by task and source, and turn these sums into
each source's total and credit and each task's start in each queue, all of them
tables; (3) cut each document, as numbers without its ids, where its round
changes, deal these runs by ranges of (round, queue, place), and sum their
lengths in each range; (4) join each document's runs to its ids, and cut them at
windows. No text or token is shuffled by source, and a range is as small when
one source holds a third of all rows as when a million sources share a round.
Every source has its own queue and any number of them a weight. What the driver
takes is one number a range (a partition of job 3).

Null texts are empty and yield the end token alone; null sources are a queue
of their own; repeated rows are packed each on its own; an empty table gives no
sequence. Documents of a source come in the order of tasks and rows; of sources
with as many tokens the first by name comes first. Further columns are not
looked at, whatever their names. A very long text needs memory for its own ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.common import small, table, tidy, written
from vouch.llm.jaccard import SPACE, words_of

WINDOW, GRAIN, END = 4096, 256, 2
#: Credits are whole numbers of 1/UNIT tokens a round.
UNIT = 1 << 12
TOKENIZER = "word_bpe_49k.json"
#: Words kept with their ids in a task, about; when full, the table starts anew.
CACHED_WORDS = 1_000_000
#: Texts of these characters alone are cut at white space and looked up word by word: for them NFC changes nothing,
#: lower-casing looks at one character at a time, and white space means the same to Python and to the tokenizer.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
#: Fixed value: the pieces that this tokenizer cuts a text into, for such texts.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 20

class Tokens:
    """Ids of texts, by a table of the ids of white-space-separated words.

    Words are looked up by 64-bit hashes, all those of many texts at once. Ids
    are little-endian unsigned 16-bit (32-bit for larger vocabularies).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # of the tokens that end a piece of a word
        for token, number in self.tokenizer.get_vocab().items():
            self.last[number] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """Forget all words: hashes in order, where the ids of each begin in the pool and end, and what of the pool is used."""
        self.known = np.zeros(0, np.uint64)
        self.begin = self.end = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.type), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one word after another, and how many each has: encoded as one text, cut at the words' ends."""
        pieces = np.array([1 if w.isalpha() else len(PIECE.findall(w)) for w in words])
        ids = self.encode([" ".join(words)])[0]
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != pieces.sum() or (len(ids) and ends[-1] != len(ids)):
            own = self.encode(words)
            return np.concatenate(own), np.array(list(map(len, own)))
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(pieces)], prepend=0)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Enter words that aren't known, by their hashes in order."""
        sizes = []
        for k in range(0, len(words), 1000):
            ids, size = self.ids_of(words[k : k + 1000])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), self.type)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            sizes.append(size)
        size = np.concatenate(sizes)
        end = self.used - size.sum() + np.cumsum(size)
        at = np.searchsorted(self.known, hashes)
        self.begin, self.end = np.insert(self.begin, at, end - size), np.insert(self.end, at, end)
        self.known = np.insert(self.known, at, hashes)

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of lower-case texts of plain characters."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        cut = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
        # A full stop or comma between a letter and a space is a word of its own: it is a piece of its own, and words without are fewer.
        stop = np.flatnonzero((data[1:] == 46) | (data[1:] == 44)) + 1
        after = np.append(data, np.uint8(32))[stop + 1]
        stop = stop[(data[stop - 1] >= 97) & (data[stop - 1] <= 122) & SPACE[after] & ~np.isin(stop, cut)]
        hashes, _, starts = words_of(data, np.sort(np.concatenate([cut, stop])))
        count = np.diff(np.searchsorted(starts, cut))
        if not len(hashes):
            return [b""] * len(texts)
        if len(self.known) > CACHED_WORDS or self.used > 8 * CACHED_WORDS:
            self.clear()
        some, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, some)
        new = np.ones(len(some), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != some[inside]
        new = np.flatnonzero(new)
        if len(new):
            ends = np.append(starts[1:], len(data))  # a word, and the space behind it
            words = [data[starts[i] : ends[i]].tobytes().decode().rstrip() for i in first[new].tolist()]
            self.learn(some[new], words)
            at = np.searchsorted(self.known, some)
        row = at[which]
        begin, size = self.begin[row], self.end[row] - self.begin[row]
        cut = np.concatenate([[0], np.cumsum(size)])
        raw = self.pool[np.repeat(begin - cut[:-1], size) + np.arange(cut[-1])].tobytes()
        edges = (cut[np.concatenate([[0], np.cumsum(count)])] * self.type.itemsize).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, as the tokenizer gives for the whole of each."""
        out, plain, size = [b""] * len(texts), {}, 0

        def flush():
            for i, ids in zip(plain, self.plain(list(plain.values())), strict=True):
                out[i] = ids
            plain.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if not PLAIN.fullmatch(t) or "<|" in t:
                out[i] = self.encode([t])[0].tobytes()
                continue
            plain[i] = t.lower().encode()
            size += len(plain[i])
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return out


def tokenise(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, source, ids, n_tokens, with each row's task (part), its number there (row) and its tokens' place in that task's queue (local).

    path: a tokenizer file, or none for the public word BPE.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, part, places, rows = Tokens(path), TaskContext.get().partitionId(), {}, 0
        tail = np.array([end], lookup.type).tobytes()
        width = lookup.type.itemsize
        for batch in small(batches):
            ids = [x + tail for x in lookup.of(batch.column(2).to_pylist())]
            local = []
            for source, x in zip(batch.column(1).to_pylist(), ids, strict=True):
                local.append(places.get(source, 0))
                places[source] = local[-1] + len(x) // width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64()),
                 pa.array([part] * len(ids), pa.int64()), pa.array(range(rows, rows + len(ids)), pa.int64()), pa.array(local, pa.int64())],
                names=["doc_id", "source", "ids", "n_tokens", "part", "row", "local"],
            )
            rows += len(ids)

    return docs.select("doc_id", "source", "text").mapInArrow(
        tidy(each), "doc_id long, source string, ids binary, n_tokens long, part long, row long, local long"
    )


def queues(sums: DataFrame, weights: dict[str | None, float], window: int) -> DataFrame:
    """(source, total, credit) of every source: its tokens, and what it earns a round in 1/UNIT tokens.

    A source with a weight has that share of all tokens, others their own; an
    end that comes earlier leaves a queue's place to the others.
    """
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    if weights:
        named = sums.sparkSession.createDataFrame(list(weights.items()), "named string, weight double")
        totals = totals.join(named, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    else:
        totals = totals.withColumn("weight", F.lit(None).cast("double"))
    totals = written(totals, "queue-totals")
    whole, kept, given = totals.agg(F.sum("total"), F.sum(F.when(F.col("weight").isNull(), F.col("total"))), F.sum("weight")).first()
    shares = (kept or 0) + (given or 0.0) * (whole or 0)
    share = F.coalesce(F.col("weight") * F.lit(float(whole or 0)), F.col("total").cast("double")) / F.lit(max(float(shares), 1e-300))
    return totals.select("source", "total", F.greatest(F.lit(1), F.rint(share * window * UNIT).cast("long")).alias("credit"))


def runs(rows: DataFrame, grain: int) -> DataFrame:
    """(part, row, source, total, turn, first, start, length): rows cut into runs of grains of one round.

    rows: part, row, source, total, credit, and the place of its tokens in the
    queue: begin and n_tokens. A run's first token stands at `first` in its
    queue and at `start` in its row.
    """
    turn = lambda g: f"((least(({g} + 1) * {grain}, total) * {UNIT} + credit - 1) div credit)"
    begin, last = f"(begin div {grain})", f"((begin + n_tokens - 1) div {grain})"
    heads = f"filter(sequence({begin}, {last}), g -> g = {begin} or {turn('g')} <> {turn('g - 1')})"
    cut = rows.withColumn("heads", F.expr(heads)).select("*", F.posexplode("heads").alias("at", "g"))
    cut = cut.withColumn("first", F.expr(f"greatest(g * {grain}, begin)"))
    cut = cut.withColumn("last", F.expr(f"coalesce(get(heads, at + 1) * {grain}, begin + n_tokens)"))
    return cut.select("part", "row", "source", "total", F.expr(turn("g")).alias("turn"), "first", F.expr("first - begin").alias("start"), F.expr("last - first").alias("length"))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (part, row, start, length) of one range in order, with the range and how many of its tokens stand before each."""
    task, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = before + np.cumsum(np.asarray(batch.column(3)))
        offset = ends - np.asarray(batch.column(3))
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(offset), pa.int64()), pa.array(offset, pa.int64())], names=RUN)


RUN = ["part", "row", "start", "length", "task", "offset"]


def pieces(row: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, start, length, window, offset) of the pieces that the runs of rows, at places of the whole sequence, are cut into."""
    order = np.lexsort((start, row))
    row, start, length, at = (x[order] for x in (row, start, length, at))
    # Runs that meet in the sequence are one piece; then pieces are cut at the windows.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + length[:-1])
    head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
    row, first, last, at = row[head], start[head], (start + length)[tail], at[head]
    cuts = (at + last - first - 1) // window - at // window + 1
    part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    row, first, last, at = (np.repeat(x, cuts) for x in (row, first, last, at))
    number = at // window + part
    begin = np.maximum(number * window, at)
    end = np.minimum((number + 1) * window, at + last - first)
    return row, begin - at + first, end - begin, number, begin - number * window


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, window: int = WINDOW, grain: int = GRAIN,
         path: str | None = None, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and ids.

    ids are little-endian unsigned 32-bit; without with_ids only their CRC-32
    is returned.

    weights: target token shares by source, in proportion, of any number of
    sources; sources that it doesn't name keep their share of the tokens. By
    default all do.
    """
    rows = written(tokenise(docs, path, end), "tokens")
    sums = written(rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")), "token-sums")
    credits = queues(sums, weights or {}, window).withColumnRenamed("source", "queue")
    starts = sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))  # a row a task
    starts = starts.join(credits, F.col("source").eqNullSafe(F.col("queue")))
    starts = written(starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "base", "total", "credit"), "token-starts")

    own = rows.select("source", "part", "row", "n_tokens", "local").join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    own = own.withColumn("begin", F.col("base") + F.col("local"))
    order = [F.col("turn"), F.col("total").desc(), F.col("source").asc_nulls_first(), F.col("first")]
    dealt = runs(own, grain).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.select(*RUN[:4]).mapInArrow(numbered, ", ".join(f"{c} long" for c in RUN))
    placed = written(placed, "token-runs")
    sizes = {r.task: r.n for r in placed.groupBy("task").agg(F.sum("length").alias("n")).collect()}  # a number a range
    bases = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))])

    of = placed.groupBy(F.col("part").alias("p"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "length", "task", "offset")).alias("runs"))
    met = rows.join(of, (F.col("part") == F.col("p")) & (F.col("row") == F.col("r"))).select("doc_id", "source", "ids", "n_tokens", "runs")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if not batch.num_rows:
                continue
            doc, source, ids, n = (c.to_pylist() for c in batch.columns[:4])
            held = batch.column(4)
            row = np.repeat(np.arange(len(n)), np.asarray(held.value_lengths()))
            start, length, task, offset = (np.asarray(x) for x in held.flatten().flatten())
            found = list(zip(*(x.tolist() for x in pieces(row, start, length, bases[task] + offset, window)), strict=True))
            at = [f[0] for f in found]
            width = 2 if len(ids[0]) == 2 * n[0] else 4
            own = [ids[i][s * width : (s + k) * width] for i, s, k, _, _ in found]
            if width == 2:
                own = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in own]
            columns = [
                pa.array([doc[i] for i in at], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)),
                pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array([n[i] for i in at], pa.int64()),
                *(pa.array([f[k] for f in found], pa.int64()) for k in (3, 4)), pa.array([source[i] for i in at], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array(own, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return met.mapInArrow(tidy(each), schema + ", ids binary" * with_ids)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
