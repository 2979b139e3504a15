"""The prefix trie of conversations, by range shards and a skeleton of splitters.

A conversation is the path of its turns: 16 bytes of a SHA-256 for each turn's
role and text, so all conversations that start alike lie side by side in the
order of paths. Real conversations (path, conv_id), drawn from all of them by a
hash of the id, are splitters that cut this order into shards of about SHARD
turns. The order goes on through the ids, so copies of one conversation, however
many, are dealt over as many shards as their number asks for.

A node whose members lie in two shards is a prefix of the splitter between them.
The trie of the splitters, the skeleton, is broadcast. A task reads a shard in
order, holds the open path, and finishes every other node by itself. For nodes
of the skeleton it gives partial sums, which one small aggregation combines. A
splitter is itself the first conversation of its shard; so each shard knows what
follows its last one, and each leaf and each child of the skeleton is counted in
one shard, as is the one member that saves nothing.

The ids that end at a skeleton node leave their shards as pieces of text, which
are hashed in order, a piece at a time; no list of ids is held.

Bounds: splitters are at most SPLITTERS, and about SPLITTER_BYTES of paths; past
that shards grow. A task holds the open path and the finished children of its
open nodes. A conversation's path (20 bytes a turn) must fit in one row. Texts
stay where they are: only hashes and lengths are shuffled.

Turns stand in the order of `turn` (null first), then role, then text; a
repeated row is a turn of its own. A null role or text is empty. Rows of no
conv_id belong to no conversation. An empty table has no node, not even the
root. Further columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import among, fold, table, tidy, written

#: Bytes of a turn in a path.
STEP = 16
#: Turns of a shard, at least.
SHARD = 8_192
SPLITTERS, SPLITTER_BYTES = 1 << 18, 64 << 20
#: Conversations drawn for each splitter.
DRAWN = 8
#: Ids of a piece of text, at most.
PIECE = 8_192
#: Nodes of the skeleton that are broadcast to their children, at most: about 64 MB.
BROADCAST = 1 << 20
OUT = 4_096

NODE = "conv_id long, depth long, parent long, up_owner int, up_depth long, n_convs long, n_children long, n_leaves long, saved long, ends binary"
FOUND = f"owner int, at long, piece long, text binary, {NODE}"


def turn_lists(messages: DataFrame) -> DataFrame:
    """(conv_id, turns array<(key, chars)>): each conversation's turns in order, by their hashes and lengths.

    Texts are read again only of conversations in which two different texts of one role share a place.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP))
    slim = messages.where("conv_id is not null").select(
        "conv_id", F.struct("turn", role.alias("role"), key.alias("key"), F.length(text).alias("chars")).alias("t")
    )
    lists = written(slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")), "trie-turns")
    same = lambda a, b: a["turn"].eqNullSafe(b["turn"]) & (a["role"] == b["role"]) & (a["key"] != b["key"])
    tied = F.exists(F.zip_with("t", F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.coalesce(same(a, b), F.lit(False))), lambda x: x)
    again = written(lists.where(tied).select("conv_id"), "trie-tied")
    bare = lambda t: F.transform(t, lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars")))
    if again.isEmpty():
        return lists.select("conv_id", bare(F.col("t")).alias("turns"))
    whole = among(messages, "conv_id", again).select(
        "conv_id", F.struct("turn", role.alias("role"), text.alias("text"), key.alias("key"), F.length(text).alias("chars")).alias("t")
    )
    whole = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rest = among(lists, "conv_id", again, out=True)
    return rest.select("conv_id", bare(F.col("t")).alias("turns")).unionByName(whole.select("conv_id", bare(F.col("t")).alias("turns")))


def paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path binary, chars array<int>) of lists of turns."""
    keys = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    return lists.select("conv_id", F.unhex(keys).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def rebuilt(lists: DataFrame, base: Column, first: Column, most: int) -> DataFrame:
    """Lists in which the first turns (so many: `first`, at most `most`) are those of conversation `base`."""
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = lists.withColumns({"own_base": base, "h": first}).alias("own")
    met = rows.join(heads, F.col("own_base") == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return met.select("conv_id", F.concat(head, own).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two paths have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    if n <= 16 * STEP:
        at = 0
        while a[at : at + STEP] == b[at : at + STEP]:
            at += STEP
        return at // STEP
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // STEP


class Skeleton:
    """The trie of the splitters: for each splitter, which is the first that has its first d turns."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.owners: list[np.ndarray] = []
        for i, (path, _) in enumerate(splitters):
            own = np.full(len(path) // STEP + 1, i, np.int32)
            kept = shared_turns(path, splitters[i - 1][0]) + 1 if i else 0
            own[:kept] = self.owners[i - 1][:kept] if i else 0
            own[0] = 0
            self.owners.append(own)

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def split(rows: DataFrame, shard: int) -> Skeleton:
    """The skeleton for all rows (conv_id, path, chars)."""
    n, turns = rows.select(F.count("*"), F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()
    size = max(1, turns * STEP // max(1, n))
    wanted = min(turns // shard, n - 1, SPLITTERS, SPLITTER_BYTES // size)
    if wanted < 1:
        return Skeleton([])
    part = math.ceil(min(1.0, DRAWN * (wanted + 1) / n) * (1 << 30))
    drawn = rows.where(F.pmod(fold(F.col("conv_id"), 11), F.lit(1 << 30)) < part).select("path", "conv_id")
    got = sorted(zip(*(c.to_pylist() for c in drawn.toArrow().columns), strict=True))
    # A conversation takes its turns' share of the order, so it is met by as many of the cuts.
    ends = np.cumsum([1 + len(p) // STEP for p, _ in got] or [0])
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, wanted + 1) / (wanted + 1))
    return Skeleton([got[i] for i in sorted(set(cuts.tolist()))] if got else [])


class Node:
    """An open node of the path that a task is at."""

    __slots__ = ("chars", "children", "convs", "deeper", "done", "first", "hashed", "ids", "key", "leaves", "pieces", "saved")

    def __init__(self, chars: int, key: tuple[int, int] | None):
        self.chars, self.key = chars, key
        self.convs = self.children = self.leaves = self.saved = self.pieces = 0
        self.first, self.deeper, self.hashed = None, False, None
        self.ids: list[int] = []
        self.done: list[list] = []


class Shard:
    """Reads one shard in order; `out` gathers rows of FOUND."""

    def __init__(self, number: int, skeleton: Skeleton, out: list):
        self.number, self.out = number, out
        at = lambda i: (skeleton.splitters[i][0], skeleton.owners[i]) if 0 <= i < len(skeleton.splitters) else (None, None)
        (self.low, self.low_owners), (self.high, self.high_owners) = at(number - 1), at(number)
        self.path, self.open = b"", [Node(0, (0, 0))]
        self.empty = True

    def owner(self, path: bytes, low: int, high: int, depth: int) -> tuple[int, int] | None:
        if depth <= low:
            return int(self.low_owners[depth]), depth
        return (int(self.high_owners[depth]), depth) if depth <= high else None

    def first_here(self, node: Node) -> bool:
        """Whether this shard, of all that share the node, counts it: that which begins with its first splitter."""
        return node.key is None or self.number == node.key[0] + 1

    def add(self, conv_id: int, path: bytes, chars: list[int]) -> None:
        if self.empty or path != self.path:
            kept = 0 if self.empty else shared_turns(path, self.path)
            while len(self.open) > kept + 1:
                self.close(later=True)
            depth = len(path) // STEP
            if depth > kept:
                self.open[-1].deeper = True
                low = shared_turns(path, self.low) if self.low is not None else -1
                high = shared_turns(path, self.high) if self.high is not None else -1
                for d in range(kept + 1, depth + 1):
                    node = Node(chars[d - 1], self.owner(path, low, high, d))
                    node.deeper = d < depth
                    self.open.append(node)
            self.path, self.empty = path, False
        node = self.open[-1]
        node.convs += 1
        if node.first is None or conv_id < node.first:
            node.first = conv_id
        node.ids.append(conv_id)
        if len(node.ids) >= PIECE:
            self.flush(node)

    def flush(self, node: Node) -> None:
        """Hash the ids that end here, or hand them on as a piece of text."""
        if not node.ids:
            return
        text = ",".join(map(str, node.ids)).encode()
        node.ids = []
        if node.key is not None:
            self.out.append((*node.key, (self.number << 32) + node.pieces, text, *[None] * 10))
        elif node.hashed is None:
            node.hashed = hashlib.sha256(text)
        else:
            node.hashed.update(b"," + text)
        node.pieces += 1

    def close(self, later: bool) -> None:
        """Finish the deepest open node; later: this shard goes on behind it."""
        depth = len(self.open) - 1
        node = self.open.pop()
        self.flush(node)
        if not node.deeper:
            follows = None if later else self.high
            node.leaves += follows is None or shared_turns(self.path[: depth * STEP], follows) < depth
        counted = self.first_here(node)
        node.saved += (node.convs - counted) * node.chars
        for row in node.done:
            row[6] = node.first
            self.out.append(tuple(row))
        up = self.open[-1] if self.open else None
        up_key = up.key if up and up.key else (None, None)
        ends = node.hashed.digest() if node.hashed else None
        row = [*(node.key or (None, None)), None, None, node.first, depth, None, *up_key, node.convs, node.children, node.leaves, node.saved, ends]
        if up is not None and up.key is None:
            up.done.append(row)
        else:
            self.out.append(tuple(row))
        if up is not None:
            up.convs += node.convs
            up.children += counted
            up.leaves += node.leaves
            up.saved += node.saved
            if up.first is None or node.first < up.first:
                up.first = node.first

    def end(self) -> None:
        while self.open:
            self.close(later=False)


def found(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Rows of FOUND: whole nodes (owner null), partial sums of skeleton nodes, and pieces of their ids (text not null)."""
    shared = rows.sparkSession.sparkContext.broadcast(skeleton)
    n = len(skeleton.splitters) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shards = [own.shard(p, i) for i, p in zip(ids, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], names=["shard", "conv_id", "path", "chars"])

    def table_of(out: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 5, pa.binary()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for batch in batches:
            for number, conv_id, path, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.number != number:
                    if at:
                        at.end()
                    at = Shard(number, shared.value, out)
                at.add(conv_id, path, chars)
                if len(out) >= OUT:
                    yield table_of(out)
                    out.clear()
        if at:
            at.end()
        yield table_of(out)

    dealt = rows.select("conv_id", "path", "chars").mapInArrow(deal, "shard int, conv_id long, path binary, chars array<int>")
    dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(tidy(finish), FOUND)


def hashed(pieces: DataFrame) -> DataFrame:
    """(owner, at, ends) of pieces of text (owner, at, piece, text): the hash of each node's pieces in order, joined by commas."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for owner, depth, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == (owner, depth):
                    state.update(b"," + text)
                    continue
                if at:
                    out.append((*at, state.digest()))
                at, state = (owner, depth), hashlib.sha256(text)
        if at:
            out.append((*at, state.digest()))
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["owner", "at", "ends"])

    ordered = pieces.select("owner", "at", "piece", "text").repartition("owner", "at").sortWithinPartitions("owner", "at", "piece")
    return ordered.mapInArrow(each, "owner int, at long, ends binary")


def trie(lists: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row a node of the trie of lists of turns (conv_id, turns), one list a conv_id.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = written(paths(lists), "trie-paths")
    parts = written(found(rows, split(rows, shard)), "trie-nodes")
    sums = parts.where("owner is not null and text is null").groupBy("owner", "at").agg(
        F.min("conv_id").alias("conv_id"), F.first("up_owner").alias("up_owner"), F.first("up_depth").alias("up_depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    ends = hashed(parts.where("text is not null"))
    bones = written(sums.join(ends, ["owner", "at"], "left"), "trie-skeleton")
    few = bones.count() <= BROADCAST
    up = bones.select(F.col("owner").alias("o"), F.col("at").alias("a"), F.col("conv_id").alias("up_conv"))
    whole = parts.where("owner is null").select("conv_id", "depth", "parent", "up_owner", "up_depth", "n_convs", "n_children", "n_leaves", "saved", "ends")
    bones = bones.select("conv_id", F.col("at").alias("depth"), F.lit(None).cast("long").alias("parent"), *whole.columns[3:])
    nodes = whole.unionByName(bones)
    met = nodes.join(F.broadcast(up) if few else up, (F.col("up_owner") == F.col("o")) & (F.col("up_depth") == F.col("a")), "left")
    return met.select(
        "conv_id", "depth", F.coalesce("parent", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = turn_lists(table(spark, sf_dir, "conversations"))
    first = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    return trie(rebuilt(lists, F.col("conv_id") - F.col("conv_id") % 100, first, most=5))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": r"""
with bytes as (
  select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as crc
  from (select cast(range as bigint) as i from range(256))),
rows as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) % 6 as h
  from (select distinct conv_id from rows), bytes),
turns as (
  select c.conv_id, 0 as part, r.k, r.role, r.text from convs c join rows r on r.conv_id = c.base and r.k <= c.h
  union all select c.conv_id, 1, r.k, r.role, r.text from convs c join rows r on r.conv_id = c.conv_id and r.k > c.h),
paths as (
  select conv_id, coalesce(list(sha256(length(role) || ':' || role || text) order by part, k) filter (part is not null), []) as path,
    list(length(text) order by part, k) filter (part is not null) as chars
  from convs left join turns using (conv_id) group by conv_id),
starts as (
  select conv_id, array_to_string(path[1:d], '') as node, d, d = len(path) as ends, case when d = 0 then 0 else chars[d] end as chars
  from (select *, unnest(range(0, len(path) + 1)) as d from paths)),
nodes as (
  select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from starts group by node, d),
children as (select node[:-65] as node, count(*) as n from nodes where depth > 0 group by 1),
marked as (select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c using (node)),
sums as (
  select node[:64 * up] as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as up from marked) group by 1)
select m.conv_id, m.depth, p.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, m.ends_sha256
from marked m join sums s using (node) left join nodes p on m.depth > 0 and p.node = m.node[:-65]
"""
}
