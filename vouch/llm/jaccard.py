"""Set similarity join of word n-grams by universe partition and pigeonhole.

A document is the set of its distinct n-word shingles, as 64-bit hashes. Two
sets with Jaccard similarity t or more differ in at most
d = (1 - t) / (1 + t) * (size + size) shingles. Sizes are cut into bands, and in
each band all shingles are hashed into segments. A set is indexed by what its
segments hold, in its own band and, if a partner may be there, in the next;
documents meet where such signatures are equal.

The segments of a band are a mixture of two kinds:

* a whole segment has one signature, its content, and two sets miss each other
  there only if they differ in it at least once;
* a one-deletion segment, twice or more as wide, has a signature for its content
  and for its content less each one shingle, so two sets miss each other there
  only if they differ in it at least twice.

With z one-deletion segments, d + 1 - 2 z whole ones suffice. `Bands` takes the
z and the width of least cost: a signature costs 1, and more for each unrelated
set that is likely to share its content. Those grow with the number of sets and
shrink with the content, so small collections take whole segments and large
ones take more and more of the wider one-deletion segments. On top of these
come `slack` whole segments: as two similar sets then agree in more than the
slack, each set leaves out as many, the thinnest by size and then place. Of the
segments two sets agree in, ordered so, each leaves out a first part no longer
than the slack, so both keep the last one. What is indexed are the thickest
segments, which few other sets share.

What meets is compared in three steps, each exact:

1. Each set carries a bitmap in which every shingle flips one bit. Two sets differ
   in at least as many shingles as their bitmaps do in bits, so pairs that differ
   in too many bits are no links. All but links and few others fall here.
2. Every set of a group (of equal signatures) is verified against the first of its
   group, on the whole sets; links join sets to classes. In groups that still hold
   several classes, what is outside the largest is verified against one more set
   of that, TURNS times.
3. In groups that then still hold several classes, sets of different classes are
   compared by their bitmaps in the join itself, all but the group's largest
   class with all others, and what is left is verified.

Members of a class that is already connected need no further pair. Nothing is
left out, so the classes are exact.

Documents with equal sets are one from the start (a set is named by its hash),
and a set is indexed once a task, however often it occurs there. Within a slice
of a task the sets of a signature are brought under its first set before
anything is shuffled, and signatures that were shared in a slice are known in
the slices after it, so one that a third of all sets have is about a row a task
there. Copies, whatever their number, cost one short row each.

Texts are lower-cased (A-Z), words are runs of characters other than space and
\\x09-\\x0D. With fewer words than n the whole sequence is the one shingle. Null
and blank texts have no shingle, link with nothing and are a class of their
own; an empty table has no class. Texts are hashed in pieces of PIECE bytes, so a
very long one needs memory for its words alone. Rows that repeat a doc_id are
one document with each of its texts: what links to one is in the class of all.
Classes don't depend on the order of rows. Further columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.common import among, fresh, table, tidy, written

#: Similarity as a fraction, and words of a shingle, of the registered query.
SIMILARITY, WORDS = (85, 100), 4
BAND = 1.35  # ratio of the largest to the smallest size of a band
#: Segments beyond those needed, as a share of d: left out again, so they cost no row and spare the thinnest.
SLACK = 0.15
#: Cost model: a signature of c shingles meets CHANCE * sets * SHARED ** c unrelated sets, fewer for sets of over SHORT
#: shingles (the smaller a set, the larger the part of it that a line or passage of many documents makes up), and each
#: costs as much as PAIR signatures. One-deletion segments are WIDTHS times as wide as whole ones.
CHANCE, SHARED, SHORT, PAIR, WIDTHS = 1e-3, 0.25, 10, 4.0, (1, 2, 3)
#: Bits of a set's bitmap, and the longs that hold them.
BITS = 1024
LONGS = BITS // 64
#: Bytes of text hashed together; bytes and documents whose signatures are brought together in a task.
PIECE, SLICE, SLICE_DOCS = 1 << 17, 1 << 21, 1024
#: Sets, and signatures shared in a slice, that a task remembers; beyond that they cost more rows.
KNOWN = 200_000
#: Times that sets outside their group's largest class try one more set of it, before all are compared.
TURNS = 1
#: Edges that one task joins into classes, at most.
EDGES = 500_000
U = np.uint64
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def drawn(n: int, salt: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + mixed(np.array([salt], U)))


#: A word's hash is the mixed sum, over its bytes (A-Z lower-cased), of a number for the byte times one for its place.
BYTE = drawn(256, 1)[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
PLACE, FAR = drawn(64, 2) | U(1), drawn(1, 3)[0] | U(1)
#: A shingle's hash is the mixed sum of its words' hashes times numbers for their places; a short text is filled with PAD.
STEP, PAD = drawn(64, 4) | U(1), drawn(1, 5)[0]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts, one after another, and where each begins and ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    cut = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data if data else b"", np.uint8)[cut[0] : cut[-1]], cut - cut[0]


def words_of(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of texts, how many each text has, and where in data they begin."""
    hashes, starts, begin = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while begin < len(data):
        end = min(len(data), begin + PIECE)
        if end < len(data):  # at a space or between texts, so that no word is cut
            spaces = np.flatnonzero(SPACE[data[begin:end]])
            texts = cut[(cut > begin) & (cut <= end)]
            last = max(int(spaces[-1]) + begin + 1 if len(spaces) else 0, int(texts[-1]) if len(texts) else 0)
            while last <= begin:  # one word fills the piece: look for its end
                spaces = np.flatnonzero(SPACE[data[end : end + PIECE]])
                ends = [int(x) for x in (spaces[:1] + end, cut[(cut > end) & (cut <= end + PIECE)][:1]) for x in x]
                end = min(len(data), end + PIECE)
                last = min(ends) if ends else end if end == len(data) else begin
            end = last
        part, edges = data[begin:end], cut[:-1][(cut[:-1] >= begin) & (cut[:-1] < end)] - begin
        space = SPACE[part]
        new = ~space
        new[1:] &= space[:-1]
        new[edges] = ~space[edges]
        at = np.flatnonzero(new)
        if len(at):
            place = np.zeros(len(part), np.int32)
            place[at] = at
            np.maximum.accumulate(place, out=place)
            place = np.arange(len(part), dtype=np.int32) - place
            weight = PLACE[place & 63]
            if place.max() >= 64:
                weight = weight + (place >> 6).astype(U) * FAR
            value = BYTE[part] * weight
            value[space] = 0
            hashes.append(np.add.reduceat(value, at))
            starts.append(at + begin)
        begin = end
    starts = np.concatenate(starts)
    return mixed(np.concatenate(hashes)), np.diff(np.searchsorted(starts, cut)), starts


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and where each text's begin and end."""
    words, count, _ = words_of(*bytes_of(texts))
    if ((count > 0) & (count < n)).any():
        short = (count > 0) & (count < n)
        words = np.insert(words, np.repeat(np.cumsum(count)[short], n - count[short]), PAD)
        count = np.where(short, n, count)
    size = np.where(count > 0, count - n + 1, 0)
    cut = np.concatenate([[0], np.cumsum(size)])
    if not len(words):
        return words, cut
    out = words[: len(words) - n + 1] * STEP[0]
    for i in range(1, n):
        out += words[i : len(words) - n + 1 + i] * STEP[i % 64]
    inside = np.ones(len(words), bool)
    ends = np.cumsum(count)[count > 0]
    for i in range(1, n):
        inside[ends - i] = False
    out = mixed(out[inside[: len(out)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[cut[:-1][size > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


def runs(texts: pa.Array, size: int = PIECE, most: int = SLICE_DOCS) -> Iterator[slice]:
    """A column in runs of about so many bytes and at most so many texts."""
    _, cut = bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = min(begin + most, max(begin + 1, int(np.searchsorted(cut, cut[begin] + size, "right")) - 1))
        yield slice(begin, end)
        begin = end


def hashed(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `shingles`, a piece at a time."""
    parts = [shingles(texts[r.start : r.stop], n) for r in runs(texts)]
    own = np.concatenate([np.zeros(0, U), *[x for x, _ in parts]])
    return own, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(c) for _, c in parts]]))])


def names_of(own: np.ndarray, cut: np.ndarray) -> list[int | None]:
    """Each set's own hash; none for the empty set."""
    import xxhash

    return [
        xxhash.xxh3_64_intdigest(own[a:b].tobytes()) - 2**63 if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
    ]


def bitmaps(own: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row of LONGS longs for each set: every shingle flips one bit."""
    sets = len(cut) - 1
    bit = np.repeat(np.arange(sets), np.diff(cut)) * BITS + (own & U(BITS - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=sets * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(sets, LONGS)


class Layout(NamedTuple):
    """Segments of a band: whole ones (slack of them more than needed), and one-deletion ones, `width` times as wide."""

    whole: int
    slack: int
    deletion: int
    width: int


class Bands:
    """Size bands for a similarity p / q, and each band's layout of least cost for so many sets."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY, sets: int = 100_000):
        self.p, self.q = similarity
        self.sets = sets
        self.first = [1]

    def last(self, band: int) -> int:
        """The largest size of a band."""
        while len(self.first) <= band + 1:
            a = self.first[-1]
            self.first.append(max(self.most(a), math.floor(a * BAND)) + 1)
        return self.first[band + 1] - 1

    def most(self, size: int) -> int:
        """The largest size of a partner."""
        return size * self.q // self.p

    def changes(self, a: int, b: int) -> int:
        """Shingles in which linked sets of these sizes differ, at most."""
        return (self.q - self.p) * (a + b) // (self.q + self.p)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of some size is indexed: its own, and the next if a partner may be there."""
        band = 0
        while self.last(band) < size:
            band += 1
        return [band, band + 1] if self.most(size) > self.last(band) else [band]

    def cost(self, band: int, deletion: int, width: int) -> float:
        """Of the signatures of a set of the band's mean size, and of the unrelated sets that they meet."""
        d, size = self.changes(self.last(band), self.last(band)), (self.first[band] + self.last(band)) / 2
        whole = max(0, d + 1 - 2 * deletion)
        thin = size / (whole + width * deletion)
        met = lambda c: PAIR * CHANCE * self.sets * min(1, SHORT / size) * SHARED ** max(0, c)
        wide = width * thin
        return whole * (1 + met(thin)) + deletion * (1 + met(wide) + wide * (1 + met(wide - 1)))

    @lru_cache(maxsize=None)  # noqa: B019
    def layout(self, band: int) -> Layout:
        d = self.changes(self.last(band), self.last(band))
        some = sorted({round(k * (d + 1) / 64) // 2 for k in range(65)})  # up to 33 numbers of one-deletion segments
        _, deletion, width = min((self.cost(band, z, w), z, w) for z in some for w in (WIDTHS if z else WIDTHS[:1]))
        whole = max(0, d + 1 - 2 * deletion)
        slack = math.ceil(SLACK * d) if d >= 8 and whole else 0
        return Layout(whole + slack, slack, deletion, width)


def signatures(own: np.ndarray, cut: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of the signatures of sets, as two arrays."""
    size = np.diff(cut)
    out = [(np.zeros(0, np.int64), np.zeros(0, U))]
    at: dict[int, list[int]] = {}
    for i, n in enumerate(size.tolist()):
        for band in bands.of(n) if n else ():
            at.setdefault(band, []).append(i)
    for band, members in at.items():
        sets = np.array(members)
        n = size[sets]
        inside = np.repeat(cut[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += of_band(own[inside], n, sets, band, bands)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def of_band(own: np.ndarray, n: np.ndarray, sets: np.ndarray, band: int, bands: Bands) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for sets of one band; own are their shingles, n of each."""
    form, last = bands.layout(band), bands.last(band)
    m = form.whole + form.deletion
    place = ((own >> U(32)) * U(form.whole + form.width * form.deletion)) >> U(32)
    place = np.where(place < form.whole, place, form.whole + (place - U(form.whole)) // U(form.width)).astype(np.int64)
    segment = np.repeat(np.arange(len(sets)) * m, n) + place
    total = len(sets) * m
    held = np.bincount(segment, minlength=total)
    low = np.bincount(segment, (own & U(0xFFFFFFFF)).astype(float), total).astype(U)  # exact: sums below 2 ** 53
    content = low + (np.bincount(segment, (own >> U(32)).astype(float), total).astype(U) << U(32))
    mark = mixed((np.arange(m, dtype=U) << U(16)) + U(band + 1))
    found = mixed(content.reshape(-1, m) + mark)

    # Whole segments but the thinnest: as many as the set's own largest number of changes leaves to spare.
    most = (bands.q - bands.p) * (n + np.minimum(last, n * bands.q // bands.p)) // (bands.q + bands.p)
    spare = form.whole - np.where(most < 2 * form.deletion, 0, most - 2 * form.deletion + 1)
    thick = np.zeros((len(sets), form.whole), bool)
    if form.whole:
        thickness = np.minimum(held.reshape(-1, m)[:, : form.whole], 65535).astype(np.uint16)
        order = np.argsort(thickness, axis=1, kind="stable")
        np.put_along_axis(thick, order, np.arange(form.whole) >= spare[:, None], axis=1)
    row, column = np.nonzero(thick)
    out = [(sets[row], found[row, column])]
    if form.deletion:
        rows = np.repeat(sets, form.deletion)
        out.append((rows, found[:, form.whole :].ravel()))
        some = place >= form.whole
        out.append((np.repeat(sets, n)[some], mixed(content[segment[some]] - own[some] + mark[place[some]])))
    return out


SETS = "doc_id long, n_shingles long, node long, bits array<long>, sigs array<long>, again array<long>, centers array<long>"


def sets(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """doc_id, n_shingles, and the name (node) and bitmap of each document's set, with its signatures.

    A set's signatures stand at its first row in a task. Those that an earlier
    set of its slice has too, or that are known to be shared in an earlier slice,
    stand in `again`, beside the first such set in `centers`; the others in `sigs`.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        shared = Shared()
        for batch in batches:
            for r in runs(batch.column(1), SLICE):
                yield signed(batch.slice(r.start, r.stop - r.start), n, bands, seen, shared)

    return docs.select("doc_id", "text").mapInArrow(tidy(each), SETS)


class Shared:
    """Signatures that several sets of an earlier slice of a task share, with the first of them."""

    def __init__(self) -> None:
        self.sigs, self.centers = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the signatures are known, and the set of each that is."""
        if not len(self.sigs):
            return np.zeros(len(sigs), bool), np.zeros(len(sigs), np.int64)
        at = np.minimum(np.searchsorted(self.sigs, sigs), len(self.sigs) - 1)
        return self.sigs[at] == sigs, self.centers[at]

    def add(self, sigs: np.ndarray, centers: np.ndarray) -> None:
        """More of them, none known yet; those beyond the room keep a row a slice."""
        room = max(0, KNOWN - len(self.sigs))
        if not room or not len(sigs):
            return
        sigs, centers = np.concatenate([self.sigs, sigs[:room]]), np.concatenate([self.centers, centers[:room]])
        order = np.argsort(sigs)
        self.sigs, self.centers = sigs[order], centers[order]


def signed(batch: pa.RecordBatch, n: int, bands: Bands, seen: set[int], shared: Shared) -> pa.RecordBatch:
    """The rows of a slice; seen: names of sets that have had their signatures."""
    rows = batch.num_rows
    own, cut = hashed(batch.column(1), n)
    size, nodes = np.diff(cut), names_of(own, cut)
    first = np.zeros(rows, bool)
    for k, node in enumerate(nodes):
        if node is not None and node not in seen:
            first[k] = True
            if len(seen) < KNOWN:
                seen.add(node)
    new = np.flatnonzero(first)
    inside = np.repeat(cut[:-1][new] - (np.cumsum(size[new]) - size[new]), size[new]) + np.arange(size[new].sum())
    at, sig = signatures(own[inside], np.concatenate([[0], np.cumsum(size[new])]), bands)
    row, sig = new[at], sig.view(np.int64)
    order = np.lexsort((row, sig))
    row, sig = row[order], sig[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    name = np.array([0 if x is None else x for x in nodes], np.int64)
    group = np.cumsum(head) - 1
    known, center = shared.of(sig)
    center = np.where(known, center, name[row[np.flatnonzero(head)[group]]])
    head &= ~known
    more = ~head & (name[row] != center)
    several = np.zeros(len(sig), bool)
    several[group[more & ~known]] = True
    new_shared = head & several[group]
    shared.add(sig[new_shared], center[new_shared])

    def lists(keep: np.ndarray, values: np.ndarray) -> pa.Array:
        of = row[keep]
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]), pa.int32())
        return pa.ListArray.from_arrays(cuts, pa.array(values[keep][np.argsort(of, kind="stable")]), mask=pa.array(~first))

    bits = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * LONGS, pa.int32()), pa.array(bitmaps(own, cut).ravel()))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(size), pa.array(nodes, pa.int64()), bits, lists(head, sig), lists(more, sig), lists(more, center)],
        names=["doc_id", "n_shingles", "node", "bits", "sigs", "again", "centers"],
    )


def groups_of(named: DataFrame) -> DataFrame:
    """(sig, center, node): sets that share a signature, each beside the first set of its slice or of all slices."""
    inside = named.select("node", F.explode(F.arrays_zip("again", "centers")).alias("m")).select(F.col("m.again").alias("sig"), F.col("m.centers").alias("center"), "node")
    rows = named.select("node", F.explode("sigs").alias("sig"))
    first = F.first("node").over(Window.partitionBy("sig").orderBy("node"))  # about a row a task and signature
    across = rows.withColumn("center", first).where("node <> center").select("sig", "center", "node")
    return across.unionByName(inside)


def may_link(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Whether two sets with columns `n_shingles` and `bits` may be linked, by their bitmaps; a and b name the two sides."""
    p, q = similarity
    apart = sum((F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    return (q + p) * apart <= (q - p) * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def met(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with their sets x and y."""
    left = contents.select(F.col("node").alias("na"), F.col("own").alias("x"))
    right = contents.select(F.col("node").alias("nb"), F.col("own").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    return both.select("a", "b", "x", "y")


def verified(pairs: DataFrame, contents: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""
    p, q = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(s.as_buffer(), U), np.frombuffer(t.as_buffer(), U)
                both = np.concatenate([s, t])
                both.sort()
                both = int((both[1:] == both[:-1]).sum())
                keep.append(q * both >= p * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return met(pairs, contents).mapInArrow(tidy(each), "a long, b long")


def contents_of(docs: DataFrame, known: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, own): the sets of some nodes, each from one of its documents."""
    wanted = known.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("wanted_id"))
    texts = among(docs.select("doc_id", "text"), "doc_id", wanted)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch.column(1)):
                own, cut = shingles(batch.column(1)[r.start : r.stop], n)
                rows = [own[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names_of(own, cut), pa.int64()), pa.array(rows, pa.binary())], names=["node", "own"])

    return texts.mapInArrow(tidy(each), "node long, own binary").where("node is not null").dropDuplicates(["node"])


def links(docs: DataFrame, known: DataFrame, pairs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """The links among pairs (a, b) of nodes."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    contents = written(contents_of(docs, known, nodes, n), "contents")
    return written(verified(pairs, contents, similarity), "links")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges (a, b): each node beside the smallest it is connected with here, if another."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    own = np.fromiter(root, np.int64, len(root))
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.array([find(x) for x in own.tolist()], np.int64))], names=["a", "b"])


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) of the nodes of edges (a, b) that a smaller node is connected with; root is the smallest.

    Tasks of at most about `most` edges each join what they hold; where that
    takes several tasks, alternating large-star and small-star steps (each a
    minimum by node and a join) bring the rest together, until nothing changes.
    Each round is written, so that its lineage is one round.
    """
    state = None
    edges = written(edges.select("a", "b").where("a <> b"), "edges")
    while True:
        tasks = max(1, math.ceil(edges.count() / most))
        edges = written(edges.coalesce(tasks).mapInArrow(joined, "a long, b long"), "edges")
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(df: DataFrame, column: str, classes: DataFrame, out: str) -> DataFrame:
    """df with the class of a node; a node without a smaller one in its class is its root."""
    own = classes.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(own, F.col(column) == F.col("_n"), "left").withColumn(out, F.coalesce("_r", column)).drop("_n", "_r")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links: only the links between classes are followed."""
    between = rooted(rooted(links, "a", classes, "ra"), "b", classes, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = components(between)
    again = rooted(classes.withColumnRenamed("root", "old"), "old", more, "root").select("node", "root")
    return written(again.unionByName(more), "classes")


def crowds(groups: DataFrame) -> DataFrame:
    """(sig, node) of the groups of three sets or more, in which not all pairs hold the group's center."""
    several = groups.groupBy("sig").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("sig").alias("s"))
    both = groups.join(several, F.col("sig") == F.col("s"), "left_semi")
    return both.select("sig", F.explode(F.array("node", "center")).alias("node")).distinct()


def opened(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, node, root, main) of the groups that hold several classes; main: whether the node is of the group's largest."""
    members = written(rooted(members, "node", roots, "root"), "members")
    sizes = members.groupBy("sig", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("sig").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("classes"))
    main = written(main.where("classes > 1").select(F.col("sig").alias("s"), "largest"), "open")
    rows = members.join(main, F.col("sig") == F.col("s"))
    return written(rows.select("sig", "node", "root", (F.col("root") == F.col("largest")).alias("main")), "opened")


def with_center(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): a set outside its group's largest class, and a set of that class, another in each turn."""
    center = rows.where("main").groupBy("sig").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("b"))
    center = written(center.select(F.col("sig").alias("s"), "b"), "centers")
    return rows.where("not main").join(center, F.col("sig") == F.col("s")).select(F.col("node").alias("a"), "b").distinct()


def apart(rows: DataFrame, known: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) of nodes of different classes of a group that may be linked.

    The largest class is only met by the others, not by itself.
    """
    rows = written(rows.join(known.select(F.col("node").alias("k"), "n_shingles", "bits"), F.col("node") == F.col("k")).drop("k"), "compared")
    x, y = rows.where("not main").alias("x"), rows.alias("y")
    other = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.main") | (F.col("x.node") < F.col("y.node")))
    found = x.join(y, other & may_link("x", "y", similarity))
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near(pairs: DataFrame, known: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that may be linked by their bitmaps."""
    x, y = known.alias("x"), known.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return both.where(may_link("x", "y", similarity)).select("a", "b")


def classes(docs: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    named = written(sets(docs, n, Bands(similarity, docs.count())), "sets")
    groups = written(groups_of(named), "groups")
    inside = groups.select(F.explode(F.array("node", "center")).alias("node")).distinct()
    # A set's signatures stand once a task, so these rows are as few, however many copies there are.
    known = named.where("sigs is not null").join(inside, "node", "left_semi").select("node", "n_shingles", "bits", "doc_id")
    known = written(known.dropDuplicates(["node"]), "known")

    # Texts of one document belong together.
    ids = named.where("node is not null and doc_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select(F.col("doc_id").alias("i"), "a")
    repeats = ids.join(several, F.col("doc_id") == F.col("i")).select("a", F.col("node").alias("b")).where("a <> b").distinct()
    pairs = near(groups.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), known, similarity)
    roots = components(links(docs, known, written(pairs, "pairs"), n, similarity).unionByName(repeats))

    members = written(crowds(groups), "crowds")
    for turn in range(TURNS + 1):
        rows = opened(members, roots)
        if rows.isEmpty():
            break
        pairs = near(with_center(rows, turn), known, similarity) if turn < TURNS else apart(rows, known, similarity)
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            roots = merged(roots, links(docs, known, pairs, n, similarity))

    least = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    least = rooted(least, "node", roots, "root")
    own = least.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
    placed = least.join(own.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("node").alias("m"), "component_id")
    placed = named.select("doc_id", "n_shingles", "node").join(written(placed, "components"), F.col("node") == F.col("m"), "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents, one of each class: that with the smallest doc_id.

    Of rows that repeat a doc_id the one with the smallest text (null first)
    stays; rows without a doc_id all stay.
    """
    placed = written(classes(docs, n, similarity), "placed")
    gone = placed.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    twice = placed.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("twice_id"))
    kept = among(docs, "doc_id", written(gone, "gone"), out=True)
    twice = written(twice, "twice")
    if twice.isEmpty():
        return kept
    rank = fresh("rank", docs.columns)
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = among(kept, "doc_id", twice).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return among(kept, "doc_id", twice, out=True).unionByName(once)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_jaccard": op1_jaccard}
ORACLE_SQL = {
    "op1_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 4
    then list_transform(range(1, len(w) - 2), lambda i: hash(w[i], w[i + 1], w[i + 2], w[i + 3])) when len(w) > 0 then [hash(w)] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from pair join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
reach as (select doc_id, doc_id as to_id from documents union select reach.doc_id, links.y from reach join links on links.x = reach.to_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(to_id) as component_id
from documents d left join n using (doc_id) join reach using (doc_id) group by all
"""
}
