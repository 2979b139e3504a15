"""Language identification of mixed-language text.

Words are runs of letters. Each word gets a score for every language: the sum
of the log probabilities of its letter trigrams. The script of its first letter
first narrows the candidates, as a language whose training words never use
that script can't claim the word. Viterbi decoding over the words, with a
penalty for each switch of language, then labels spans, and the language that
holds most letters is the text's.

The trigram counts are learned in Spark from a sample of whole labelled texts,
drawn by a hash of the id: all texts of a language that has up to TRAIN_DOCS,
about so many of any other, and of long texts fewer (TRAIN_BYTES). So the model
and the time to learn it don't grow with the corpus, and a rare language is
learned like a frequent one. A model holds at most ENTRIES pairs of trigram and
language, about 64 MB, whatever stands in the column of languages; the bound is
on what is learned, as the sample's is. Prediction covers every text, whole, and looks at
nothing but the text.

Null texts and texts without a letter are `und` with score 0; so is every text
when nothing can be learned. Of languages with as many letters the
alphabetically first is taken. Rows that repeat are labelled each on its own;
an empty table gives none. A very long text needs memory for its own letters
and words. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import fold, table

#: Expected number of labelled texts learned from, for each language.
TRAIN_DOCS = 4_000
#: Expected bytes of text learned from, all languages together, each as much; languages learned, the most frequent ones;
#: (trigram, language) pairs in a model, the most frequent ones.
TRAIN_BYTES, LANGS, ENTRIES = 1 << 29, 1 << 10, 1 << 23
#: Scores that are held as columns; of a model with more only the pairs that stand in it.
DENSE = 1 << 24
SWITCH = 8.0
UND = "und"
#: Scores (words times languages) decoded together; longer texts are decoded alone. Letters scored together.
TOGETHER, LETTERS = 1 << 24, 1 << 18
#: A script belongs to a language if at least this share of its letters is in it.
SCRIPT_SHARE = 1e-4
POINTS = 0x110000

#: First code points of Unicode blocks at which the script of letters changes, by Unicode's block list.
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])

_points: list[np.ndarray] = []


def points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is a letter, and its lower-case form (itself, if that is no single letter); made once a process."""
    if not _points:
        letter, lower = np.zeros(POINTS, bool), np.arange(POINTS, dtype=np.int32)
        for p in range(POINTS):
            c = chr(p)
            if c.isalpha():
                letter[p] = True
                if c.isupper() or c.istitle():
                    low = c.lower()
                    lower[p] = ord(low) if len(low) == 1 else p
        _points.extend([letter, lower])
    return _points[0], _points[1]


def script_of(letters: np.ndarray) -> np.ndarray:
    """The place in SCRIPTS of each code point."""
    return np.maximum(0, np.searchsorted(STARTS, letters, "right") - 1)


def script(letter: str) -> str:
    return SCRIPTS[int(script_of(np.array([ord(letter)]))[0])][1]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> dict:
    """A model from labelled texts: languages, trigrams and what each adds for each language, scripts.

    docs: the rows that may be learned from, with a column doc_id to draw the
    sample by. Rows with a null text or language are left out.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select("doc_id", F.col(text).alias("t"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGS).collect()  # at most LANGS rows
    if not sizes:
        return {"langs": []}
    each = TRAIN_BYTES / len(sizes)
    part = [(r.lang, int(min(1.0, most / r.n, each / max(1, r.size)) * (1 << 30)) + 1) for r in sizes]
    part = F.broadcast(docs.sparkSession.createDataFrame(part, "lang string, part long"))
    drawn = F.pmod(fold(F.coalesce(F.col("doc_id"), F.lit(0)), 5), F.lit(1 << 30)) < F.col("part")
    words = rows.join(part, "lang").where(drawn).select("lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, F.lit(3)))
    counted = words.select("lang", "n", F.explode(grams).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))
    return model_of(counted.orderBy(F.desc("n"), "g", "lang").limit(ENTRIES).toArrow())


def model_of(counted: pa.Table) -> dict:
    """The model from (g, lang, n): how often each trigram stands in the sample of each language.

    A trigram's score for a language is `base` of the language, what a trigram
    has that the language never showed, plus `more` for one that it did. Only
    pairs that stand in the sample are held: those of trigram i at starts[i]
    up to starts[i + 1].
    """
    names = sorted(set(counted.column("lang").unique().to_pylist()))
    if not names:
        return {"langs": []}
    coded = counted.column("g").combine_chunks().dictionary_encode()
    grams = np.frombuffer("".join(coded.dictionary.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, 3)
    order = np.lexsort(grams.T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    grams, row = grams[order], rank[coded.indices.to_numpy()]
    at = {x: i for i, x in enumerate(names)}
    coded = counted.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([at[x] for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
    order = np.lexsort((lang, row))
    row, lang, n = row[order], lang[order], counted.column("n").to_numpy()[order].astype(np.float64)
    total = np.bincount(lang, n, len(names))
    base = np.log(0.5 / (total + 0.5 * (len(grams) + 1)))
    used = np.zeros((len(SCRIPTS), len(names)))
    np.add.at(used, (script_of(grams[:, 1])[row], lang), n)
    kinds = np.array([[x == y for _, y in SCRIPTS] for _, x in SCRIPTS])  # blocks of one script count together
    used = kinds @ used
    can = used / np.maximum(1, total) >= SCRIPT_SHARE
    can[~can.any(axis=1)] = True  # a script that no language has leaves all of them
    starts = np.searchsorted(row, np.arange(len(grams) + 1))
    more = np.log((n + 0.5) / 0.5).astype(np.float32)
    return {"langs": names, "grams": grams, "starts": starts, "lang": lang, "more": more, "base": (base - base.mean()).astype(np.float32), "can": can}


class Trigrams:
    """Trigrams of letters to rows of the model's scores, by hash tables; row 0 is for trigrams that the model doesn't have."""

    def __init__(self, grams: np.ndarray):
        alphabet = np.unique(grams)
        letter, lower = points()
        self.number = np.zeros(POINTS, np.int64)  # of letters of the alphabet in either case, from 1; space is one of them
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.number = np.where(letter, self.number[lower], self.number)
        self.space = int(self.number[32])
        self.width = len(alphabet) + 1
        keys, rows = self.keys(*self.number[grams].T), np.arange(1, len(grams) + 1)
        self.tables = []
        while len(keys):
            bits = int(len(keys)).bit_length() + 2
            slot = self.slots(keys, bits)
            held, row = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            held[slot], row[slot] = keys, rows  # of keys with one slot the last stays here
            self.tables.append((bits, held, row))
            rest = held[slot] != keys
            keys, rows = keys[rest], rows[rest]

    def keys(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * self.width + b) * self.width + c

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), np.int32), None
        for bits, held, row in self.tables:
            own = keys if open_ is None else keys[open_]
            slot = self.slots(own, bits)
            hit = held[slot] == own
            if open_ is None:
                out = np.where(hit, row[slot], 0)
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = row[slot[hit]]
                open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Scorer:
    """A model ready to score words.

    Where a column of scores for each language is small it is made once; of a
    larger model only the pairs that stand in it are held.
    """

    def __init__(self, model: dict):
        self.langs, self.columns = model["langs"], []
        if self.langs:
            self.trigrams = Trigrams(model["grams"])
            self.starts = np.concatenate([[0], model["starts"]])  # row 0 has no pairs
            self.lang, self.more, self.base, self.can = (model[x] for x in ("lang", "more", "base", "can"))
            size = (len(model["grams"]) + 1, len(self.langs))
            if size[0] * size[1] <= DENSE:
                scores = np.zeros(size, np.float32)
                scores[1:] = self.base
                scores[np.repeat(np.arange(1, size[0]), np.diff(model["starts"])), self.lang] += self.more
                self.columns = [np.ascontiguousarray(c) for c in scores.T]

    def sums(self, row: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """A row of scores for each word: heads are the places at which the words begin among the trigrams' rows."""
        if self.columns:
            return np.stack([np.add.reduceat(c[row], heads) for c in self.columns], axis=1)
        langs, step = len(self.langs), max(1, 8 * LETTERS // len(self.langs))
        cuts = np.unique(np.append(np.searchsorted(heads, np.arange(0, len(row), step)), len(heads)))
        stops, out = np.append(heads, len(row)), np.empty((len(heads), langs), np.float32)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # words of about `step` letters at a time
            own = row[stops[a] : stops[b]]
            word = np.repeat(np.arange(b - a), np.diff(stops[a : b + 1]))
            first, n = self.starts[own], np.where(own > 0, self.starts[np.minimum(own + 1, len(self.starts) - 1)] - self.starts[own], 0)
            pair = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            more = np.bincount(np.repeat(word, n) * langs + self.lang[pair], self.more[pair], (b - a) * langs).reshape(-1, langs)
            out[a:b] = more + np.bincount(word, own > 0, b - a)[:, None] * self.base
        return out

    def words(self, text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, scores) of the words of some code points; at `edges` a word ends, whatever stands there."""
        is_letter, _ = points()
        letter = is_letter[text]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        edges = edges[(edges > 0) & (edges < len(text))]
        first[edges], last[edges - 1] = letter[edges], letter[edges - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(begin):
            return begin, end, np.zeros((0, len(self.langs)), np.float32)
        place = np.flatnonzero(letter)
        number = self.trigrams.number[text[place]]
        before, after = np.empty_like(number), np.empty_like(number)
        before[1:], after[:-1] = number[:-1], number[1:]
        heads = np.searchsorted(place, begin)
        before[heads], after[np.append(heads[1:], len(place)) - 1] = self.trigrams.space, self.trigrams.space
        row = self.trigrams.find(self.trigrams.keys(before, number, after))
        scores = self.sums(row, heads)
        can = self.can[script_of(text[begin])]
        least = np.where(can, scores, np.inf).min(axis=1) - 2 * SWITCH
        return begin, end, np.where(can, scores, np.minimum(scores, least[:, None]))


def decode(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of many texts at once.

    scores: a row for each word of each text, one text after another; lengths:
    words of each text. Going from one word to the next costs `switch` if the
    label changes. Of equal paths the one that stays wins, then the first label.
    """
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    first = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    time = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = first[time] + np.repeat(rank, lengths)  # by word number, then by length of text
    turned = np.empty_like(scores)
    turned[place] = scores
    back = np.empty(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    value = turned[: active[0]].copy() if longest else turned
    ends = np.empty((len(lengths), scores.shape[1]), scores.dtype)
    n = active[0] if longest else 0
    for t in range(1, longest):
        k = active[t]
        if k < n:
            ends[k:n] = value[k:]
            value, n = value[:k], k
        best = value.argmax(axis=1)[:, None]
        changed = np.take_along_axis(value, best, 1) - switch
        back[first[t] : first[t + 1]] = np.where(changed > value, best, own)
        value = np.maximum(value, changed) + turned[first[t] : first[t + 1]]
    if longest:
        ends[:n] = value
    labels = np.empty(len(scores), kind)
    now = np.zeros(len(lengths), np.int64)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        began = active[t + 1] if t + 1 < longest else 0
        if k > began:
            now[began:k] = ends[began:k].argmax(axis=1)
        labels[first[t] : first[t + 1]] = now[:k]
        if t:
            now[:k] = back[first[t] : first[t + 1]][np.arange(k), now[:k]]
    return labels[place]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def predict(texts: list[str | None], scorer: Scorer) -> tuple[list[str], list[float]]:
    """Language and share of letters of each text."""
    langs = scorer.langs
    out, share = [UND] * len(texts), [0.0] * len(texts)
    scores, letters, lengths, waiting = [], [], [], 0  # of the texts done .. done + len(lengths)
    done = 0

    def flush():
        size = np.array(lengths, np.int64)
        labels = decode(np.concatenate(scores), size)
        text = np.repeat(np.arange(len(size)), size)
        held = np.bincount(text * len(langs) + labels, np.concatenate(letters), len(size) * len(langs)).reshape(len(size), len(langs))
        total = held.sum(axis=1)
        for i in np.flatnonzero(total).tolist():
            top = int(held[i].argmax())
            out[done + i], share[done + i] = langs[top], float(held[i, top] / total[i])

    begin = 0
    while begin < len(texts) and langs:
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= LETTERS):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[begin:end]]
        cut = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        at, stop, own = scorer.words(code_points(part), cut)
        n = np.diff(np.searchsorted(at, cut))
        if waiting and (waiting + len(own)) * len(langs) > TOGETHER:
            flush()
            done, waiting = begin, 0
            scores, letters, lengths = [], [], []
        scores.append(own)
        letters.append(stop - at)
        lengths += n.tolist()
        waiting += len(own)
        begin = end
    if waiting:
        flush()
    return out, share


def spans(text: str | None, scorer: Scorer) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in code points, from the first word of each to its last."""
    if not text or not scorer.langs:
        return []
    begin, end, scores = scorer.words(code_points([text]), np.zeros(0, np.int64))
    labels = decode(scores, np.array([len(begin)]))
    new = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else labels
    last = np.append(new[1:], len(labels)) - 1
    return [(int(begin[a]), int(end[b]), scorer.langs[int(labels[a])]) for a, b in zip(new, last, strict=True)] if len(labels) else []


def label_spans(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the spans of each text as an array of (start, end, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ENTRIES pairs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            rows = [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in spans(t, scorer)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ENTRIES pairs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, share = predict(batch.column(1).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_langid": op5_langid}
ORACLE_SQL: dict[str, str] = {}
