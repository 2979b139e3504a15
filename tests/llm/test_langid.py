import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from vouch.llm import langid


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 4, 1, 5, 4, 0, 2])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    labels = langid.decode(scores, lengths, switch=2.0)
    cost = lambda s, path: sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        best = max((cost(own, p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(cost(own, labels[at : at + n]) - best) < 1e-9
        at += n


def test_scripts():
    assert [langid.script(c) for c in "aéЖα漢あ한אع"] == ["Latin", "Latin", "Cyrillic", "Greek", "Han", "Kana", "Hangul", "Hebrew", "Arabic"]


def test_held_out_accuracy(spark, sf, duck):
    rows = {r.doc_id: r for r in langid.op5_langid(spark, sf).collect()}
    truth = duck.execute("select doc_id, lang from documents where lang is not null and regexp_matches(text, '\\p{L}')").fetchall()
    held = [rows[i].lang_pred == lang for i, lang in truth if rows[i].held_out]
    assert len(held) > 200 and np.mean(held) >= 0.98
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0] and all(0 <= r.score <= 1 for r in rows.values())


def scored_by_hand(model, word):
    """Sums of log probabilities, from the model's pairs."""
    if "by_hand" not in model:
        model["by_hand"] = {"".join(map(chr, g)): model["base"].astype(float) for g in model["grams"].tolist()}
        for i, g in enumerate(list(model["by_hand"])):
            for k in range(model["starts"][i], model["starts"][i + 1]):
                model["by_hand"][g][model["lang"][k]] += model["more"][k]
    rows = model["by_hand"]
    padded, total = f" {word.lower()} ", np.zeros(len(model["langs"]))
    for i in range(len(word)):
        total += rows.get(padded[i : i + 3], 0)
    can = model["can"][langid.script_of(np.array([ord(word[0])]))[0]]
    return np.where(can, total, np.minimum(total, total[can].min() - 2 * langid.SWITCH))


def test_query_by_hand(spark, sf, duck):
    """The query's rows from the model alone: words by a pattern, scores by a dictionary, paths by plain dynamic programming."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.op5_langid(spark, sf).collect()}
    some = duck.execute("select doc_id, text from documents where length(coalesce(text, '')) < 1500 order by hash(doc_id) limit 120").fetchall()
    some += duck.execute("select doc_id, text from documents where text is not null order by length(text) desc limit 3").fetchall()
    for i, text in some:
        words = re.findall(r"[^\W\d_]+", text or "")
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        s = np.array([scored_by_hand(model, w) for w in words])
        value, back = s[0], []
        for own in s[1:]:
            best = value.argmax()
            move = value[best] - langid.SWITCH > value
            back.append(np.where(move, best, np.arange(len(value))))
            value = np.where(move, value[best] - langid.SWITCH, value) + own
        path = [int(value.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        held = np.bincount(path[::-1], [len(w) for w in words], len(model["langs"]))
        assert got[i].lang_pred == model["langs"][held.argmax()] and abs(got[i].score - held.max() / held.sum()) < 1e-9
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert len(got) == duck.execute("select count(distinct doc_id) from documents").fetchone()[0]


def test_trigram_tables():
    rng = np.random.default_rng(4)
    grams = np.unique(np.concatenate([rng.integers(97, 123, (4000, 3)), rng.integers(0x4E00, 0x5000, (4000, 3)), [[32, 97, 32]]]), axis=0)
    own = langid.Trigrams(grams)
    keys = own.keys(*own.number[grams].T)
    assert own.find(keys).tolist() == list(range(1, len(grams) + 1))
    assert not own.find(np.setdiff1d(np.arange(20_000), keys)).any()


def test_rare_languages_are_learned(spark, monkeypatch):
    rows = [(i, "the thing of that and with", "en") for i in range(3000)] + [(5000, "xyx yxx xyyx", "zz"), (5001, "漢字 仮名", "ja")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, g string")
    model = langid.learn(docs, most=20)
    assert model["langs"] == ["en", "ja", "zz"]
    asked = spark.createDataFrame([(1, "XYX yxx"), (2, "仮名 12 漢字"), (3, "That thing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in langid.identify(asked, model).collect()) == [(1, "zz"), (2, "ja"), (3, "en")]


def test_many_languages(spark):
    """More languages than a byte can number."""
    letters = [chr(0x4E00 + 7 * k) for k in range(300)]
    rows = [(k, c * 5, f"l{k:03d}") for k, c in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model["langs"]) == 300
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in langid.identify(docs, model).collect())


def test_long_text_ties_and_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "aab", "x"), (1, "aab", "y"), (2, "der die und", "de")], "doc_id long, text string, lang string")
    scorer = langid.Scorer(langid.learn(docs))
    texts = ["aab", "der die " * 50_000, None, "", "1 2", "aab"]
    langs, share = langid.predict(texts, scorer)
    assert langs == ["x", "de", "und", "und", "und", "x"] and share == [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    monkeypatch.setattr(langid, "TOGETHER", 10)
    monkeypatch.setattr(langid, "LETTERS", 5)
    assert langid.predict(texts, scorer) == (langs, share)


def test_mixed_text_and_shapes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the thing of that and with", "en"), ("der die und nicht schön", "de"), ("жить не тужить", "ru")] * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model["langs"] == ["de", "en", "ru"]
    mixed = "the thing of that and with that thing and the of with der die und nicht schön die nicht und der schön nicht жить не тужить не тужить"
    asked = spark.createDataFrame([(1, mixed), (2, None), (3, "12 !?"), (4, ""), (4, "the that")], "doc_id long, text string")
    spans = langid.label_spans(asked, model).where("doc_id = 1").first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"] and mixed[spans[2].start : spans[2].end].startswith("жить")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(asked, model).collect())
    assert got == [(1, "de"), (2, "und"), (3, "und"), (4, "en"), (4, "und")]  # German has the most letters of the mixed text
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(asked, empty).collect()} == {"und"}


def test_model_is_the_counts_logarithms():
    """Pairs and bases against log probabilities worked out one by one."""
    import pyarrow as pa

    counts = {("abc", "x"): 5, ("abc", "y"): 1, (" ab", "x"): 2, ("漢字 ", "y"): 7, ("𐐨bc", "x"): 1}
    rows = list(counts.items())[::-1]
    model = langid.model_of(pa.table({"g": [g for (g, _), _ in rows], "lang": [k for (_, k), _ in rows], "n": [n for _, n in rows]}))
    names = ["".join(map(chr, g)) for g in model["grams"].tolist()]
    assert sorted(names) == names and len(names) == 4 and model["langs"] == ["x", "y"]
    total = {k: sum(n for (_, own), n in rows if own == k) for k in "xy"}
    for g in names:
        hand = scored_by_hand_of(model, names.index(g))
        want = np.array([np.log((counts.get((g, k), 0) + 0.5) / (total[k] + 0.5 * 5)) for k in "xy"])
        assert np.allclose(hand - hand.mean(), want - want.mean(), atol=1e-5)


def scored_by_hand_of(model, i):
    out = model["base"].astype(float)
    for k in range(model["starts"][i], model["starts"][i + 1]):
        out[model["lang"][k]] += model["more"][k]
    return out


def test_columns_and_pairs_score_alike(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    texts = [r.text for r in docs.select("text").limit(200).collect()] + ["x" * 3000 + " der die und", None, "ሀ ꙮ"]
    columns = langid.Scorer(model)
    monkeypatch.setattr(langid, "DENSE", 0)
    pairs = langid.Scorer(model)
    assert columns.columns and not pairs.columns
    points = langid.code_points([t or "" for t in texts])
    for letters in (langid.LETTERS, 7):
        monkeypatch.setattr(langid, "LETTERS", letters)
        for a, b in zip(columns.words(points, np.array([], np.int64)), pairs.words(points, np.array([], np.int64)), strict=True):
            assert np.allclose(a, b, atol=2e-2, rtol=1e-5)
    assert langid.predict(texts, columns)[0] == langid.predict(texts, pairs)[0]


def test_bounds_of_what_is_learned(spark, monkeypatch):
    """Bytes are shared by languages, the most frequent languages and pairs stay; predictions still cover every text."""
    rows = [(i, "der die und nicht " * 50, "de") for i in range(400)] + [(1000 + i, "the of and with " * 50, "en") for i in range(300)] + [(5000 + i, "zz zy", f"dirty{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGS", 2)
    monkeypatch.setattr(langid, "TRAIN_BYTES", 40_000)
    model = langid.learn(docs)
    assert model["langs"] == ["de", "en"] and len(model["more"]) < 40
    monkeypatch.setattr(langid, "ENTRIES", 12)
    assert len(langid.learn(docs)["more"]) == 12
    asked = spark.createDataFrame([(1, "und nicht die"), (2, "with the"), (3, "zz")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).where("doc_id < 3").collect()} == {1: "de", 2: "en"}
    assert langid.identify(asked, model).count() == 3
