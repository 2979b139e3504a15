"""Toxicity: the averaged bags against a plain computation, unseen misspellings, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np

from vouch.llm import toxicity
from vouch.llm.common import table

BAD = "moron idiot worthless pathetic scum".split()


def sample(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["the", "an", "ti", "on", "re", "sh"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            words += [rng.choice(BAD[:4]) for _ in range(max(1, len(words) // 40))]
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_scores_are_means_of_means():
    texts, toxic = sample(80)
    model = toxicity.train([sorted(toxicity.words(t)) for t in texts], np.array(toxic), rounds=20)
    text = "Moron, the anti; moron ünd x_1 the"
    bag = {"moron", "the", "anti", "ünd", "x_1"}
    said = []
    for word in bag:
        marked = f"<{word}>"
        parts = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        said.append(np.mean([model.numbers[zlib.crc32(p.encode()) % (1 << toxicity.BITS)] for p in parts]))
    assert toxicity.words(text) == bag
    assert math.isclose(toxicity.Scores(model).text(text), sum(said) / (len(said) + toxicity.EMPTY) + model.constant, rel_tol=1e-6)
    assert toxicity.Scores(model).text(None) == toxicity.Scores(model).text(" .,") == model.constant


def test_unseen_misspellings_share_vectors():
    texts, toxic = sample()
    scores = toxicity.Scores(toxicity.train([sorted(toxicity.words(t)) for t in texts], np.array(toxic)))
    clean = "there onan shti resh anon thean tish onre"
    for odd in ("morons", "idiiot", "worthles", "pathetik", "patheticc"):
        assert scores.text(f"{clean} {odd}") > scores.text(f"{clean} {clean[:5]}") + 1
    assert scores.text(f"{clean} moron") > 0 > scores.text(clean)


def test_held_out_accuracy_and_every_document(spark, sf):
    big = "/root/testdata/sf0.1"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels").toPandas()
    got = toxicity.op12_toxicity(spark, big).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels[["doc_id", "toxic"]].drop_duplicates(), on="doc_id")
    right = held.predicted == held.toxic
    assert right.mean() > 0.93 and right[held.toxic == 1].mean() > 0.55  # 352 toxic texts to learn from


def test_labels_of_held_out_documents_and_other_columns_change_nothing(spark):
    texts, toxic = sample(200)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = [(i, x) for i, x in enumerate(toxic)]
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, x in labels]
    from pyspark.sql import functions as F

    fit = lambda rows: toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), ~toxicity.held_out(F.col("doc_id")))
    a, b = fit(labels), fit(turned)
    assert a.constant == b.constant and (a.numbers == b.numbers).all()
    odd = docs.selectExpr("*", "1 as score", "2 as toxic", "3 as l_id", "'x' as bag")
    assert sorted(toxicity.score(odd, a).collect()) == sorted(toxicity.score(docs, b).collect())


def test_odd_rows(spark):
    texts, toxic = sample(200)
    long = "the moron " * 300_000
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "12 !?"), (903, long), (903, long), (None, "moron"), (904, "ab" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic)] + [(0, 0), (0, 1), (3, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) and len({r for r in got if r[0] == 903}) == 1 and [r for r in got if r[0] == 903][0][3] == 1
    assert {r[2] for r in got if r[0] in (900, 901)} == {round(float(toxicity.sigmoid(model.constant)), 9)}
    assert [r[1] for r in got if r[0] is None] == [False]
    assert toxicity.score(docs.limit(0), model).collect() == []
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {(r.score, r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, few)).collect()} == {(0.0, 0)}
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).collect()} == {0}
