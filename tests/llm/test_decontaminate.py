import random

from vouch.llm import decontaminate as dc


def plain(text):
    return " " + " ".join(dc.WORD.findall((text or "").lower())) + " "


def test_planted_items_are_found(spark, sf, duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    items = [(i, plain(t)) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    want = {(d, i) for d, t in docs for i, x in items if x in plain(t)}
    rows = dc.op4_decontaminate(spark, sf).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows} == want and all(r.score >= dc.THRESHOLD for r in rows)


def test_retrieval_is_exhaustive_bm25():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(3, 25)))) for i in range(300)]
    for threshold in (0.2, 0.5, 0.8):
        index = dc.Index(items, threshold)
        for _ in range(40):
            query = sorted({index.at[w] for w in rng.choices(words, k=rng.randint(1, 40)) if w in index.at})
            score = {}
            for w in query:
                for d, x in zip(index.docs[w], index.impacts[w], strict=True):
                    score[d] = score.get(d, 0) + x
            want = sorted(d for d, s in score.items() if s >= threshold - 1e-9)
            assert sorted(d for d, _ in index.retrieve(query)) == want


def test_passages_miss_nothing():
    """What the first look leaves out, exhaustive retrieval wouldn't find either."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(50)]
    index = dc.Index(items)
    chunks = dc.Chunks(index)
    for _ in range(100):
        text = rng.choices([*words, *["zz"] * 400], k=rng.randint(1, 600))
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text[at:at] = items[rng.randrange(50)][1].split()
        import numpy as np

        ids = np.frombuffer(b"".join(chunks[w] for w in text), np.int32)
        chosen = {(a, b) for _, a, b in index.passages([ids])}
        for k in range(max(1, -(-(len(ids) - index.stride) // index.stride))):
            a, b = k * index.stride, min(len(ids), (k + 2) * index.stride)
            if index.retrieve([w - 1 for w in np.unique(ids[a:b]).tolist() if w]):
                assert (a, b) in chosen


def test_question_and_answer_both_count(spark):
    items = spark.createDataFrame([(1, "What is the capital city of the land of Oz today? It is the green Emerald City of course."), (2, None), (3, ""), (4, "!!")], "item_id long, text string")
    question = "so then what is the capital city of the land of oz today he said"
    docs = spark.createDataFrame(
        [(1, question), (2, question + " It IS the green, emerald city of course!"), (3, None), (4, ""), (5, "x " * 20_000 + question + " it is the green emerald city of course" + " y" * 500)],
        "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()) == [(2, 1), (5, 1)]
    assert sorted(r.doc_id for r in dc.clean(docs, items).collect()) == [1, 3, 4]
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0


def test_shards(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}") for i in range(20)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "text")
    monkeypatch.setattr(dc, "MAX_WORDS", 30)
    assert len(list(dc.shards(items))) == 4 and dc.contaminated(docs, items).count() == 20 and dc.clean(docs, items).count() == 0


def test_edited_and_truncated_items_are_found(duck):
    """Each item of two sentences with one word changed, wherever it is, and without an answer of a fifth of its words."""
    items = [(i, t) for i, t in duck.execute("select item_id, text from benchmark where text is not null").fetchall() if dc.question_and_answer(t)[1]]
    index = dc.Index(items)
    chunks = dc.Chunks(index)
    texts, want = [], []
    for at, (_, t) in enumerate(items[:40]):
        q, a = dc.question_and_answer(t)
        for k in range(len(q + a)):
            texts.append("zz yy " + " ".join([*(q + a)[:k], "changed", *(q + a)[k + 1 :]]) + " xx")
            want.append(at)
        if len(a) <= 0.2 * len(q + a):
            texts.append("zz yy " + " ".join(q) + " xx")
            want.append(at)
    found = dc.matches(texts, index, chunks)
    assert texts and all(at in {i for i, *_ in f} for at, f in zip(want, found, strict=True))


def test_shards_do_not_change_scores(spark, monkeypatch):
    rows = [(i, f"common words that all have and then alpha{i} beta{i % 3} gamma{i % 5}. Answer {i % 4}.") for i in range(20)]
    items = spark.createDataFrame([*rows, (20, None), (21, "!!")], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "text")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in dc.contaminated(docs, items, 0.3).collect())
    want = found()
    monkeypatch.setattr(dc, "MAX_WORDS", 100)
    assert len(list(dc.shards(items))) > 1 and found() == want and len(want) > 20


def test_a_long_item_widens_no_passage_of_short_ones(spark):
    """An item of thousands of words has passages of its own width; short ones keep theirs, and all scores are those of one index."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    rows += [(30, " ".join(rng.choices(words, k=4000))), (31, " ".join(rng.choices(words, k=200))), (32, None), (33, "!!")]
    assert [x.stride for x in dc.indexes(rows)] == [dc.LEAST_PASSAGE, 200, 4000]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, "before all " + t + " after all") for i, t in rows[:32]], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(docs, items).collect()}
    assert found.keys() == {(i, i) for i in range(32)} and dc.clean(docs, items).count() == 0
    whole = dc.Index(rows)
    for i in range(32):
        at = [x[0] for x in whole.items].index(i)
        score = dict(whole.retrieve(sorted(whole.at[w] for w in set(rows[i][1].split()))))[at]
        assert abs(found[i, i] - score) < 1e-9
