import numpy as np

from vouch.llm import ann


def exact(vectors, query, k):
    scored = sorted((-float(np.dot(v, vectors[query])), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:k]]


def test_recall_and_ranks(spark, sf, duck):
    vectors = {i: np.array(v, float) for i, v in duck.execute("select vec_id, embedding from embeddings").fetchall()}
    rows = ann.op7_ann(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - float(np.dot(vectors[q], vectors[r.vec_id]))) < 1e-9 for r in found)
        hits += len({r.vec_id for r in found} & set(exact(vectors, q, 20)))
    assert hits / (20 * len(by)) >= 0.9


def test_odd_vectors_and_few_candidates(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [nan, 1.0, 1.0]),
            (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(r.vec_id for r in rows.collect()) == [0, 1, 2]
    found = ann.search(rows.where("vec_id = 0"), rows, ann.build(rows), k=20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 2.0), (2, 2, 2.0)]
    none = rows.limit(0)
    assert ann.search(none, none, ann.build(none), k=5).count() == 0


def test_recall_in_a_tight_group(spark):
    """A third of the vectors lie closer together than the codes can tell; some of them are copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    middle = rng.normal(size=32)
    x[::3] = middle / np.linalg.norm(middle) + rng.normal(size=(2000, 32)) * 0.02 / np.sqrt(32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:1200:3] = x[300]
    rows = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    found = {}
    for r in ann.search(rows.where("vec_id % 20 = 0"), rows, ann.build(rows, lists=20), k=20).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    for hot in (True, False):
        asked = [i for i in range(0, 6000, 20) if (i % 3 == 0) == hot]
        hits = 0
        for q in asked:
            exact = np.delete(x @ x[q], q)
            assert len(found[q]) == 20
            hits += sum(s >= np.sort(exact)[-20] - 1e-12 for s in found[q].values())
        assert hits / (20 * len(asked)) >= 0.9, hot
    copies = list(range(300, 1200, 3))
    assert sorted(found[300]) == copies[1:21] and sorted(found[1140]) == copies[:20]


def test_copies_of_an_id_do_not_hide_others():
    rows = [(0, i, v) for i, v in [(1, b"a"), (2, b"a"), (2, b"a"), (2, b"a"), (2, b"b"), (3, b"a"), (4, b"a")]]
    assert ann.copies(rows) == [0, 0, 1, 1, 0, 1, 2]


def test_many_lists_and_groups(spark):
    """An index of over a thousand lists finds what a small one finds, and its groups follow its lists."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 16))[rng.integers(0, 400, 5000)] + rng.normal(size=(5000, 16)) * 0.3).round(3)
    rows = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    for lists in (9, 1300):
        index, blocks = ann.build(rows, lists=lists)
        assert len(index.centroids) == lists and blocks.select("group").distinct().count() == -(-lists // round(lists**0.5))
        found = {}
        for r in ann.search(rows.where("vec_id % 50 = 0"), rows, (index, blocks), k=20).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(found[q] & set(exact(dict(enumerate(x)), q, 20))) for q in range(0, 5000, 50))
        assert hits / 2000 >= 0.9, lists
        assert index.probes < lists
