import random

import numpy as np
import pyarrow as pa
import pytest

from vouch.llm import jaccard as J


def brute(rows, n, similarity):
    """Smallest doc_id reachable by links, by comparing all pairs of word sequences."""
    sets, ids = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        ids.append(i)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p, q = similarity
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids))


def corpus(seed, size=260):
    rng, words, rows = random.Random(seed), [f"w{k}" for k in range(500)], []
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 14, 30, 80, 300]))] for _ in range(30)]
    for i in range(size):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(own) + 1)
            if rng.random() < 0.5 or len(own) < 2:
                own.insert(at, rng.choice(words))
            else:
                del own[min(at, len(own) - 1)]
        rows.append((i, "  ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\x0b\n")]


@pytest.mark.parametrize(("n", "similarity", "seed"), [(4, (85, 100), 1), (5, (80, 100), 2), (2, (60, 100), 3), (1, (90, 100), 4)])
def test_classes_are_exact(spark, n, similarity, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id long, text string, node long, sig int").repartition(3)
    found = J.classes(docs, n, similarity).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute(rows, n, similarity)


def signatures(own, bands):
    rows, sigs = J.signatures(own, np.array([0, len(own)]), bands)
    assert not rows.any()
    return sigs


@pytest.mark.parametrize("sets", [10**5, 10**8, 10**12])
@pytest.mark.parametrize("similarity", [(85, 100), (80, 100), (60, 100), (95, 100)])
def test_linked_sets_share_a_signature(similarity, sets):
    rng, bands = np.random.default_rng(7), J.Bands(similarity, sets)
    p, q = similarity
    tried = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = (int(rng.integers(0, 1 + len(a) * (q - p) // q)) for _ in range(2))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and q * both >= p * (len(a) + len(b) - both):
            tried += 1
            assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size
    assert tried > 150


def test_bands_cover_every_partner():
    for similarity in ((85, 100), (80, 100), (60, 100)):
        bands = J.Bands(similarity)
        for a in range(1, 600):
            for b in range(a, bands.most(a) + 1):
                assert set(bands.of(a)) & set(bands.of(b))


def test_layouts_follow_the_cost():
    """Of bands above 50 shingles small collections take whole segments, large ones mixtures, and no other layout costs less."""
    for similarity in ((85, 100), (80, 100)):
        kinds = set()
        for sets in (10**5, 10**7, 10**8, 10**9, 10**12):
            bands = J.Bands(similarity, sets)
            for band in range(30):
                if bands.last(band) > 50:
                    form = bands.layout(band)
                    d = bands.changes(bands.last(band), bands.last(band))
                    assert form.whole - form.slack + 2 * form.deletion >= d + 1
                    kinds.add((form.whole > 1, form.deletion > 0))
                    assert bands.cost(band, form.deletion, form.width) <= min(bands.cost(band, 0, 1), bands.cost(band, (d + 1) // 2, 2)) + 1e-9
        assert {(True, False), (True, True)} <= kinds


def test_classes_are_exact_with_one_deletion_segments(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIR", 1e9)  # as if unrelated sets were very many
    assert any(J.Bands((80, 100)).layout(k).deletion and J.Bands((80, 100)).last(k) > 50 for k in range(15))
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.classes(docs, 3, (80, 100)).collect())) == brute(rows, 3, (80, 100))


def test_long_texts_are_hashed_alike_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aBc\u00e9") for _ in range(rng.choice([1, 3, 70, 200]))) for _ in range(400))
    texts = pa.array([text, None, "", "a b", text + " x", "y" * 5000, "y" * 5000 + " z"])
    whole, cut = J.shingles(texts, 4)
    for size in (1000, 97, 7):
        monkeypatch.setattr(J, "PIECE", size)
        again, same = J.shingles(texts, 4)
        assert np.array_equal(whole, again) and np.array_equal(cut, same)
        again, same = J.hashed(texts, 4)
        assert np.array_equal(whole, again) and np.array_equal(cut, same)
    assert [b - a for a, b in zip(cut, cut[1:])][1:4] == [0, 0, 1]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 7).astype(np.uint64)]))
        x, y = J.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("most", [1000, 60])
def test_components(spark, most):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1150)] + [(5, 5)]
    found = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long").repartition(4), most).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root if find(x) != x}


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "V W X Y Z"), (None, "a b c d e"), (None, "k l m n"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in J.classes(docs).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id or 0, r.text or "") for r in J.one_of_each(docs).collect()) == [(0, "a b c d e"), (0, "k l m n"), (1, "a b c d e"), (3, "")]
    assert J.classes(docs.limit(0)).count() == 0
    assert J.one_of_each(docs.limit(0)).count() == 0


def test_clashing_columns_and_ties(spark):
    names = ["id", "id_", "rank", "node", "sig", "root", "gone_id", "kept_id", "bits", "a", "b"]
    rows = [(i, " ".join(f"w{k}" for k in range(30)) + (" z" if i % 2 else ""), *range(len(names))) for i in (4, 7, 5, 4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [4]
    assert {r.component_id for r in J.classes(docs).collect()} == {4}


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(60_000)]
    near = [*words[:30_000], "other", *words[30_001:]]
    far = words[:45_000]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 1_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.classes(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


@pytest.mark.parametrize("most", [200_000, 50, 0])
def test_shared_signatures_are_known_in_later_slices(monkeypatch, most):
    """Every set stands with each of its signatures, beside a set that stands with it too; a hot signature has one row a task."""
    monkeypatch.setattr(J, "KNOWN", most)
    bands, rows = J.Bands(), corpus(4)
    rows += [(2000 + i, " ".join(f"h{k}" for k in range(60)) + f" tail{i}") for i in range(200)]
    random.Random(8).shuffle(rows)
    shared, seen, heads, all_of, want = J.Shared(), set(), {}, {}, {}
    for at in range(0, len(rows), 20):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows[at : at + 20]]), pa.array([t for _, t in rows[at : at + 20]])], names=["doc_id", "text"])
        own, cut = J.hashed(batch.column(1), 4)
        for set_, sig in zip(*J.signatures(own, cut, bands), strict=True):
            want.setdefault(int(sig.view(np.int64)), set()).add(J.names_of(own, cut)[set_])
        for r in J.signed(batch, 4, bands, seen, shared).to_pylist():
            for s in r["sigs"] or []:
                heads.setdefault(s, []).append(r["node"])
                all_of.setdefault(s, set()).add(r["node"])
            for s, c in zip(r["again"] or [], r["centers"] or [], strict=True):
                assert c in heads[s]
                all_of.setdefault(s, set()).add(r["node"])
    assert all_of == want and len(shared.sigs) <= most
    hot = max(want, key=lambda s: len(want[s]))
    assert len(want[hot]) > 190 and (most < 1000 or len(heads[hot]) < 4)


def test_query(twin):
    twin(J, "op1_jaccard")
