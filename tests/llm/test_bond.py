"""Hard negatives against a plain search, on real vectors, odd rows and large numbers."""

import random

import numpy as np
import pytest

from vouch.llm import bond


def plain(rows, asked, n_positives=5, n_negatives=3, low=50, high=95):
    """rows (vec_id, label, whole components): the contract, row by row."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    for a in (r for r in rows if asked(r[0])):
        near = sorted((-score(a, b), b[0], b[1]) for b in rows if b[0] != a[0])
        for s, i, _ in [x for x in near if x[2] == a[1]][:n_positives]:
            fits = [x for x in near if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, asked="vec_id % 5 = 0", **options):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    return sorted(map(tuple, bond.mine(df, F.expr(asked), **options).collect()))


def test_twin(twin):
    twin(bond, "op13_hard_negatives")


@pytest.mark.parametrize("spread, n", [(3, 300), (200, 300), (1 << 24, 60)])
def test_ties_windows_and_large_numbers(spark, spread, n):
    rng = random.Random(spread)
    rows = [(i, rng.choice([0, 0, 1, 2]), [rng.randint(-spread, spread) for _ in range(12)]) for i in range(n)]
    rows += [(n + i, 1, rows[7][2]) for i in range(20)]  # copies: ties by id
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, n_positives=2, n_negatives=50, low=10, high=99) == plain(rows, lambda i: i % 5 == 0, 2, 50, 10, 99)


def test_many_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 4, [rng.randint(-60, 60) for _ in range(20)]) for i in range(400)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>").repartition(23)
    monkeypatch.setattr(bond, "GROUP", 2)
    got = sorted(map(tuple, bond.mine(df, F.expr("vec_id % 9 = 0")).collect()))
    assert got == plain(rows, lambda i: i % 9 == 0)


def test_bounds_leave_out_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, (500, 16)).astype(np.int32)
    labels = np.sort(rng.integers(0, 3, 500))
    block = bond.Block(np.arange(500).tobytes(), labels.astype(np.int64).tobytes(), np.ascontiguousarray(x.T).tobytes())
    for i in range(0, 500, 25):
        scores = x.astype(int) @ x[i].astype(int)
        own = np.flatnonzero((labels == labels[i]) & (np.arange(500) != i))
        best = own[np.lexsort((own, -scores[own]))[:5]]
        ids, found = bond.positives_of(block, x[i].astype(np.int64), i, labels[i], 5, None)
        assert ids.tolist() == best.tolist() and found.tolist() == scores[best].tolist()
        # A floor that another block has set leaves out what lies below it only.
        ids, _ = bond.positives_of(block, x[i].astype(np.int64), i, labels[i], 5, int(scores[best[2]]))
        assert ids.tolist()[:3] == best.tolist()[:3]


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.6, 0.6], 2), (3, [0.6, 0.6], 2), (3, [0.6, 0.6], 2), (4, None, 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1),
            (7, [1.0, None], 1), (8, [9.0, 9.0], None), (None, [9.0, 9.0], 1), (9, [1.0], 1), (10, [], 1), (11, [1e30, 1.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, a long, block long, p_rank int")
    got = sorted(map(tuple, bond.mine(bond.scaled(df, F.col("label")), F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2, 131072, 78336), (0, 1, 2, 3, 131072, 78336), (0, 1, 3, 3, 131072, 78336)]
    none = bond.scaled(df.limit(0), F.col("label"))
    assert bond.mine(none, F.col("vec_id") == 0).collect() == []
    assert bond.window(0, 50, 95) == (0, 0) and bond.window(-10, 50, 95) == (-5, -10) and bond.window(7, 50, 95) == (4, 6)
