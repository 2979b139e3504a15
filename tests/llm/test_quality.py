import itertools
import math
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from vouch.llm import quality


def test_labelled_documents_not_seen_in_training(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) != 0
    model = quality.fit(docs, labels.where(seen))
    rows = quality.score(docs, model).join(labels.where(~seen), "doc_id").collect()
    clean = [r.rejected for r in rows if r.quality == r.quality and r["quality"] is not None and r.toxic == 0 and label(r) == 1]
    poor = [r.rejected for r in rows if label(r) == 0]
    assert len(clean) > 50 and sum(clean) / len(clean) <= 0.05
    assert len(poor) > 5 and sum(poor) / len(poor) >= 0.8


def label(row):
    """The label's quality: the join leaves the score first and the label second."""
    return row[row.__fields__.index("quality", row.__fields__.index("quality") + 1)]


def test_query_keeps_every_document(spark, sf):
    rows = quality.op6_quality(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.where("quality < 0 or quality > 1 or quality is null").count() == 0


def test_shapes(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "a", -1), (None, "x y", "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, none)).where("rejected").count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
    assert quality.score(docs, quality.fit(docs, none), keep=True).columns == docs.columns


def view(logistic, columns, measures):
    """The output of one view, number by number."""
    z = logistic.constant + sum(float(logistic.sparse[c]) for c in columns)
    for x, mean, deviation, weight in zip(measures, logistic.mean, logistic.deviation, logistic.dense, strict=True):
        z += min(8.0, max(-8.0, (x - mean) / deviation)) * weight
    return z


def judged_by_hand(model, text, lang, source, n_chars):
    """(p_content, p_page, both) of being bad: words, measures, calibration and combination in plain Python."""
    text = text or ""
    split = text.split()
    numbers = [zlib.crc32(w.strip(".,;:!?\"'()").lower().encode("utf-8", "replace")) % (1 << quality.BITS) for w in split]
    n = max(1, len(split))
    letters = [sum(c.isalpha() for c in w) for w in split]
    odd = sum(len(w) - k > 2 or k == 0 for w, k in zip(split, letters, strict=True))
    upper = sum(w.isupper() and k > 1 for w, k in zip(split, letters, strict=True))
    twice = sum(a == b for a, b in zip(numbers, numbers[1:], strict=False))
    content = [twice / n, len(set(numbers)) / n, odd / n, upper / n, math.log1p(len(split)), len(text) / n / 10]
    lines = text.count("\n") + 1
    page = [math.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text)), math.log1p(lines), math.log1p(len(text) / lines)]
    known = {int(model.column[k]) for k in numbers} - {0}
    z = [view(model.models[0], known, content), view(model.models[1], [model.values.get((0, lang), 0), model.values.get((1, source), 0)], page)]
    z = [a * x + b for (a, b), x in zip(model.calibrations, z, strict=True)]
    chance = lambda x: 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))
    return chance(z[0]), chance(z[1]), chance(model.weights[0] * z[0] + model.weights[1] * z[1] + model.weights[2])


def test_query_by_hand_over_the_whole_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = sorted(quality.op6_quality(spark, sf).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.quality))
    want = sorted(((r.doc_id, *judged_by_hand(model, r.text, r.lang, r.source, r.n_chars)) for r in docs.collect()), key=lambda r: (r[0] is None, r[0], 1 - r[3]))
    assert len(got) == len(want)
    for r, (i, by_content, by_page, both) in zip(got, want, strict=True):
        assert r.doc_id == i and abs(r.quality + both - 1) < 1e-6 and abs(r.p_content + by_content - 1) < 1e-6 and abs(r.p_page + by_page - 1) < 1e-6
        assert r.rejected == (both >= quality.REJECT) or abs(both - quality.REJECT) < 1e-6


def test_calibration_is_at_its_best_point():
    """A shifted or stretched calibration has no smaller penalised loss."""
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.stack([y * 2 + rng.normal(size=400), y + rng.normal(size=400)], axis=1)
    theta = quality.combine(x, y)

    def loss(t):
        z = np.clip(x, -15, 15) @ t[:2] + t[2]
        return float(np.mean(np.logaddexp(0, z) - y * z) + 1e-2 / 2 * t @ t)

    for k in range(3):
        for step in (-1e-2, 1e-2):
            other = theta.copy()
            other[k] += step
            assert loss(other) > loss(theta)


def test_rows_that_share_an_id_have_one_order():
    """However the rows arrive, ties on id, label and metadata are settled by what is looked at."""
    rows = [(1, 1, "en", "a", b"x", [1.0], [2.0]), (1, 1, "en", "a", b"x", [1.0], [1.0]), (1, 1, "en", "a", b"a", [9.0], [1.0]), (1, None, None, "a", b"", [0.0], [0.0]),
            (None, 0, "en", None, b"", [0.0], [0.0]), (0, 0, "en", "b", b"", [0.0], [0.0])]
    names = ["doc_id", "bad", "lang", "source", "words", "content", "page"]
    of = lambda part: quality.in_order(pa.table(dict(zip(names, map(list, zip(*part, strict=True)), strict=True)))).to_pylist()
    want = [dict(zip(names, rows[i], strict=True)) for i in (5, 2, 1, 0, 3, 4)]
    assert all(of(p) == want for p in itertools.permutations(rows))
