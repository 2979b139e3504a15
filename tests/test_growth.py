"""Work on a text that must not be done again for each word, place or page asked about."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.operators import identity as I
from vouch.operators import orgs as O
from vouch.operators import parse as P
from vouch.plans import views as V
from vouch.session import ROWS, SMALL, UNCHOSEN


def seconds(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_missing_words_read_the_text_once(spark):
    """A name of forty words costs about what a name of two costs."""
    rows = spark.range(4).select(F.repeat(F.concat(F.lit("lorem Ipsum dolor "), F.col("id").cast("string"), F.lit(" ")), F.lit(40_000)).alias("text")).cache()
    rows.count()
    few, many = F.lit("aqua terra"), F.lit(" ".join(f"word{n}" for n in range(40)))
    found = rows.select(T.missing_tokens(few, F.col("text")).alias("m"), F.size(T.missing_tokens(many, F.col("text"))).alias("n")).first()
    assert found == (["aqua", "terra"], 40)
    short, long = (min(seconds(rows.select(T.missing_tokens(name, F.col("text")))) for _ in range(2)) for name in (few, many))
    assert long < 4 * short + 1, (short, long)


def test_few_pages_are_taken_apart_at_once():
    """However many rows a batch has and however long its pages are, little markup is parsed before it goes on."""
    html = ["x" * 100] * 1000 + ["y" * 600_000] * 5 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(len(html))]), pa.array(html, pa.string())], names=["url", "html"])
    found = list(P.parts(iter([batch]), 1))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in found) == P.PART and max(sum(len(x or "") for x in p.column(1).to_pylist()) for p in found) < 2 * P.PART_CHARS


def test_tables_hand_few_rows_to_python(spark, sf):
    rows = spark.conf.get(ROWS)
    spark.conf.set(ROWS, UNCHOSEN)
    try:
        V.table(spark, sf, "pages")
        assert spark.conf.get(ROWS) == str(SMALL)
    finally:
        spark.conf.set(ROWS, rows)


def test_places_of_a_name_are_found_once(spark):
    """A page that names a person four times as often takes about four times as long."""
    page = lambda n: F.repeat(F.concat(F.lit("maya chen writes "), F.col("id").cast("string")), n)
    taken = []
    for n in (2_500, 10_000):
        rows = spark.range(2).select(page(F.lit(n)).alias("page")).cache()
        held = rows.select(I.near(F.col("page"), F.lit("maya chen"), F.lit("maya@cedar.org")).alias("x"))
        assert [r.x for r in held.collect()] == [False, False]
        taken.append(min(seconds(held) for _ in range(2)))
    assert taken[1] < 7 * taken[0] + 1, taken


def test_websites_of_a_listing_are_found_once(spark):
    """A directory's text with four times as many websites takes about four times as long."""
    taken = []
    for n in (1_500, 6_000):
        rows = spark.range(1).select(F.repeat(F.lit("Pine in Florida. Website: https://pine.org/ and more. "), F.lit(n)).alias("text")).cache()
        held = rows.select(F.size(O.listing_blocks(F.col("text"))).alias("n"))
        assert held.first().n == n
        taken.append(min(seconds(rows.select(O.listing_blocks(F.col("text")))) for _ in range(2)))
    assert taken[1] < 7 * taken[0] + 1, taken
