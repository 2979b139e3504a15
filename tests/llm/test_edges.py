"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names."""

import pytest

import corpus_pipeline as cp
from vouch.llm import ann, chat, decontaminate, jaccard, langid, packing, pii, quality, url_filter, warc

#: Names that operators use inside.
CLASHES = "node sig bad l_id kept_id gone_id queue part local n_tokens host_ b_host b_path best _sha1 _size _first key digest pii_ group_ rank id"
LONG = "The thing of that. " * 40_000
ROWS = [(1, None, None, None, None), (2, "", "", "", 0), (3, LONG, "en", "a", len(LONG)), (4, "12 !?", "en", "a", 5), (4, "12 !?", "en", "a", 5), (None, "one two three four five six", "en", None, -3)]


@pytest.fixture(scope="module")
def docs(spark):
    names = CLASHES.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], schema)


OPERATORS = {
    "jaccard": lambda s, d: jaccard.classes(d),
    "jaccard, one of each": lambda s, d: jaccard.one_of_each(d),
    "langid": lambda s, d: langid.identify(d, langid.learn(d)),
    "langid, spans": lambda s, d: langid.label_spans(d, langid.learn(d)),
    "packing": lambda s, d: packing.pack(d),
    "pii": lambda s, d: pii.digest(d),
    "pii, found": lambda s, d: pii.find(d),
    "pii, redacted": lambda s, d: pii.redacted(d),
    "quality": lambda s, d: quality.score(d, quality.fit(d, d.selectExpr("doc_id", "1 as quality", "0 as toxic", "doc_id as l_id", "1 as bad"))),
    "decontaminate": lambda s, d: decontaminate.contaminated(d, d.selectExpr("doc_id as item_id", "substr(text, 1, 300) as text")),
    "decontaminate, clean": lambda s, d: decontaminate.clean(d, d.selectExpr("doc_id as item_id", "substr(text, 1, 300) as text")),
    "warc": lambda s, d: warc.revisits(d.selectExpr("*", "doc_id as page_id"), "page_id", "text"),
    "url_filter": lambda s, d: url_filter.judge(d.selectExpr("*", "concat('https://a.org/', text) as url"), url_filter.rule_table(s)),
    "chat": lambda s, d: chat.format_chats(d.selectExpr("doc_id as conv_id", "id as turn", "source as role", "text", "n_tokens as m").withColumn("parts", chat.text_parts(d.text))),
}
ROWS_OUT = {"jaccard": 6, "jaccard, one of each": 5, "langid": 6, "langid, spans": 6, "pii": 6, "pii, found": 6, "pii, redacted": 6, "quality": 6, "warc": 6, "url_filter": 6, "chat": 5}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    found = OPERATORS[name](spark, docs).collect()
    assert len(found) == ROWS_OUT.get(name, len(found))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_clashing_columns_are_kept(spark, docs):
    for name in ("jaccard, one of each", "decontaminate, clean", "pii, redacted"):
        assert OPERATORS[name](spark, docs).columns == docs.columns
    assert set(docs.columns) <= set(OPERATORS["url_filter"](spark, docs).columns) and set(docs.columns) <= set(OPERATORS["warc"](spark, docs).columns)


def test_empty_benchmark(spark, docs):
    none = docs.selectExpr("doc_id as item_id", "text").limit(0)
    assert decontaminate.contaminated(docs, none).collect() == [] and decontaminate.clean(docs, none).count() == len(ROWS)


def test_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 4.0]), (8, [1.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    usable = ann.usable(vectors)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(usable.where("vec_id = 7"), usable, ann.build(usable), 20).collect())
    assert got == [(7, 1, 6), (7, 2, 6)]
    none = ann.usable(vectors.limit(0))
    assert ann.search(none, none, ann.build(none), 20).collect() == []


def test_long_zeros_are_no_address():
    assert pii.spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.spans("9" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_rows(spark, docs, sf, name):
    stage = dict(cp.STAGES)[name]
    assert stage(spark, docs, sf).count() > 0
    assert stage(spark, docs.limit(0), sf).count() == 0
