import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vouch.llm import decontaminate, pii
from vouch.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = {"documents": spark.read.parquet(f"{sf}/documents.parquet")}
    docs = out["documents"]
    for name, stage in cp.STAGES:
        docs = out[name] = written(stage(spark, docs, sf), name)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_clean_documents(stages, duck):
    kept = rows(stages["quality"])
    clean = [i for (i,) in duck.execute("select doc_id from labels group by 1 having min(quality) = 1 and max(toxic) = 0").fetchall()]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and len(kept) < stages["documents"].count()


def test_one_of_each_class_stays(stages):
    from tests.llm.test_jaccard import brute

    before, after = rows(stages["quality"]), rows(stages["near_duplicates"])
    assert set(after) == {c for _, _, c in brute([(i, r.text) for i, r in before.items()], 5, (80, 100))}


def test_no_item_is_left(stages, duck):
    plain = lambda t: " " + " ".join(decontaminate.WORD.findall((t or "").lower())) + " "
    items = [plain(t) for (t,) in duck.execute("select text from benchmark").fetchall()]
    before, after = rows(stages["near_duplicates"]), rows(stages["decontamination"])
    assert set(after) == {i for i, r in before.items() if not any(x in plain(r.text) for x in items)}


def test_personal_data_is_masked(stages):
    before, after = rows(stages["decontamination"]), rows(stages["personal_data"])
    assert set(after) == set(before) and all(r.text == pii.redact(before[i].text) for i, r in after.items())
    assert not any(s[0] in pii.BASE for r in after.values() for s in pii.spans(r.text))


def test_everything_is_packed(stages):
    docs, pieces = rows(stages["personal_data"]), stages["packing"].collect()
    assert {p.doc_id for p in pieces} == set(docs)
    held = {}
    for p in pieces:
        held[p.doc_id] = held.get(p.doc_id, 0) + p.length
    assert all(held[p.doc_id] == p.doc_tokens for p in pieces)


def folder(spark, path, docs):
    """Tables of the smallest scale with other documents."""
    small = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def pieces(df):
    return sorted((p.doc_id is None, p.doc_id or 0, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in df.collect())


def test_run_is_its_stages_one_by_one(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, small), name)
    got = pieces(cp.run(spark, small))
    assert got and got == pieces(cp.packing_stage(spark, docs, small))
    assert {p[1] for p in got} == {r.doc_id for r in docs.collect()}


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table gives no piece; of rows that repeat one stays; null rows go through every stage."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert cp.run(spark, folder(spark, tmp_path / "empty", docs.limit(0))).count() == 0
    null = docs.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    assert {p.doc_tokens for p in cp.run(spark, folder(spark, tmp_path / "null", null)).collect()} <= {1}
    text = " ".join(f"word{i} stands beside thing{i}" for i in range(60))
    one = docs.limit(1).withColumn("text", F.lit(text)).withColumn("doc_id", F.lit(77).cast("long"))
    got = cp.run(spark, folder(spark, tmp_path / "repeated", one.union(one).union(one.withColumn("doc_id", F.lit(78).cast("long"))))).collect()
    assert {p.doc_id for p in got} == {77} and sum(p.length for p in got) % got[0].doc_tokens == 0
