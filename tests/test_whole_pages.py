"""Queries read pages to their end."""

import pytest

from vouch.plans import evidence, tables


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """A folder whose pages state what is asked for only behind some thousand characters."""
    folder = str(tmp_path_factory.mktemp("pages"))
    body = "<p>lorem ipsum dolor sit amet </p>" * 300
    rows = [
        (1, "https://abc.example/x", f"<title>Anna Berg North Plain</title>{body}<p>It serves 250 customers. Its wastewater plant is new.</p>"),
        (2, "https://bb.example/x", f"<title>Carl Dorn South Plain</title>{body}<p>Maria Lopez, Chief Executive Officer</p>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_facts_and_fit(spark, late):
    facts = {(r.record_id, r.field): r.value for r in tables.page_facts(spark, late).collect()}
    assert facts["abc.example", "customers_served"] == "250" and facts["abc.example", "service_type"] == "wastewater"
    # By the planted statement alone the record would be in scope; its count of customers is too small.
    assert {r.record_id: r.value for r in tables.page_fit(spark, late).collect()}["abc.example"] == "Review"


def test_leaders(spark, late):
    assert "Maria Lopez" in {r.name for r in evidence.leader_lookup(spark, late).where("record_id = 'bb.example'").collect()}
