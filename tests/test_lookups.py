"""Filters of contacts, evidence and listings on literal rows, and the queries that apply them."""

import __spark_entry__ as entry
from vouch.operators import contacts as C
from vouch.operators import hits as H
from vouch.operators import orgs as O

ROW = "record_id int, source_url string, name string, email string, kind string, relevance_score int, email_evidence string, identity_status string, contact_name string, company_domain string, background string"


def rows(spark, asked, *given):
    made = [(n, url, name, email, kind, score, "listed", "review", asked, "birch.edu", "words") for n, (url, name, email, kind, score) in enumerate(given)]
    return spark.createDataFrame(made, ROW)


def test_named_contacts(spark):
    found = C.named_contacts(rows(spark, "Anna Berg",
        ("https://www.birch.edu/staff", "Carl Dorn", "carl.dorn@birch.edu", "person", 90),  # own site
        ("https://list.org/x", "Anna Berg", "anna.berg@birch.edu", "person", 90),
        ("https://list.org/x", "Carl Dorn", "carl.dorn@birch.edu", "person", 90),  # another person off the site
        ("https://list.org/x", "Anna Berg", "office@birch.edu", "person", 90),  # a mailbox not theirs
        ("https://www.birch.edu/staff", "Anna Berg", "anna.berg@gmail.com", "person", 90)))
    assert sorted((r.record_id, r.email_evidence) for r in found.collect()) == [(0, "listed"), (1, "listed_on_public_third_party_page")]


def test_company_contacts(spark):
    found = C.company_contacts(rows(spark, "",
        ("https://www.birch.edu/staff", "Carl Dorn", "cd@birch.edu", "person", 90),
        ("https://list.org/x", "Anna Berg", "anna.berg@birch.edu", "person", 50),
        ("https://list.org/x", "Carl Dorn", "office@birch.edu", "person", 90),
        ("https://www.birch.edu/staff", "", "info@birch.edu", "role_mailbox", 90),
        ("https://www.birch.edu/staff", "Eva Falk", "eva.falk@birch.edu", "person", 49)))
    assert sorted((r.record_id, r.identity_status, r.email_evidence) for r in found.collect()) == [
        (0, "supported", "public_company_directory"), (1, "supported", "listed_on_public_third_party_page")]


def test_evidence_and_listing_hits(spark):
    part = lambda *r: spark.createDataFrame(r, "record_id int, pos int, url string, text string")
    found = O.org_evidence(part((1, 2, "b", "y"), (1, 1, "a", "x" * 1500)), part((1, 0, "c", "z"))).first().evidence
    assert [(e.url, len(e.excerpt)) for e in found] == [("a", 1000), ("b", 1), ("c", 1)]
    hits = spark.createDataFrame([(k % 2, k, f"u{k}") for k in range(20)], "record_id int, hit int, source_url string")
    assert sorted(r.hit for r in H.first_listing_hits(hits).collect()) == list(range(12))


def test_queries_apply_them(spark, sf):
    queries = entry.queries()
    named = queries["named_contacts"](spark, sf).collect()
    assert {"address_matches_name_on_official_page"} < {r.email_evidence for r in named}
    assert all(r.identity_status == "supported" and r.name for r in queries["company_contacts"](spark, sf).collect())
    led = queries["leader_contacts"](spark, sf).collect()
    assert led and all(r.background.startswith("Named on ") for r in led)
    batch = queries["organization_batch"](spark, sf).persist()
    assert batch.count() == batch.select("record_id").distinct().count() and batch.where("website is not null").count() > 0
