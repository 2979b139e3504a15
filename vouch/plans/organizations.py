"""The organization workload as one job: a cascade whose later stages see only what earlier ones left open.

website -> directory listing -> contacts of pages and documents -> named person
or leaders -> company-wide search -> merging, facts, fit and status. Each stage
writes its table (a lost executor costs a reread), and the next takes the
records that are still open by an anti-join. Pages are chosen by ids and short
columns; their texts are joined to the chosen ones only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions import urls as U
from vouch.operators import contacts as C
from vouch.operators import hits as H
from vouch.operators import orgs as O
from vouch.operators import parse as P
from vouch.operators import sites as S
from vouch.plans import views as V
from vouch.session import shared_folder, staged
from vouch.sources import tables as IO
from vouch.streaming import incremental as R

lit = F.lit

#: What a result says about its own making.
NOTES = {
    "none": "Broad search found no website for this organization.",
    "unread": "Candidate {} could not be read.",
    "name": "Candidate {} did not support the organization name.",
    "owner": "Candidate {} mentions the organization but does not establish website ownership.",
    "listed": "Company homepage was unavailable; organization-domain affiliation is supported by a fetched public directory listing.",
    "unnamed": "No publicly listed email was found for {}; no address was guessed.",
    "company": "No usable named address was established in the additional public pages searched.",
    "state": "Organization name matched, but supplied state was not supported by page text; review geographic identity.",
}
CONTACT = ["record_id", "arrival", "pos", *C.FIELDS]
PAGES, NAMED_PAGES = 12, 6


class Tables(NamedTuple):
    """What has been collected.

    requests: record_id, organization_name, state, country, record_type, contact_name.
    candidates: record_id, pos, url: supplied, found or registered websites.
    pages: page_id, url, html, text, branding; one row a URL.
    listings: record_id, hit, source_url, html, text: directory pages read.
    documents: domain, pos, url, text.
    named: record_id, contact_name, pos, url: search results for a person.
    company: record_id, pos, url: search results for the organization's contacts.
    """

    requests: DataFrame
    candidates: DataFrame
    pages: DataFrame
    listings: DataFrame
    documents: DataFrame
    named: DataFrame
    company: DataFrame


class Result(NamedTuple):
    sites: DataFrame
    contacts: DataFrame
    facts: DataFrame
    fit: DataFrame
    evidence: DataFrame
    status: DataFrame


def note(kind: str, about: Column | None = None) -> Column:
    ahead, _, behind = NOTES[kind].partition("{}")
    return lit(NOTES[kind]) if about is None else F.concat(lit(ahead), about, lit(behind))


def site_pages(asked: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """(asked's columns, place, page_id, url): the first pages of each site, its homepage ahead, then by the name asked for.

    asked: key, domain, name, ... Only ids and URLs are joined, by every parent
    of a page's host.
    """
    rows = pages.select("page_id", "url", F.explode(U.host_suffixes(F.regexp_replace(U.host(F.col("url")), r"^www\.", ""))).alias("_site"))
    rows = asked.join(rows, F.col("domain") == F.col("_site")).where(U.is_company_url(F.col("url"), F.col("domain"))).drop("_site")
    home = U.path(F.col("url")).isin("", "/")
    order = Window.partitionBy("key").orderBy(F.desc(home), U.page_score(F.col("url"), F.col("name")).desc(), "page_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def read(chosen: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """The chosen pages (page_id, ...) with columns of theirs."""
    return chosen.join(pages.select(F.col("page_id").alias("_page"), *columns), F.col("page_id") == F.col("_page")).drop("_page")


def read_urls(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """The chosen pages (url, ...) that are there, with html and text."""
    return chosen.join(pages.select(F.col("url").alias("_url"), "html", "text"), F.col("url") == F.col("_url")).drop("_url")


def extracted(pages: DataFrame, stage: int) -> DataFrame:
    """CONTACT rows of pages (record_id, place, url, html, text, contact_name)."""
    places = pages.select("record_id", F.col("url").alias("_url"), "place").groupBy("record_id", "_url").agg(F.min("place").alias("place"))
    found = C.extract_contacts(pages)
    found = found.join(places.withColumnRenamed("record_id", "_record"), (F.col("record_id") == F.col("_record")) & (F.col("source_url") == F.col("_url")))
    return found.withColumn("arrival", lit(stage) * 1000 + F.col("place")).select(CONTACT)


def websites(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen sites (record_id, pos, website, company_domain, geography_status), their pages, and warnings.

    Candidates are judged in order and none behind the first whose state is
    supported, so only those up to it are warned of.
    """
    candidates = staged(O.candidate_sites(t.candidates), "org-candidates")
    key = F.concat_ws(" ", F.col("record_id"), F.col("pos").cast("string"))
    names = t.requests.select("record_id", "organization_name", "state")
    asked = candidates.join(names, "record_id").select(
        "record_id", "pos", F.col("url").alias("site_url"), F.col("host").alias("domain"), "organization_name", "state", lit("").alias("name"), key.alias("key")
    )
    chosen = staged(site_pages(asked, t.pages, PAGES).select("record_id", "pos", "domain", "organization_name", "state", "place", "page_id", "url"), "org-pages")
    texts = read(chosen, t.pages, "text")
    named = O.site_matches(texts, ["record_id", "pos"])
    first = read(chosen.where("place = 1"), t.pages, "text", "branding")
    owned = O.owns_website(first).select("record_id", "pos", "owns")
    judged = candidates.join(named, ["record_id", "pos"], "left").join(owned, ["record_id", "pos"], "left")
    judged = judged.withColumn("stop", F.min(F.when(F.col("matches") & F.col("owns") & F.col("geography"), F.col("pos"))).over(Window.partitionBy("record_id")))
    judged = staged(judged.where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))), "org-judged")
    sites = O.choose_website(judged).join(judged.select("record_id", F.col("host").alias("company_domain"), "pos"), ["record_id", "company_domain"])
    why = F.when(F.col("matches").isNull(), note("unread", F.col("host"))).when(~F.col("matches"), note("name", F.col("host"))).when(~F.col("owns"), note("owner", F.col("host")))
    warned = judged.select("record_id", F.col("pos").cast("long").alias("pos"), why.alias("warning")).where("warning is not null")
    empty = t.requests.join(candidates, "record_id", "left_anti").select("record_id", lit(0).cast("long").alias("pos"), note("none").alias("warning"))
    return staged(sites, "org-sites"), chosen, warned.unionByName(empty)


def listed_sites(t: Tables, sites: DataFrame) -> DataFrame:
    """What directory listings agree on, of records without a site: record_id, company_domain, website, source_url, excerpt."""
    left = t.requests.join(sites, "record_id", "left_anti").select("record_id", "organization_name", "state", "country")
    hits = H.first_listing_hits(t.listings.select("record_id", "hit", "source_url").join(left.select("record_id"), "record_id", "left_semi"))
    hits = hits.where(~U.excluded_host(U.host(F.col("source_url"))))
    rows = hits.join(t.listings.select("record_id", "hit", "source_url", "html", "text"), ["record_id", "hit", "source_url"]).join(left, "record_id")
    marked = F.coalesce("html", lit("")) != ""
    parsed = P.parse_pages(rows.where(marked).select(F.col("source_url").alias("url"), "html").dropDuplicates(["url"])).select(F.col("url").alias("source_url"), "blocks")
    blocks = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["links"].alias("links")))
    of_markup = rows.where(marked).join(parsed, "source_url").withColumn("b", blocks)
    of_text = rows.where(~marked).withColumn("b", O.listing_blocks(F.col("text")))
    columns = ["record_id", "organization_name", "state", "country", "source_url", "hit"]
    each = of_markup.select(*columns, F.posexplode("b").alias("pos", "b")).unionByName(of_text.select(*columns, F.posexplode("b").alias("pos", "b")))
    return O.listing_consensus(each.select(*columns, "pos", "b.text", "b.links"))


def person_lookup(asked: DataFrame, t: Tables, stage: int) -> tuple[DataFrame, DataFrame]:
    """Contact rows and warnings for people (record_id, contact_name, company_domain), in two stages.

    First the pages of the site that name the person, all their contacts. Only
    where none of those is the person, the pages that a search found are read.
    """
    own = asked.withColumns({"key": F.col("record_id"), "domain": F.col("company_domain"), "name": F.col("contact_name")})
    pages = read(site_pages(own, t.pages, NAMED_PAGES), t.pages, "html", "text").where(T.contains_person_name(F.col("text"), F.col("contact_name")))
    first = staged(extracted(pages, stage), "org-named")
    theirs = lambda rows: rows.join(asked, "record_id").where(T.same_person(F.col("name"), F.col("contact_name")))
    left = asked.join(theirs(first).select("record_id"), "record_id", "left_anti")
    results = t.named.where(~U.excluded_host(U.host(F.col("url")))).join(left, ["record_id", "contact_name"])
    chosen = H.named_search_pages(results.groupBy("record_id", "contact_name", "company_domain", "url").agg(F.min("pos").alias("pos")))
    # Pages of the site are read before those elsewhere, personal ones first.
    order = Window.partitionBy("record_id").orderBy(F.desc("on_site"), F.when(F.col("on_site"), -U.personal_rank(F.col("url"), F.col("contact_name"))).otherwise(0), "pos")
    rows = read_urls(chosen.withColumn("place", F.row_number().over(order)), t.pages)
    full = T.contains_phrase(F.col("text"), F.col("contact_name"))
    found = C.named_contacts(extracted(rows.where(full), stage + 1).join(left, "record_id")).select(CONTACT)
    others = C.address_named_rows(rows.where(~full & F.col("on_site"))).join(rows.select("record_id", "url", "place"), ["record_id", "url"])
    blank = {"title": lit(""), "phone": lit(""), "linkedin_url": lit(""), "kind": lit("person"), "source_url": F.col("url"), "pos": lit(0)}
    others = others.withColumns(blank | {"arrival": lit((stage + 1) * 1000) + F.col("place"), "relevance_score": F.col("relevance_score").cast("long")}).select(CONTACT)
    every = staged(first.unionByName(found).unionByName(others), "org-lookup")
    unfound = asked.join(theirs(every).select("record_id"), "record_id", "left_anti")
    return every, unfound.select("record_id", lit(stage * 1000).cast("long").alias("pos"), note("unnamed", F.col("contact_name")).alias("warning"))


def leader_lookup(asked: DataFrame, pages: DataFrame, t: Tables, stage: int) -> tuple[DataFrame, DataFrame]:
    """Contact rows and warnings for the leaders that sites name: the second only where the first has no address.

    asked: record_id, company_domain; pages: record_id, pos, url, text.
    """
    leaders = staged(O.leaders(pages.join(asked, "record_id", "left_semi")), "org-leaders")
    rows, warnings, open_ = None, None, asked
    for rank in (1, 2):
        who = open_.join(leaders.where(F.col("rank") == rank).select("record_id", F.col("name").alias("contact_name")), "record_id")
        found, warned = person_lookup(who, t, stage + 10 * (rank - 1))
        led = O.leader_contacts(found, leaders.where(F.col("rank") == rank)).select(CONTACT)
        # A leader's own rows take the leader's role; the others that stood beside them stay as they are.
        other = found.join(led.select("record_id", "source_url", "email", "name").distinct(), ["record_id", "source_url", "email", "name"], "left_anti").select(CONTACT)
        both = led.unionByName(other)
        rows, warnings = (both, warned) if rows is None else (rows.unionByName(both), warnings.unionByName(warned))
        open_ = open_.join(led.select("record_id"), "record_id", "left_anti")
    return staged(rows, "org-leader-rows"), warnings


def company_lookup(asked: DataFrame, t: Tables, stage: int) -> tuple[DataFrame, DataFrame]:
    """Contact rows and warnings of a company-wide search for records (record_id, company_domain, contact_name)."""
    results = t.company.where(~U.excluded_host(U.host(F.col("url")))).join(asked, "record_id")
    chosen = H.company_search_pages(results.groupBy("record_id", "company_domain", "contact_name", "url").agg(F.min("pos").alias("pos")))
    rows = read_urls(chosen, t.pages)
    found = staged(C.company_contacts(extracted(rows, stage).join(asked, "record_id")).select(CONTACT), "org-company")
    without = asked.join(found.select("record_id"), "record_id", "left_anti")
    return found, without.select("record_id", lit(stage * 1000).cast("long").alias("pos"), note("company").alias("warning"))


def good(contacts: DataFrame) -> DataFrame:
    """Records (record_id) with a named, supported and relevant person on their domain, the one asked for if one was."""
    theirs = (F.col("contact_name") == "") | T.same_person(F.col("name"), F.col("contact_name"))
    own = U.within(F.substring_index("email", "@", -1), F.col("company_domain"))
    return contacts.where((F.col("name") != "") & (F.col("kind") == "person") & (F.col("identity_status") == "supported") & (F.col("relevance_score") >= 50) & own & theirs).select("record_id")


def run(t: Tables) -> Result:
    """All stages over the collected tables; every request has a row of `status`."""
    requests = t.requests.withColumn("contact_name", F.coalesce("contact_name", lit("")))
    t = t._replace(requests=requests)
    chosen, bodies, warnings = websites(t)
    listed = staged(listed_sites(t, chosen), "org-listed")
    sites = chosen.select("record_id", "website", "company_domain", "geography_status", "pos", lit(False).alias("listed"))
    sites = sites.unionByName(listed.select("record_id", "website", "company_domain", lit("supported").alias("geography_status"), lit(None).cast("int").alias("pos"), lit(True).alias("listed")))
    asked = staged(sites.join(requests, "record_id"), "org-asked")
    warnings = warnings.unionByName(listed.select("record_id", lit(100).cast("long").alias("pos"), note("listed").alias("warning")))

    # Pages of the site, or the listing that stands for it.
    own = bodies.select("record_id", "pos", "place", "page_id", "url").join(asked.where("not listed").select("record_id", "pos", "contact_name", "record_type"), ["record_id", "pos"])
    columns = ["record_id", "place", "url", "html", "text", "contact_name", "record_type"]
    own = read(own, t.pages, "html", "text").select(columns)
    shown = listed.join(t.listings.select("record_id", "source_url", "html", "text"), ["record_id", "source_url"]).join(requests.select("record_id", "contact_name", "record_type"), "record_id")
    pages = staged(own.unionByName(shown.select("record_id", lit(1).alias("place"), F.col("source_url").alias("url"), "html", "text", "contact_name", "record_type")), "org-read")
    papers = t.documents.join(asked.select("record_id", F.col("company_domain").alias("domain"), F.col("contact_name").alias("name")), "domain")
    papers = S.top_documents(papers.select("record_id", "name", "pos", "url")).select("record_id", F.col("name").alias("contact_name"), "place", "url")
    papers = staged(papers.join(t.documents.select(F.col("url").alias("_url"), "text"), F.col("url") == F.col("_url")).drop("_url").withColumn("html", lit("")), "org-documents")
    contacts = staged(extracted(pages, 1).unionByName(extracted(papers, 2)), "org-contacts")

    # A supplied person, or else the leaders that the site names.
    who = asked.select("record_id", "company_domain", "contact_name")
    matching = contacts.join(who, "record_id").where(T.same_person(F.col("name"), F.col("contact_name"))).select("record_id")
    named, unnamed = person_lookup(who.where("contact_name <> ''").join(matching, "record_id", "left_anti"), t, 3)
    some = contacts.where("name <> '' and identity_status = 'supported'").select("record_id")
    leaderless = who.where("contact_name = ''").join(some, "record_id", "left_anti").select("record_id", "company_domain")
    led, unled = leader_lookup(leaderless, pages.select("record_id", F.col("place").alias("pos"), "url", "text"), t, 5)
    contacts = contacts.unionByName(named).unionByName(led)

    # Company-wide, where still no one is supported.
    left = who.join(good(contacts.join(who, "record_id")), "record_id", "left_anti")
    wide, unwide = company_lookup(staged(left, "org-open"), t, 40)
    contacts = contacts.unionByName(wide)
    merged = staged(C.merge_contacts(contacts, who.select("record_id", "company_domain")), "org-merged")

    told = pages.select("record_id", "record_type", F.col("place").alias("pos"), "url", "text")
    facts = staged(O.classify_facts(told), "org-facts")
    unread = requests.join(asked.select("record_id"), "record_id", "left_anti").select("record_id", "record_type", lit("").alias("text"))
    fit = O.reviewed_fit(O.fit_decision(told.select("record_id", "record_type", "text").unionByName(unread), facts), asked)
    unsure = asked.where("geography_status = 'unknown'").select("record_id", lit(99_000).cast("long").alias("pos"), note("state").alias("warning"))
    for more in (unnamed, unled, unwide, unsure):
        warnings = warnings.unionByName(more)
    status = O.org_status(requests, asked.select("record_id", "website", "company_domain", "geography_status"), warnings)
    excerpts = listed.select("record_id", F.col("source_url").alias("url"), "excerpt")
    read_pages = pages.select("record_id", F.col("place").alias("pos"), "url", "text").join(excerpts, ["record_id", "url"], "left")
    evidence = O.org_evidence(
        read_pages.select("record_id", "pos", "url", F.coalesce("excerpt", "text").alias("text")), papers.select("record_id", F.col("place").alias("pos"), "url", "text"),
        wide.select("record_id", F.col("arrival").alias("pos"), F.col("source_url").alias("url"), F.col("background").alias("text")),
    )
    return Result(asked, merged, facts, fit, evidence, status)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The job's tables from the given pages, each read whole.

    A domain is an organization, named by the third to fifth word of the title of
    its first page; some ask for the person whom that page's title names. Every
    third page also shows its title's person on a card, the next names a manager
    in its text, the last says whom the organization serves. A directory lists a
    third of the organizations, and prints the managers' addresses.
    """
    p = V.pages(spark, sf_dir)
    who, domain = F.initcap("name"), F.col("domain")
    email = F.concat(F.regexp_replace(F.lower("name"), "[^a-z]+", "."), lit("@"), domain)
    card = F.concat(lit("<div><h2>"), who, lit('</h2><p>Billing Director</p><a href="mailto:'), email, lit('">Email</a></div>'))
    kind = F.col("page_id") % 3
    html = F.concat("html", F.when(kind == 0, card).otherwise(""))
    said = F.when(kind == 0, F.concat(lit(" "), who, lit(" Billing Director"))).when(kind == 1, F.concat(lit("\nMeet "), who, lit(", General Manager\nin Florida")))
    said = said.otherwise(F.concat(lit(" The municipal electric utility serves "), F.col("page_id") * 97, lit(" customers.")))
    made = p.select("page_id", "url", "domain", "name", "company", html.alias("html"), F.concat("text", said).alias("text"), F.array("title").alias("branding"), email.alias("email"))
    made = staged(made, "org-made")
    order = Window.partitionBy("domain").orderBy("page_id")
    first = made.withColumn("n", F.row_number().over(order)).where("n = 1")
    nth = F.pmod(F.xxhash64("domain"), lit(12))
    requests = first.select(
        F.col("domain").alias("record_id"), F.concat("company", F.when(nth % 3 == 0, F.concat(lit(" "), F.substring_index("name", " ", 1))).otherwise("")).alias("organization_name"),
        F.when(nth % 4 == 0, "FL").when(nth % 4 == 1, "TX").otherwise("").alias("state"), lit("US").alias("country"), F.when(nth % 5 == 0, "association").otherwise("ICP").alias("record_type"),
        F.when(nth % 2 == 0, F.initcap("name")).otherwise("").alias("contact_name"), "domain",
    )
    candidates = made.join(requests.where(nth != 7).select("domain", "record_id"), "domain").select("record_id", F.col("page_id").alias("pos"), "url")
    # The directory: a listing of every third organization, and people's addresses beside their names.
    entry = F.concat(lit("<ul><li>"), "organization_name", lit(' in Florida and Texas. Website: <a href="https://www.'), "domain", lit('/">site</a></li><li>Another</li></ul>'))
    listed = requests.where(F.pmod(F.xxhash64("domain"), lit(3)) == 0).select(
        "record_id", lit(0).alias("hit"), F.concat(lit("https://list.example.org/"), "record_id").alias("source_url"), entry.alias("html"),
        F.concat("organization_name", lit(" in Florida and Texas. Website: site Another")).alias("text"),
    )
    away = F.concat(lit("https://people.example.org/staff/"), F.col("page_id").cast("string"))
    printed = made.where("page_id % 3 = 1").select(
        (F.col("page_id") + 1_000_000_000).alias("page_id"), away.alias("url"), lit("").alias("html"),
        F.concat(F.initcap("name"), lit(", Finance Director, "), "email", lit(" and words")).alias("text"), F.array(lit("People")).alias("branding"),
    )
    columns = ["page_id", "url", "html", "text", "branding"]
    # One row a URL: pages with one URL have the text of the first.
    once = made.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).where("n = 1")
    pages = staged(once.select(columns).unionByName(printed.select(columns)), "org-tables")
    documents = made.where("page_id % 4 = 0").select("domain", F.col("page_id").alias("pos"), F.concat(lit("https://"), "domain", lit("/staff-directory-"), F.col("page_id").cast("string"), lit(".pdf")).alias("url"), "text")
    person = F.explode(F.array("url", F.when(F.col("page_id") % 3 == 1, away))).alias("url")
    named = made.select(F.col("domain").alias("record_id"), F.initcap("name").alias("contact_name"), F.col("page_id").alias("pos"), person).where("url is not null")
    company = made.where("page_id % 3 < 2").select(F.col("domain").alias("record_id"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 == 1, away).otherwise(F.col("url")).alias("url"))
    return Tables(requests.drop("domain"), candidates, pages, listed, documents, named, company)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every organization's website, status, scope and warnings after the whole job."""
    r = run(tables(spark, sf_dir))
    counts = r.contacts.groupBy("record_id").agg(F.count("*").alias("n_contacts"))
    rows = r.status.join(r.fit.select("record_id", F.col("value").alias("in_scope"), F.col("quote").alias("reason")), "record_id", "left").join(counts, "record_id", "left")
    rows = rows.join(r.facts.groupBy("record_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "field", "value"))).alias("facts")), "record_id", "left")
    return rows.select(
        "record_id", "status", "website", "geography_status", "in_scope", "reason", F.coalesce("n_contacts", lit(0)).alias("n_contacts"),
        F.array_join("facts", "; ").alias("facts"), F.array_join("warnings", " | ").alias("warnings"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every organization's contacts after the whole job."""
    merged = run(tables(spark, sf_dir)).contacts
    return merged.select("record_id", "email", "name", "title", "kind", "relevance_score", "identity_status", "email_evidence", "source_url", "source_count", "background")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job as a resumable batch over checked rows; each row goes out with its best contact, facts and warnings."""
    t = tables(spark, sf_dir)
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_.:-]", "-")
    good, _ = IO.check_org_rows(IO.suppress(t.requests.withColumn("record_id", safe(F.col("record_id")))))
    t = Tables(good, *(x.withColumn("record_id", safe(F.col("record_id"))) if "record_id" in x.columns else x for x in t[1:]))
    made: list[Result] = []

    def work(left: DataFrame) -> DataFrame:
        made.append(run(t._replace(requests=left)))
        r = made[-1]
        counts = r.contacts.groupBy("record_id").agg(F.count("*").alias("n_contacts"))
        sources = r.evidence.select("record_id", F.array_distinct(F.transform("evidence", lambda e: e["url"])).alias("sources"))
        rows = r.status.join(counts, "record_id", "left").join(sources, "record_id", "left")
        none = F.array().cast("array<string>")
        return rows.select("record_id", "status", "website", "warnings", F.coalesce("sources", none).alias("sources"), F.coalesce("n_contacts", lit(0)).alias("n_contacts"), lit(0.0).alias("minutes"))

    results = R.resume(good, shared_folder(spark, "organization-batch"), work)
    fit = made[0].fit.select("record_id", lit("in_scope").alias("field"), "value", lit("").alias("source_url"), "quote")
    rows = IO.enriched(good.select("record_id", "organization_name"), results, C.best_contacts(made[0].contacts), made[0].facts.unionByName(fit))
    return rows.select("record_id", "organization_name", "website", "contact_candidates", "contact_email", "verification_status")


# Chains of stages are beyond SQL; a test holds them against a plain version over the whole table.
QUERIES = {"organization_results": (results, None), "organization_contacts": (contacts, None), "organization_batch": (batch, None)}
