"""Person evidence and organization contacts as whole jobs, and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import constants as K
from vouch.functions import text as T
from vouch.functions import urls as U
from vouch.operators import contacts as C
from vouch.operators import hits as H
from vouch.operators import identity as I
from vouch.operators import orgs as O
from vouch.operators import parse as P
from vouch.operators import sites as S
from vouch.plans import views as V
from vouch.session import staged
from vouch.sources import tables as IO

lit = F.lit
#: Characters of a page that a search service shows with a hit.
SNIPPET = 200


def gather_hits(requests: DataFrame, pages: DataFrame, most: int = 8) -> DataFrame:
    """Each person's hits: the pages of their domain (crawl), then the first `most` pages elsewhere titled with their name (search).

    Hits have a snippet; the texts of pages stay where they are until it is known which are read.
    """
    columns = ["request_id", "name", "company", "company_domain", "work_email", "page_id", "url", "title", "snippet"]
    pages = pages.withColumn("snippet", F.substring("text", 1, SNIPPET))
    crawl = I.pages_of_domains(pages.select("page_id", "url", "title", "snippet"), requests).select(*columns, lit(1).alias("source_order"))
    titled = pages.select("page_id", "url", "title", "snippet", F.lower("name").alias("_name"), "domain")
    search = requests.join(titled, (F.lower("name") == F.col("_name")) & (F.col("company_domain") != F.col("domain")))
    search = H.top(search, ["request_id"], [F.col("page_id")], most).select(*columns, lit(2).alias("source_order"))
    ident = F.concat_ws("-", F.col("request_id").cast("string"), F.col("page_id").cast("string"))
    return crawl.unionByName(search).withColumns({"query_pos": lit(0), "rank": F.col("page_id"), "hit_id": ident, "text": lit(None).cast("string")})


def person_evidence(requests: DataFrame, hits: DataFrame, accounts: DataFrame, profiles: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Scored hits of person requests: one a page, the chosen pages read, posts attributed, profiles attached.

    requests: request_id, name, company, company_domain, work_email. hits:
    those columns and hit_id, url, title, text, source_order, query_pos, rank;
    a supplied page has order 0, is always read and has no snippet. Hits may
    have a snippet and a page_id of pages (page_id, text) instead of a text:
    the texts of the few chosen ones are joined after the choice.
    """
    own = F.col("snippet") if "snippet" in hits.columns else F.substring("text", 1, SNIPPET)
    first = staged(H.first_hits(hits.withColumn("snippet", F.when(F.col("source_order") == 0, "").otherwise(own))), "person-hits")
    chosen = H.chosen_pages(first.drop("text")).select("hit_id", lit(True).alias("read"))
    rows = first.join(chosen, "hit_id", "left").withColumn("page", F.when(F.col("read") | (F.col("source_order") == 0), F.col("text")))
    if pages is not None:
        texts = rows.where("read").select("hit_id", "page_id").join(pages.select(F.col("page_id").alias("_page"), F.col("text").alias("page_text")), F.col("page_id") == F.col("_page"))
        rows = rows.join(texts.select("hit_id", "page_text"), "hit_id", "left").withColumn("page", F.coalesce("page", "page_text")).drop("page_text")
    posts = I.official_posts(first.select("hit_id", "url", "company_domain"), accounts)
    rows = rows.join(posts, "hit_id", "left")
    profile = "struct<name:string,company:string,bio:string,email:string>"
    if profiles is None:
        rows = rows.withColumn("profile", lit(None).cast(profile))
    else:
        picked = H.chosen_profiles(first.drop("text")).select("hit_id", "url")
        got = picked.join(profiles.select("url", F.struct("name", "company", "bio", "email").alias("profile")), "url").select("hit_id", "profile")
        rows = rows.join(got, "hit_id", "left")
    return I.score_evidence(rows)


def supplied_hits(supplied: DataFrame, requests: DataFrame) -> DataFrame:
    """The hits, of order 0, of the supplied pages that have no warning."""
    rows = supplied.where(F.col("warning").isNull()).select("request_id", "url", "text").join(requests, "request_id")
    ident = F.concat(F.col("request_id").cast("string"), lit("-supplied"))
    return rows.select(
        "request_id", "name", "company", "company_domain", "work_email", lit(None).cast("long").alias("page_id"), "url",
        F.concat(lit("Supplied page: "), "url").alias("title"), lit("").alias("snippet"), "text", lit(0).alias("source_order"), lit(0).alias("query_pos"),
        lit(0).cast("long").alias("rank"), ident.alias("hit_id"),
    )


def person_reports(requests: DataFrame, pages: DataFrame, found: DataFrame, accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """The whole person job: supplied page, site pages, search hits, listed accounts and profiles give one report a request.

    requests: request_id, name, company, company_domain, work_email, source_url;
    pages: those of views.pages; found: further search hits (request_id,
    hit_id, url, title, text, query_pos, rank).
    """
    supplied = I.supplied_sources(requests, pages)
    asked = requests.drop("source_url")
    hits = gather_hits(asked, pages).unionByName(supplied_hits(supplied, asked))
    more = found.join(asked, "request_id").withColumns({"page_id": lit(None).cast("long"), "source_order": lit(2), "snippet": F.substring("text", 1, SNIPPET)})
    scored = person_evidence(asked, hits.unionByName(more.select(*hits.columns)), accounts, profiles, pages)
    return I.assemble_reports(asked, I.counted_evidence(scored), supplied)


def inputs(spark: SparkSession, sf_dir: str):
    people = V.people(spark, sf_dir)
    pages = V.pages(spark, sf_dir)
    accounts = spark.createDataFrame([], IO.ACCOUNT).withColumn("list_order", lit(0))
    return people, gather_hits(people, pages), accounts, pages


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit's score, category and signals."""
    people, hits, accounts, pages = inputs(spark, sf_dir)
    scored = person_evidence(people, hits, accounts, None, pages)
    return scored.select("request_id", "url", "host", "score", "category", F.array_join("signals", "|").alias("signals"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A4: one conservative status for each person."""
    people, hits, accounts, pages = inputs(spark, sf_dir)
    rows = I.assemble_reports(people, I.counted_evidence(person_evidence(people, hits, accounts, None, pages)))
    return rows.select("request_id", "status", "best_score", "n_evidence", F.size("warnings").cast("long").alias("n_warnings"), F.element_at("queries", 1).alias("query"))


SCORED_SQL = rf"""{V.PAGES_SQL}, {V.PEOPLE_SQL},
raw as (
  select r.*, p.page_id, p.url, p.host, p.title, p.text, p.path, 1 as source_order from v_people r join v_pages p on p.host = r.company_domain or ends_with(p.host, '.' || r.company_domain)
  union all (select r.*, p.page_id, p.url, p.host, p.title, p.text, p.path, 2 from v_people r join v_pages p on lower(p.name) = lower(r.name) and p.domain <> r.company_domain
    qualify row_number() over (partition by r.request_id order by p.page_id) <= 8)),
firsts as (select *, 'https://' || host || regexp_replace(path, '/+$', '') as canonical from raw
  qualify row_number() over (partition by request_id, 'https://' || host || regexp_replace(path, '/+$', '') order by source_order, page_id) = 1),
ranked as (select *, (host = company_domain or ends_with(host, '.' || company_domain)) as official, {V.sql_variants("name")} as vars from firsts),
picked as (select *, official and row_number() over (partition by request_id, official order by
    (case when contains(lower(split_part(url, '?', 1)), vars[1].split(' ')[1]) then 4 else 0 end) + (case when contains(lower(split_part(url, '?', 1)), vars[1].split(' ')[2]) then 3 else 0 end)
    + (case when contains(lower(split_part(url, '?', 1)), vars[1].split(' ')[-1]) then 4 else 0 end)
    + (case when regexp_matches(lower(split_part(url, '?', 1)), 'faculty|profile|staff|resume|_cv|-cv') then 3 else 0 end) desc, source_order, page_id, url) <= 4 as is_read from ranked),
flags as (select *, {V.sql_person("title || ' ' || substr(text, 1, 200)", "name")} as in_result, is_read and {V.sql_person("text", "name")} as on_page,
  {V.sql_phrase("title || ' ' || substr(text, 1, 200)", "company")} or (is_read and {V.sql_phrase("text", "company")}) as company_named,
  contains(lower(title || ' ' || substr(text, 1, 200)), work_email) or (is_read and contains(lower(text), work_email)) as email from picked),
v_scored as (select *, case when in_result or on_page then least(100, s) else least(20, s) end as score, case when is_read then 'company_page' else 'search_result' end as category,
  array_to_string(list_filter([case when in_result then 'full name in search result' end, case when on_page then 'full name on company page' end,
    case when company_named then 'company name matches' end, case when official then 'company domain' end, case when email then 'exact work email publicly listed' end], lambda x: x is not null), '|') as signals
  from (select *, 25 * in_result::int + 35 * on_page::int + 15 * company_named::int + 20 * official::int + 35 * email::int as s from flags))"""
EVIDENCE_SQL = f"with {SCORED_SQL} select request_id, canonical as url, host, cast(score as int) as score, category, signals from v_scored"
STATUS_SQL = f"""with {SCORED_SQL},
g as (select request_id, bool_or(category = 'company_page' and on_page) as official, bool_or(score >= 40 and company_named and in_result) as likely, max(score) as best, count(*) as n, bool_or(email) as email
  from v_scored where in_result or on_page group by request_id)
select r.request_id, case when official then 'supported' when likely then 'possible' else 'unresolved' end as status, cast(coalesce(best, 0) as int) as best_score, coalesce(n, 0) as n_evidence,
  cast(case when not coalesce(email, false) then 1 when n is null then 1 else 0 end as bigint) as n_warnings, '"' || {V.sql_variants("name")}[1] || '" "' || company || '"' as query
from v_people r left join g using (request_id)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 without a domain: every page that names a person, by word pairs."""
    return I.page_mentions(V.pages(spark, sf_dir).select("page_id", "text"), V.people(spark, sf_dir))


MENTIONS_SQL = f"""with {V.PAGES_SQL}, {V.PEOPLE_SQL}, t as (select page_id, ' ' || {V.sql_norm("text")} || ' ' as t from v_pages),
n as (select request_id, unnest({V.sql_variants("name")}) as v from v_people)
select distinct page_id, request_id from t join n on contains(t.t, ' ' || n.v || ' ')"""


def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to read for each person on their domain, robots rules after the choice."""
    p, people = V.pages(spark, sf_dir), V.people(spark, sf_dir)
    index = S.build_site_index(p.select("domain", lit(1).alias("source"), F.col("page_id").alias("pos"), "url")).withColumn("base", F.concat(lit("https://"), "domain"))
    names = people.select(F.col("request_id").alias("record_id"), F.col("company_domain").alias("domain"), "name")
    robots = p.select("host").distinct().select("host", lit(200).alias("status"), lit("User-agent: *\nDisallow: /en/").alias("robots_text"))
    return S.ranked_pages(index, names, robots).select("record_id", "place", "url")


CRAWL_SQL = f"""with {V.PAGES_SQL}, {V.PEOPLE_SQL},
u as (select domain, split_part(url, '#', 1) as url, path, min(page_id) as page_id from v_pages where not regexp_matches(lower(path), '\\.(?:pdf|jpg|png|gif|svg|zip|js|css|mp4)$') group by all),
i as (select *, row_number() over (partition by domain order by page_id, url) as n from u),
s as (select request_id as record_id, i.url, n, path, 15 * {V.sql_held(V.sql_letters("name", 3), "lower(path)")} + 5 * {V.sql_held(V.sql_list(K.PATH_HINTS), "lower(path)")}
  - (length(path) - length(replace(path, '/', ''))) as score from v_people join i on i.domain = company_domain where n <= 1500),
o as (select *, row_number() over (partition by record_id order by score desc, n) as place from s)
select record_id, cast(place as int) as place, url from o where place <= 10 and not starts_with(path, '/en/')"""


def document_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents of each domain."""
    p = V.pages(spark, sf_dir)
    hint = F.element_at(T.literals(["staff-directory", "menu", "annual/board/report", "x/y/z"]), (F.length("title") % 4 + 1).cast("int"))
    rows = p.select(F.col("domain").alias("record_id"), lit("").alias("name"), F.col("page_id").alias("pos"), F.concat(lit("https://"), "host", lit("/"), hint, lit(".pdf")).alias("url"))
    return S.top_documents(rows).select("record_id", "place", "pos", "score")


DOCUMENTS_SQL = f"""with {V.PAGES_SQL},
h as (select domain as record_id, page_id as pos, '/' || ['staff-directory', 'menu', 'annual/board/report', 'x/y/z'][length(title) % 4 + 1] || '.pdf' as low from v_pages),
s as (select record_id, pos, 3 * {V.sql_held(V.sql_list(K.DOCUMENT_HINTS), "low")} - (length(low) - length(replace(low, '/', ''))) as score from h)
select record_id, cast(row_number() over (partition by record_id order by score desc, pos) as int) as place, pos, cast(score as int) as score from s where score > 0
qualify row_number() over (partition by record_id order by score desc, pos) <= 3"""


def website_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each organization's own website among candidate hosts, and its status.

    The organizations are named by the words of a page's title; the candidates
    are the pages of its domain.
    """
    p = V.pages(spark, sf_dir)
    people = V.people(spark, sf_dir).select(F.col("company_domain").alias("domain"), F.col("company").alias("organization_name"), F.col("request_id").alias("first_id"))
    state = F.element_at(T.literals(["FL", "", "XX"]), (F.length("organization_name") % 3 + 1).cast("int"))
    rows = p.join(people, "domain").select(F.col("domain").alias("record_id"), "organization_name", state.alias("state"), "page_id", "url", "host")
    once = O.candidate_sites(rows.select("record_id", F.col("page_id").alias("pos"), "url")).select("record_id", "pos", "url", F.col("host").alias("site"))
    # A record has few candidates; only their texts are looked at.
    chosen = staged(rows.join(once, ["record_id", "url"]), "site-candidates")
    texts = V.pages(spark, sf_dir, chosen).select("page_id", "url", "text", F.array("title").alias("branding"))
    rows = chosen.join(texts, ["page_id", "url"])
    rows = O.organization_matches(rows, "organization_name", "text")
    rows = O.owns_website(rows).withColumn("geography", T.geography_supported(F.col("state"), F.col("text")))
    chosen = O.choose_website(rows.select("record_id", "pos", "url", F.col("site").alias("host"), "matches", "owns", "geography"))
    return O.org_status(rows.select("record_id").distinct(), chosen).select("record_id", "status", "website", "geography_status")


def contacts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of documents, bound to people."""
    docs = V.table(spark, sf_dir, "documents")
    url = F.concat(lit("https://mail1.example.com/"), F.col("doc_id").cast("string"))
    rows = docs.select(F.col("source").alias("record_id"), url.alias("url"), lit("").alias("html"), F.col("text"), lit("").alias("contact_name"))
    found = C.extract_contacts(rows)
    return found.select("record_id", "source_url", "name", "email", "kind", "relevance_score", "identity_status")


def card_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card, a directory row and linked data for each page's person, read again."""
    p = V.pages(spark, sf_dir).where(F.col("name").rlike("^[A-Za-z]{3,} [A-Za-z]{3,}$") & ~F.arrays_overlap(F.split(F.lower("name"), " "), T.literals([*K.NON_PERSON_WORDS, *K.ROLE_WORDS, *K.TITLE_WORDS])))
    who, user = F.initcap("name"), F.lower(F.substring_index("name", " ", 1))
    email = F.concat(user, lit("."), F.col("page_id").cast("string"), lit("@"), "domain")
    card = F.concat(lit("<div><h2>"), who, lit('</h2><p>Billing Director</p><a href="mailto:'), email, lit('">Email</a></div>'))
    data = F.concat(lit('<script type="application/ld+json">{"@type":"Person","name":"'), who, lit('","jobTitle":"General Manager","email":"'), email, lit('"}</script>'))
    html = F.when(F.length("title") % 2 == 0, card).otherwise(data)
    rows = p.select(F.col("domain").alias("record_id"), "url", F.concat(html, F.concat(lit("<p>support@"), "domain", lit("</p>"))).alias("html"), F.concat(lit("support@"), "domain").alias("text"), lit("").alias("contact_name"))
    return C.extract_contacts(rows)


def merged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = card_contacts(spark, sf_dir)
    return C.merge_contacts(found, found.select("record_id", F.col("record_id").alias("company_domain")).distinct())


def staff_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts of each domain's cards."""
    return merged_cards(spark, sf_dir).select("record_id", "email", "name", "title", "relevance_score", "identity_status", "kind", "source_count")


CARDS_SQL = f"""with {V.PAGES_SQL},
w as (select *, lower(split_part(name, ' ', 1)) as a, lower(split_part(name, ' ', 2)) as b from v_pages where regexp_matches(name, '^[A-Za-z]{{3,}} [A-Za-z]{{3,}}$')),
n as (select * from w where a not in ({", ".join(repr(x) for x in [*K.NON_PERSON_WORDS, *K.ROLE_WORDS, *K.TITLE_WORDS])}) and b not in ({", ".join(repr(x) for x in [*K.NON_PERSON_WORDS, *K.ROLE_WORDS, *K.TITLE_WORDS])})),
e as (select domain as record_id, a || '.' || page_id || '@' || domain as email, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] as name,
    case when length(title) % 2 = 0 then 'Billing Director' else 'General Manager' end as title, 90 as r, 'supported' as st, 'person' as kind, url from n),
s as (select domain as record_id, 'support@' || domain as email, '' as name, '' as title, 0 as r, 'review' as st, 'role_mailbox' as kind, url from n),
c as (select *, count(distinct url) over (partition by record_id, email) as source_count from (select * from e union all select * from s)),
o as (select * from c qualify row_number() over (partition by record_id, email order by r desc, url) = 1),
f as (select * from o qualify row_number() over (partition by record_id order by r desc, (name = ''), url, email) <= 50)
select record_id, email, name, title, r as relevance_score, st as identity_status, kind, source_count from f"""


def best_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best contact of each domain."""
    return C.best_contacts(merged_cards(spark, sf_dir)).select("record_id", "email", "name", "title", "relevance_score")


BEST_SQL = f"""{CARDS_SQL.rsplit("select record_id, email", 1)[0]} select record_id, email, name, title, r as relevance_score from f
where name <> '' and st = 'supported' and r >= 50 qualify row_number() over (partition by record_id order by r desc, url, email) = 1"""


def contact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, contact_name, company_domain, url, html, text: each person's hits, with a card of theirs or with their first name and address alone."""
    pages = V.pages(spark, sf_dir)
    hits = gather_hits(V.people(spark, sf_dir), pages).drop("text").join(pages.select("page_id", "text"), "page_id").where(F.col("name").rlike("^[A-Za-z]{3,} [A-Za-z]{3,}$"))
    email = F.concat(F.lower(F.replace("name", lit(" "), lit("."))), lit("@"), "company_domain")
    card = F.concat(lit("<div><h2>"), F.initcap("name"), lit('</h2><p>Billing Director</p><a href="mailto:'), email, lit('">Email</a></div>'))
    first, last = (F.substring_index("name", " ", n) for n in (1, -1))
    alone = F.concat(first, lit(" answers mail to "), F.lower(last), lit("."), F.lower(first), lit("@"), "company_domain")
    carded = F.length("title") % 3 > 0
    return hits.select(
        F.col("request_id").alias("record_id"), F.col("name").alias("contact_name"), "company_domain", "url", F.when(carded, card).otherwise("").alias("html"),
        F.concat("text", lit(" "), F.when(carded, F.concat(F.initcap("name"), lit(" Billing Director"))).otherwise(alone)).alias("text"),
    )


def named_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published addresses of each person, of pages that name them in full and of their own site's others."""
    rows = contact_hits(spark, sf_dir)
    full = T.contains_phrase(F.col("text"), F.col("contact_name"))
    found = C.extract_contacts(rows.where(full)).join(rows.select("record_id", "contact_name", "company_domain").distinct(), "record_id")
    others = C.address_named_rows(rows.where(~full & U.is_company_url(F.col("url"), F.col("company_domain"))))
    columns = ["record_id", "source_url", "name", "email", "relevance_score", "email_evidence", "identity_status"]
    return C.named_contacts(found).select(columns).unionByName(others.withColumnRenamed("url", "source_url").select(columns))


def company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and relevant persons with addresses on each organization's domain."""
    rows = contact_hits(spark, sf_dir)
    found = C.extract_contacts(rows.withColumn("contact_name", lit("")))
    found = found.join(rows.select("record_id", "company_domain", lit("").alias("contact_name")).distinct(), "record_id")
    return C.company_contacts(found).select("record_id", "source_url", "name", "email", "relevance_score", "email_evidence", "identity_status")


def named_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pages(spark, sf_dir)
    role = F.element_at(T.literals(["General Manager", "Billing Manager", "Manager", "CEO"]), (F.length("title") % 4 + 1).cast("int"))
    text = F.concat(lit("Leadership\n"), F.initcap("name"), lit(", "), role, lit("\n"), F.col("text"))
    rows = p.select(F.col("domain").alias("record_id"), F.col("page_id").alias("pos"), "url", text.alias("text"))
    return O.leaders(rows)


def leader_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaders that each domain's pages name."""
    return named_leaders(spark, sf_dir).select("record_id", "rank", "name", "title", "score")


def leader_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts of the first leader of each domain that has one."""
    found = O.leader_contacts(card_contacts(spark, sf_dir), named_leaders(spark, sf_dir))
    return found.select("record_id", "source_url", "name", "title", "email", "relevance_score", "background")


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, organization_name, source_url, hit, text: directory pages of each organization."""
    p = V.pages(spark, sf_dir)
    people = V.people(spark, sf_dir).select(F.col("company_domain").alias("domain"), F.col("company").alias("organization_name"))
    text = F.concat("organization_name", lit(" in Florida. Website: https://"), F.col("host"), lit("/ and more. "))
    source = F.concat(lit("https://list.example.org/"), F.col("page_id").cast("string"))
    return p.join(people, "domain").select(F.col("domain").alias("record_id"), "organization_name", source.alias("source_url"), F.col("page_id").alias("hit"), text.alias("text"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The website that directory pages of each organization agree on."""
    rows = listing_rows(spark, sf_dir).select(
        "record_id", "organization_name", lit("FL").alias("state"), lit("US").alias("country"), "source_url", F.posexplode(O.listing_blocks(F.col("text"))).alias("pos", "b")
    )
    blocks = rows.select("record_id", "organization_name", "state", "country", "source_url", "pos", "b.text", "b.links")
    return O.listing_consensus(blocks).select("record_id", "company_domain", "website")


def listing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing hits of each organization that are read."""
    return H.first_listing_hits(listing_rows(spark, sf_dir)).select("record_id", "hit", "source_url")


LISTING_SQL = f"""with {V.PAGES_SQL}, {V.PEOPLE_SQL}
select domain as record_id, page_id as hit, 'https://list.example.org/' || page_id as source_url from v_pages join v_people on company_domain = domain
qualify row_number() over (partition by domain order by page_id) <= 6"""


def made_posts(p: DataFrame) -> DataFrame:
    """page_id, domain, host, name, company and the url of a post named after each page, of an account that its site lists or doesn't."""
    handle, slug = F.replace("domain", lit("."), lit("_")), F.regexp_replace(F.lower("name"), "[^a-z]+", "-")
    linked = lambda who: F.concat(lit("https://www.linkedin.com/posts/"), who, lit("_"), slug, lit("-activity"))
    url = (
        F.when(F.col("page_id") % 4 == 0, F.concat(lit("https://www.facebook.com/"), handle, lit("/posts/"), F.col("page_id").cast("string")))
        .when(F.col("page_id") % 4 == 1, linked(F.concat(lit("unlisted_"), handle))).otherwise(linked(handle))
    )
    return p.select("page_id", "domain", "host", "name", "company", url.alias("url"))


def made_accounts(p: DataFrame) -> DataFrame:
    """The accounts that each site lists."""
    kinds = F.posexplode(T.literals(["linkedin", "facebook"])).alias("list_order", "platform")
    proof = F.concat(lit("https://"), "domain", lit("/about")).alias("proof_url")
    return p.select("domain").distinct().select("domain", F.replace("domain", lit("."), lit("_")).alias("handle"), proof, kinds)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts named after each page, of accounts that their site lists or doesn't, with the account's authority."""
    p = V.pages(spark, sf_dir)
    hits = made_posts(p).select(F.col("page_id").alias("hit_id"), "url", F.col("host").alias("company_domain"))
    return I.official_posts(hits, made_accounts(p)).select("hit_id", "authority_url", "authority_domain")


POSTS_SQL = f"""with {V.PAGES_SQL}
select page_id as hit_id, 'https://' || domain || '/about' as authority_url, domain as authority_domain from v_pages where page_id % 4 <> 1"""


def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile pages of each person's hits that are read; reserved paths are no profiles."""
    p, people = V.pages(spark, sf_dir), V.people(spark, sf_dir)
    user = F.when(F.col("page_id") % 5 == 0, "topics").otherwise(F.concat(lit("u"), F.col("page_id").cast("string")))
    rows = p.select("domain", "page_id", F.concat(lit("https://github.com/"), user).alias("url")).join(people, F.col("domain") == F.col("company_domain"))
    hits = rows.select("request_id", "url", lit(2).alias("source_order"), (F.col("page_id") % 3).alias("query_pos"), F.col("page_id").alias("rank"))
    return H.chosen_profiles(hits).select("request_id", "url")


PROFILE_CHOICE_SQL = f"""with {V.PAGES_SQL}, {V.PEOPLE_SQL}
select request_id, 'https://github.com/u' || page_id as url from v_pages join v_people on company_domain = domain where page_id % 5 <> 0
qualify row_number() over (partition by request_id order by page_id % 3, page_id) <= 2"""


def asked_with_sources(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Person requests, by id in turn with a page of their site, one that is not there, one elsewhere and none."""
    kind = F.col("request_id") % 4
    pages = V.pages(spark, sf_dir) if pages is None else pages
    own = pages.select(F.col("page_id").alias("request_id"), "url")
    source = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(lit("https://"), "company_domain", lit("/not-there"))).when(kind == 2, "https://elsewhere.example/x")
    return V.people(spark, sf_dir, pages).join(own, "request_id").withColumn("source_url", source).drop("url")


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that comes with a request, and why it is no hit."""
    pages = V.pages(spark, sf_dir).select("page_id", "url", "text")
    return I.supplied_sources(asked_with_sources(spark, sf_dir), pages).select("request_id", "url", "warning")


SUPPLIED_SQL = f"""with {V.PAGES_SQL}, {V.PEOPLE_SQL},
c as (select *, 'https://' || host || regexp_replace(path, '/+$', '') as canonical from v_pages),
k as (select canonical, arg_min(text, page_id) as text from c group by canonical),
q as (select r.request_id, r.name, c.canonical, case r.request_id % 4 when 0 then c.url when 1 then 'https://' || r.company_domain || '/not-there' when 2 then 'https://elsewhere.example/x' end as url
  from v_people r join c on c.page_id = r.request_id)
select q.request_id, q.url, case q.request_id % 4 when 2 then '{I.OUTSIDE.replace("'", "''")}' when 1 then '{I.UNREAD}'
  when 0 then (case when {V.sql_person("k.text", "q.name")} then null else '{I.NOT_NAMED}' end) end as warning
from q join k using (canonical) where q.url is not null"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over the whole job: supplied pages, posts of listed accounts and public profiles beside the pages of a site."""
    p = staged(V.pages(spark, sf_dir).drop("html"), "report-pages")  # texts are made of the markup once
    asked = asked_with_sources(spark, sf_dir, p)
    who = asked.select("request_id", F.col("company_domain").alias("_domain"))
    said = F.concat_ws(" of ", "name", "company")
    account = F.concat(lit("https://github.com/u"), F.col("page_id").cast("string"))
    rows = made_posts(p).withColumn("url", F.explode(F.array("url", account)))
    found = rows.join(who, F.col("domain") == F.col("_domain")).select(
        "request_id", F.concat_ws("-", F.col("request_id").cast("string"), "url").alias("hit_id"), "url", F.col("name").alias("title"), said.alias("text"),
        (F.col("page_id") % 3).cast("int").alias("query_pos"), F.col("page_id").alias("rank"),
    )
    profiles = p.select(account.alias("url"), "name", "company", lit(None).cast("string").alias("bio"), lit(None).cast("string").alias("email"))
    made = person_reports(asked, p, found, made_accounts(p), profiles)
    return made.select("request_id", "status", "best_score", "n_evidence", "warnings", F.transform("evidence", lambda e: e["url"]).alias("urls"))


def organization_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each organization with excerpts, its pages before its listings."""
    own = V.pages(spark, sf_dir).select(F.col("domain").alias("record_id"), F.col("page_id").alias("pos"), "url", "text")
    listed = listing_rows(spark, sf_dir).select("record_id", F.col("hit").alias("pos"), F.col("source_url").alias("url"), "text")
    return O.org_evidence(own, listed)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed blocks of every page, with the number of their links."""
    rows = V.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    parsed = P.parse_pages(rows).select("url", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("page_id", "url").join(parsed, "url").select("page_id", "pos", F.length("b.text").alias("chars"), F.size("b.links").alias("n_links"))


QUERIES = {
    "person_evidence": (evidence, EVIDENCE_SQL),
    "person_status": (statuses, STATUS_SQL),
    "page_mentions": (mentions, MENTIONS_SQL),
    "crawl_order": (crawl_order, CRAWL_SQL),
    "document_choice": (document_choice, DOCUMENTS_SQL),
    "staff_cards": (staff_cards, CARDS_SQL),
    # Misspelled words, spans of capitalized words and nested blocks are beyond SQL; tests hold these against literal rows.
    "website_choice": (website_choice, None),
    "contacts_found": (contacts_found, None),
    "best_contact": (best_cards, BEST_SQL),
    "official_posts": (posts, POSTS_SQL),
    "profile_choice": (profile_choice, PROFILE_CHOICE_SQL),
    "supplied_sources": (supplied, SUPPLIED_SQL),
    # Tests hold the job against literal requests.
    "person_reports": (reports, None),
    "named_contacts": (named_lookup, None),
    "company_contacts": (company_lookup, None),
    "leaders": (leader_lookup, None),
    "leader_contacts": (leader_addresses, None),
    "listing_hits": (listing_hits, LISTING_SQL),
    "organization_evidence": (organization_evidence, None),
    "listing_consensus": (listings, None),
    "page_blocks": (blocks, None),
}
