"""Queries over the scalar functions: URLs, names, texts, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import constants as K
from vouch.functions import text as T
from vouch.functions import urls as U
from vouch.plans import views as V


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U8 and U10-U12 on each page's URL."""
    p = V.pages(spark, sf_dir)
    url, domain, name = F.col("url"), F.col("domain"), F.col("name")
    pdf = F.concat(F.lit("https://"), domain, F.lit("/staff-directory/"), F.lower(F.substring_index(name, " ", 1)), F.lit(".pdf"))
    github = F.concat(F.lit("https://github.com/"), F.regexp_replace(F.substring_index(name, " ", 1), "[^A-Za-z]", ""))
    account = U.homepage_account(F.concat(F.lit("https://www.linkedin.com/company/"), F.substring_index(name, " ", 1)), domain, url)
    return p.select(
        "page_id",
        U.canonical_url(url).alias("canonical"),
        U.is_company_url(url, domain).alias("own"),
        U.is_company_url(url, F.lit("www.example.org")).alias("own_org"),
        U.github_username(github).alias("github"),
        U.fetchable(url).alias("fetchable"),
        U.excluded_host(U.host(url), ["example.net", *K.BROKER_HOSTS]).alias("excluded"),
        U.crawl_candidate(url, domain).alias("candidate"),
        U.page_score(url, F.col("title")).alias("page_score"),
        U.profile_page_rank(pdf, name).alias("profile_rank"),
        U.document_score(pdf, name).alias("document_score"),
        account["handle"].alias("handle"),
        U.personal_rank(pdf, name).alias("personal_rank"),
        U.contact_path_rank(pdf).alias("contact_rank"),
    )


PDF_SQL = "'https://' || domain || '/staff-directory/' || lower(split_part(name, ' ', 1)) || '.pdf'"
PDF_PATH_SQL = "'/staff-directory/' || lower(split_part(name, ' ', 1)) || '.pdf'"
URL_SQL = rf"""with {V.PAGES_SQL}
select page_id, 'https://' || host || regexp_replace(path, '/+$', '') as canonical, true as own,
  (host = 'example.org' or ends_with(host, '.example.org')) as own_org,
  case when regexp_matches(regexp_replace(split_part(name, ' ', 1), '[^A-Za-z]', '', 'g'), '^[A-Za-z][A-Za-z]{{0,38}}$')
    and lower(regexp_replace(split_part(name, ' ', 1), '[^A-Za-z]', '', 'g')) not in ({", ".join(repr(x) for x in K.RESERVED_PROFILES)})
    then regexp_replace(split_part(name, ' ', 1), '[^A-Za-z]', '', 'g') end as github,
  true as fetchable, (host = 'example.net' or ends_with(host, '.example.net')) as excluded,
  not regexp_matches(lower(path), '\.(?:pdf|jpg|png|gif|svg|zip|js|css|mp4)$') and length(path) < 250 as candidate,
  cast(15 * {V.sql_held(V.sql_letters("title", 3), "lower(path)")} + 5 * {V.sql_held(V.sql_list(K.PATH_HINTS), "lower(path)")}
    - (length(path) - length(replace(path, '/', ''))) as int) as page_score,
  cast((case when contains(lower({PDF_SQL}), {V.sql_variants("name")}[1].split(' ')[1]) then 4 else 0 end)
    + (case when contains(lower({PDF_SQL}), {V.sql_variants("name")}[1].split(' ')[2]) then 3 else 0 end)
    + (case when len(list_filter({V.sql_variants("name")}, lambda v: contains(lower({PDF_SQL}), v.split(' ')[-1]))) > 0 then 4 else 0 end) + 3 + 1 as int) as profile_rank,
  cast(10 * {V.sql_held(V.sql_letters("name", 3), PDF_PATH_SQL)} + 3 * {V.sql_held(V.sql_list(K.DOCUMENT_HINTS), PDF_PATH_SQL)} - 2 as int) as document_score,
  case when lower(split_part(name, ' ', 1)) not in ({", ".join(repr(x) for x in K.RESERVED_HANDLES)}) then split_part(name, ' ', 1) end as handle,
  cast({V.sql_held(V.sql_letters("name", 3), PDF_PATH_SQL)} + 1 as int) as personal_rank,
  cast({V.sql_held(V.sql_list(K.CONTACT_HINTS), PDF_PATH_SQL)} as int) as contact_rank
from v_pages"""


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a test label in front, beside the plain URL."""
    p = V.pages(spark, sf_dir)
    test = F.concat(F.lit("https://qa-"), "host", F.lit("/x"))
    return p.select("page_id", F.array_join(U.site_candidates(F.array(test, "url", test)), " ").alias("sites"))


SITES_SQL = rf"""with {V.PAGES_SQL}
select page_id, (case when len(host.split('.')) > 2 and not (starts_with('qa-' || host, 'www.')) then 'https://' || host.split('.')[-2] || '.' || host.split('.')[-1]
  else 'https://qa-' || host || '/x' end) || (case when url = 'https://' || host.split('.')[-2] || '.' || host.split('.')[-1] then '' else ' ' || url end) as sites from v_pages"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4, T6, T11-T14, T16, T24 and T25 on titles and page texts."""
    p = V.pages(spark, sf_dir)
    name, company, title, text, email = (F.col(c) for c in ("name", "company", "title", "text", "email"))
    fake = F.concat(F.substring_index(name, " ", 1), F.lit(" Chaubey"))
    state = F.element_at(T.literals(["FL", "GA", "XX"]), (F.length("title") % 3 + 1).cast("int"))
    listed = F.concat(text, F.lit(" FL 32801-1234 "))
    role = F.element_at(T.literals(["General Manager", "", "Manager", "Media Officer", "Clerk"]), (F.length("title") % 5 + 1).cast("int"))
    return p.select(
        "page_id",
        T.normalized(title).alias("normalized"),
        T.contains_phrase(text, company).alias("has_company"),
        F.array_join(T.name_variants(F.concat(F.lit("Dr. "), fake)), "|").alias("variants"),
        T.contains_person_name(text, name).alias("has_person"),
        F.array_join(T.person_request_errors(F.substring_index(name, " ", 1 + 0), company, F.col("domain"), email, F.col("url")), "|").alias("errors"),
        T.local_matches_name(email, name).alias("local_matches"),
        T.same_person(F.concat(F.lit("Ms. "), name, F.lit(" A. "), company), name).alias("same_person"),
        T.human_name(F.concat(T.capitalized(name), F.lit(" Smith"))).alias("human"),
        T.spelled_out(F.concat(F.substring_index(company, " ", 1), F.lit(" Elec Power Assn"))).alias("spelled"),
        T.rank_contact(role, F.lit(False), text).alias("rank"),
        T.geography_supported(state, listed).alias("geography"),
        T.clean_document_text(F.col("html"), 300).alias("cleaned"),
    )


TEXT_SQL = rf"""with {V.PAGES_SQL},
f as (select *, split_part(name, ' ', 1) || ' Chaubey' as fake, ['FL', 'GA', 'XX'][length(title) % 3 + 1] as state, text || ' FL 32801-1234 ' as listed,
  ['General Manager', '', 'Manager', 'Media Officer', 'Clerk'][length(title) % 5 + 1] as role, split_part(name, ' ', 1) as one from v_pages)
select page_id, {V.sql_norm("title")} as normalized, {V.sql_phrase("text", "company")} as has_company,
  array_to_string({V.sql_variants("'Dr. ' || fake")}, '|') as variants, {V.sql_person("text", "name")} as has_person,
  array_to_string(list_filter([case when length(one) < 3 or length(one) > 120 then 'name length' end, 'full name needed', 'two name words needed'], lambda e: e is not null), '|') as errors,
  len(list_filter({V.sql_letters("name", 3)}, lambda t: contains(regexp_replace(split_part(email, '@', 1), '[^a-z]', '', 'g'), t))) > 0
    or (len({V.sql_letters("name", 3)}) >= 2 and regexp_replace(split_part(email, '@', 1), '[^a-z]', '', 'g') in (
      {V.sql_letters("name", 3)}[1][1] || {V.sql_letters("name", 3)}[-1], {V.sql_letters("name", 3)}[-1] || {V.sql_letters("name", 3)}[1][1],
      {V.sql_letters("name", 3)}[1] || {V.sql_letters("name", 3)}[-1][1])) as local_matches,
  len({V.sql_letters("name", 2)}) > 0 as same_person,
  regexp_matches(list_aggregate(list_transform(name.split(' '), lambda t: upper(t[1]) || lower(t[2:])), 'string_agg', ' ') || ' Smith', '^{K.PERSON_NAME.replace("'", "''")}$')
    and len(list_intersect(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}_]+'), {V.sql_list([*K.NON_PERSON_WORDS, *K.ROLE_WORDS])})) = 0 as human,
  coalesce(map({V.sql_list(K.ABBREVIATIONS)}, {V.sql_list(sorted(v)[0] for v in K.ABBREVIATIONS.values())})[lower(split_part(company, ' ', 1))],
    split_part(company, ' ', 1)) || ' electric Power association' as spelled,
  cast(case when regexp_matches(text, '(?i)\b(?:animal services|animal shelter|recreation|police|fire department|library|building permits)\b') then 10
    when role = 'Manager' and not regexp_matches(text, '(?i)\b(?:utility|utilities|water|gas|electric|billing|finance|information|technology)\b') then 25
    when role = 'Media Officer' then 10 when role = 'General Manager' then 90 when role <> '' then 55 else 25 end as int) as rank,
  state <> 'GA' or {V.sql_phrase("listed", "'Georgia'")} or regexp_matches(listed, '\bGA\s+\d{{5}}(?:-\d{{4}})?\b') as geography,
  substr(trim(regexp_replace(html, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), 1, 300) as cleaned
from f"""


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the searches of each person request, by what the request holds, one row a search."""
    p = V.pages(spark, sf_dir)
    kind = F.length("title") % 4
    some = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c))
    name = F.concat(F.substring_index("name", " ", 1), F.lit(" Choubey"))
    plan = T.query_plan(name, some("company", 1, 3), some("domain", 2, 3), some("email", 2, 3))
    return p.select("page_id", F.posexplode(plan).alias("pos", "query"))


PLAN_SQL = f"""with {V.PAGES_SQL},
n as (select page_id, length(title) % 4 as kind, company, domain, email, {V.sql_norm("split_part(name, ' ', 1)")} as one from v_pages),
q as (select page_id, case kind
  when 0 then ['"' || one || ' choubey"', '"' || one || ' chaubey"']
  when 1 then ['"' || one || ' choubey" "' || company || '"', '"' || one || ' chaubey" "' || company || '"']
  when 2 then ['"' || one || ' choubey" site:' || domain, '"' || one || ' chaubey" site:' || domain, '"' || email || '"']
  else ['"' || one || ' choubey" "' || company || '"', '"' || one || ' chaubey" site:' || domain, '"' || email || '"'] end as plan from n where one <> '')
select page_id, cast(pos - 1 as int) as pos, plan[pos] as query from q, unnest(range(1, len(plan) + 1)) as u(pos)"""


def org_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Website searches of each organization."""
    p = V.pages(spark, sf_dir)
    kind = F.when(F.length("title") % 2 == 0, "Association").otherwise("ICP")
    plan = lambda k: F.array_join(T.org_query_plan(F.col("company"), F.lit("FL"), F.lit(None).cast("string"), F.lit("US"), kind, F.col("name"), F.col("domain"), k), "\n")
    return p.select("page_id", *[plan(k).alias(k) for k in ("website", "listing", "named", "company")])


ORG_PLAN_SQL = f"""with {V.PAGES_SQL},
o as (select *, case when length(title) % 2 = 0 then 'utility association ' else '' end as sector,
  array_to_string(list_transform(company.split(' '), lambda w: coalesce(map({V.sql_list(K.ABBREVIATIONS)}, {V.sql_list(sorted(v)[0] for v in K.ABBREVIATIONS.values())})[lower(w)], w)), ' ') as full_name from v_pages)
select page_id, full_name || ' FL United States ' || sector || 'official website' || chr(10) || '"' || company || '" FL United States ' || sector || 'official website' as website,
  '"' || full_name || '" FL United States directory website email' as listing,
  '"' || name || '" site:' || domain || chr(10) || '"' || name || '" "' || company || '" email' || chr(10) || name || ' site:' || domain || chr(10) || name || ' ' || company as named,
  'site:' || domain || ' "@' || domain || '" staff' || chr(10) || '"@' || domain || '" "' || full_name || '" directory filetype:pdf' || chr(10) || '"' || full_name || '" billing finance general manager email' as company
from o"""


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of every document, by position."""
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.emails(F.col("text"))).alias("pos", "email"))


EMAILS_SQL = r"""with found as (select doc_id, list_transform(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'), lambda e: lower(e)) as e from documents),
each as (select doc_id, e[i] as email, i from found, unnest(range(1, len(e) + 1)) as u(i)),
first as (select doc_id, email, min(i) as i from each group by all)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as pos, email from first"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of each page's company in its text."""
    p = V.pages(spark, sf_dir)
    return p.select(
        "page_id",
        T.relevant_excerpt(F.concat(F.col("text"), F.lit(" mail "), F.col("email")), F.col("company"), F.col("email")).alias("relevant"),
        T.hit_excerpt(F.col("text"), F.col("company")).alias("hit"),
    )


EXCERPT_SQL = rf"""with {V.PAGES_SQL},
t as (select page_id, company, email, text, trim(regexp_replace(text || ' mail ' || email, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) as whole,
  list_filter({V.sql_variants("company")}, lambda v: contains(lower(text || ' mail ' || email), v))[1] as found from v_pages),
a as (select *, strpos(lower(whole), found) as place, strpos(lower(whole), email) as mail_at, strpos(lower(text), lower(company)) as hit_at from t),
b as (select *, trim(substr(whole, greatest(place - 40, 1), place + length(found) + 520 - greatest(place - 40, 1))) as around from a)
select page_id, substr(case when found is null then whole when contains(lower(around), email) or mail_at = 0 then around
    else around || ' ... ' || trim(substr(whole, greatest(mail_at - 55, 1), mail_at + length(email) + 80 - greatest(mail_at - 55, 1))) end, 1, 1000) as relevant,
  case when hit_at > 0 then substr(text, greatest(hit_at - 160, 1), hit_at + length(company) + 240 - greatest(hit_at - 160, 1)) else substr(text, 1, 400) end as hit
from b"""

QUERIES = {
    "url_functions": (url_functions, URL_SQL),
    "site_candidates": (site_candidates, SITES_SQL),
    "text_functions": (text_functions, TEXT_SQL),
    "query_plans": (query_plans, PLAN_SQL),
    "org_query_plans": (org_query_plans, ORG_PLAN_SQL),
    "document_emails": (document_emails, EMAILS_SQL),
    "excerpts": (excerpts, EXCERPT_SQL),
}
