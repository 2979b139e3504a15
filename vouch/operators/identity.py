"""Person evidence: signals of each hit, and one conservative status a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions import urls as U
from vouch.session import staged

IN_RESULT, ON_PAGE, ON_DOCUMENT = "full name in search result", "full name on company page", "full name on official document"
SHORT, ON_PROFILE = "short name linked to surname by official email", "full name on public GitHub profile"
COMPANY, DOMAIN = "company name matches", "company domain"
LISTED, IN_POST, EMAIL = "institution-listed social account", "full name in indexed institutional post", "exact work email publicly listed"
OUTSIDE = "The supplied page is not on the company's domain, so it is no company evidence."
UNREAD, NOT_NAMED = "The supplied page could not be read.", "The supplied page does not name this person."
#: What each fact about a hit adds to its score.
POINTS = {"in_result": 25, "on_page": 35, "on_profile": 30, "company_named": 15, "official": 20, "exact_email": 35, "has_profile": 10, "social": 35, "short": 30}


def official_posts(hits: DataFrame, accounts: DataFrame) -> DataFrame:
    """(hit_id, authority_url, authority_domain): the first listed account whose post a hit is.

    hits: hit_id, url, company_domain; accounts: domain, platform, handle,
    proof_url, list_order. Every handle that a URL may belong to is an
    equi-join key, and so is every parent of the request's domain.
    """
    url = F.col("url")
    low = F.lower(F.regexp_replace(U.path(url), r"^/+|/+$", ""))
    post = F.regexp_extract(low, r"^posts/([^/]*)", 1)
    marks = F.split(post, "_")
    # A handle may itself hold `_`, so each front part of the post's name may be one.
    fronts = F.when(F.size(marks) > 1, F.transform(F.sequence(F.lit(1), F.size(marks) - 1), lambda i: F.array_join(F.slice(marks, 1, i), "_")))
    linkedin = U.host(url).isin("linkedin.com", "www.linkedin.com") & low.startswith("posts/")
    facebook = U.host(url).isin("facebook.com", "www.facebook.com")
    page = F.regexp_extract(low, r"^([^/]+)/posts/", 1)
    handles = F.when(linkedin, fronts).when(facebook & (page != ""), F.array(page))
    rows = hits.withColumns({"p_handle": handles, "p_platform": F.when(linkedin, "linkedin").otherwise("facebook")})
    rows = rows.where(F.col("p_handle").isNotNull() & F.col("company_domain").isNotNull())
    rows = rows.withColumn("p_handle", F.explode("p_handle")).withColumn("p_domain", F.explode(U.host_suffixes(U.bare_domain(F.col("company_domain")))))
    own = accounts.select(F.col("domain").alias("authority_domain"), "platform", F.lower("handle").alias("handle"), "proof_url", "list_order")
    met = rows.join(
        own, (F.col("p_handle") == F.col("handle")) & (F.col("p_platform") == F.col("platform")) & (F.col("p_domain") == F.col("authority_domain"))
    )
    first = met.groupBy("hit_id").agg(F.min_by(F.struct("proof_url", "authority_domain"), "list_order").alias("a"))
    return first.select("hit_id", F.col("a.proof_url").alias("authority_url"), "a.authority_domain")


def supplied_sources(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """request_id, url, text and warning of each request that names a source_url.

    A read page of the company's site that names the person has no warning and
    is a hit; any other is none. pages: page_id, url, text; of pages with one
    canonical URL the smallest id counts.
    """
    given = requests.where(F.coalesce("source_url", F.lit("")) != "").select("request_id", "name", "company_domain", F.col("source_url").alias("url"))
    given = given.withColumn("own", F.coalesce(U.is_company_url(F.col("url"), F.col("company_domain")), F.lit(False)))
    given = given.withColumn("key", F.when(F.col("own"), U.canonical_url(F.col("url"))))
    texts = pages.select(U.canonical_url(F.col("url")).alias("key"), "page_id", "text").join(given.select("key"), "key", "left_semi")
    rows = given.join(texts.groupBy("key").agg(F.min_by("text", "page_id").alias("text")), "key", "left")
    named = F.coalesce(T.contains_person_name(F.col("text"), F.col("name")), F.lit(False))
    warning = F.when(~F.col("own"), OUTSIDE).when(F.col("text").isNull(), UNREAD).when(~named, NOT_NAMED)
    return rows.select("request_id", "url", "text", warning.alias("warning"))


def near(page: Column, variant: Column, email: Column, before: int = 150, after: int = 600) -> Column:
    """Whether an address stands around some literal place of a spelling: pieces between places give all windows.

    A spelling has three characters or more, so after // 3 + 2 pieces are as long as the window behind.
    """
    parts = F.split(F.lower(page), F.concat(F.lit(r"\Q"), variant, F.lit(r"\E")))
    return T.bound(
        parts,
        lambda pieces: F.exists(
            F.sequence(F.lit(1), F.size(pieces) - 1),
            lambda i: F.contains(
                F.concat(
                    F.right(F.get(pieces, i - 1), F.lit(before)), variant,
                    F.left(F.call_function("array_join", F.slice(pieces, i + 1, F.lit(after // 3 + 2)), variant), F.lit(after)),
                ), email,
            ),
        ) & (F.size(pieces) > 1),
    )


def short_name_linked(page: Column, name: Column, domain: Column, url: Column) -> Column:
    """Whether an official page gives a name without its surname beside an address of the domain that holds the surname."""
    variants = T.name_variants(name)
    tokens = F.split(F.get(variants, F.lit(0)), " ")
    short = F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    surnames = F.transform(variants, lambda v: F.substring_index(v, " ", -1))
    addresses = lambda low: F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9._%+-]+@[a-z0-9.-]+"), F.lit(0)))

    def linked(address: Column, low: Column) -> Column:
        own = F.regexp_extract_all(F.substring_index(address, "@", 1), F.lit("[a-z]+"), F.lit(0))
        there = (F.substring_index(address, "@", -1) == U.bare_domain(domain)) & F.array_contains(own, F.get(tokens, F.lit(0)))
        around = T.bound(
            F.split(low, F.concat(F.lit(r"\Q"), address, F.lit(r"\E"))),
            lambda pieces: (F.size(pieces) > 1)
            & F.exists(
                F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
                lambda i: T.contains_phrase(
                    F.concat(F.right(F.get(pieces, i - 1), F.lit(350)), address, F.left(F.coalesce(F.get(pieces, i), F.lit("")), F.lit(100))), short
                ),
            ),
        )
        return there & F.arrays_overlap(surnames, own) & around

    anywhere = T.bound(T.folded(page), lambda low: F.exists(addresses(low), lambda address: linked(address, low)))
    known = (F.size(variants) > 0) & (F.coalesce(domain, F.lit("")) != "") & (F.size(tokens) >= 3)
    return F.coalesce(known & F.contains(F.lower(U.path(url)), F.get(tokens, F.lit(0))) & anywhere, F.lit(False))


def score_evidence(hits: DataFrame) -> DataFrame:
    """Signals, score, category and excerpt of each hit.

    hits: request_id, hit_id, name, company, company_domain, work_email, url,
    title, snippet, page (text or null), profile (struct of name, company, bio,
    email, or null), authority_url, authority_domain.
    """
    c = F.col
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = hits.withColumns(
        {
            "host": U.host(c("url")),
            "summary": F.concat_ws(" ", "title", "snippet"),
            "page": F.coalesce("page", F.lit("")),
            "profile_text": F.concat_ws(" ", *[F.coalesce(c("profile")[f], F.lit("")) for f in ("name", "company", "bio", "email")]),
            "has_profile": c("profile").isNotNull(),
            "email_low": F.nullif(F.lower("work_email"), F.lit("")),
            "variants": T.name_variants(c("name")),
        }
    )
    rows = rows.withColumns(
        {
            "official": no(known(c("company_domain")) & U.within(c("host"), c("company_domain"))),
            "in_result": T.contains_person_name(c("summary"), c("name")),
            "on_page": T.contains_person_name(c("page"), c("name")),
            "on_profile": c("has_profile") & T.contains_person_name(F.coalesce(c("profile")["name"], F.lit("")), c("name")),
            "company_named": no(
                known(c("company"))
                & (T.contains_phrase(c("summary"), c("company")) | T.contains_phrase(c("page"), c("company"))
                   | (c("has_profile") & T.contains_phrase(c("profile_text"), c("company"))))
            ),
            "document": F.endswith(F.lower(U.path(c("url"))), F.lit(".pdf")),
        }
    )
    listed = F.contains(F.lower("summary"), c("email_low")) | F.contains(F.lower("page"), c("email_low"))
    listed = listed | (F.lower(F.coalesce(c("profile")["email"], F.lit(""))) == c("email_low"))
    beside = F.exists("variants", lambda v: near(c("page"), v, c("email_low")))
    rows = rows.withColumns(
        {
            "social": no(c("authority_url").isNotNull() & known(c("company")) & c("in_result") & T.contains_phrase(c("snippet"), c("company"))),
            "short": no(c("official") & known(c("page")) & ~c("on_page") & short_name_linked(c("page"), c("name"), c("company_domain"), c("url"))),
            # Beside the name of another person, an address is no evidence for this one.
            "exact_email": no(c("email_low").isNotNull() & listed & F.when(c("on_page"), beside).otherwise(F.lit(True))),
        }
    )
    signals = [
        (c("in_result"), IN_RESULT), (c("on_page") & ~c("document"), ON_PAGE), (c("on_page") & c("document"), ON_DOCUMENT), (c("short"), SHORT),
        (c("on_profile"), ON_PROFILE), (c("company_named"), COMPANY), (c("official"), DOMAIN), (c("social"), LISTED), (c("social"), IN_POST),
        (c("exact_email"), EMAIL),
    ]
    total = sum((F.when(c(k), n).otherwise(0) for k, n in POINTS.items()), F.lit(0))
    named = c("in_result") | c("on_page") | c("on_profile") | c("short")
    on_page = known(c("page")) & c("official")
    rows = rows.withColumns(
        {
            "signals": F.array_compact(F.array(*[F.when(x, F.lit(s)) for x, s in signals])),
            "score": F.when(named, F.least(total, F.lit(100))).otherwise(F.least(total, F.lit(20))),
            "category": F.when(on_page & c("document"), "official_document").when(on_page, "company_page")
            .when(c("has_profile"), "github_public_profile").when(c("social"), "official_social_post_indexed").otherwise("search_result"),
            "excerpt": F.when(on_page, T.relevant_excerpt(c("page"), c("name"), c("work_email")))
            .when(c("has_profile"), F.substring("profile_text", 1, 1000)).otherwise(F.substring("snippet", 1, 1000)),
        }
    )
    return rows.select(
        "request_id", "hit_id", U.canonical_url(c("url")).alias("url"), "host", "title", "excerpt", "signals", "score", "category",
        "authority_url", "authority_domain",
    )


def counted_evidence(scored: DataFrame) -> DataFrame:
    """Hits that name the person: what a report shows."""
    return scored.where(F.exists("signals", lambda s: s.startswith("full name ") | (s == SHORT)))


def resolve_status(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, status, best_score, n_evidence, email_confirmed for every request.

    evidence: the rows of counted_evidence. Only flags and scores are shuffled;
    requests without evidence are unresolved.
    """
    has = lambda s: F.array_contains("signals", s)
    page = F.col("category").isin("company_page", "official_document")
    rows = evidence.select(
        "request_id", "host", "score",
        (((F.col("category") == "company_page") & has(ON_PAGE)) | ((F.col("category") == "official_document") & has(ON_DOCUMENT)) | (page & has(SHORT))).alias("official"),
        ((F.col("category") == "github_public_profile") & has(COMPANY) & has(ON_PROFILE)).alias("independent"),
        ((F.col("category") == "official_social_post_indexed") & has(IN_POST) & F.col("authority_url").isNotNull()).alias("social"),
        ((F.col("score") >= 40) & has(COMPANY) & has(IN_RESULT)).alias("likely"), has(EMAIL).alias("email"),
    )
    grouped = rows.groupBy("request_id").agg(
        F.collect_set(F.when(F.col("official"), F.col("host"))).alias("official_hosts"),
        F.collect_set(F.when(F.col("independent") & (F.col("score") >= 55), F.col("host"))).alias("independent_hosts"),
        F.bool_or("official").alias("official"), F.bool_or("independent").alias("independent"), F.bool_or("social").alias("social"),
        F.bool_or("likely").alias("likely"), F.max("score").alias("best_score"), F.count("*").alias("n_evidence"), F.bool_or("email").alias("email_confirmed"),
    )
    name_only = F.coalesce(F.nullif("company", F.lit("")), F.nullif("company_domain", F.lit("")), F.nullif("work_email", F.lit(""))).isNull()
    other = F.size(F.array_except("independent_hosts", "official_hosts")) > 0
    status = (
        F.when(F.col("official") & other, "corroborated")
        .when(F.col("official") | F.col("social"), "supported")
        .when(F.col("independent") | F.col("likely") | (name_only & (F.col("n_evidence") > 0)), "possible")
        .otherwise("unresolved")
    )
    rows = requests.join(grouped, "request_id", "left")
    return rows.select(
        "request_id", status.alias("status"), F.coalesce("best_score", F.lit(0)).alias("best_score"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("email_confirmed", F.lit(False)).alias("email_confirmed"),
    )


def assemble_reports(requests: DataFrame, evidence: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """One report a request: its status, its evidence best first, its searches and warnings, those of supplied_sources first."""
    status = resolve_status(requests, evidence)
    items = evidence.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "hit_id", "url", "host", "title", "excerpt", "signals", "score", "category"))).alias("evidence")
    )
    rows = requests.join(status, "request_id").join(items, "request_id", "left")
    unconfirmed = (F.coalesce("work_email", F.lit("")) != "") & ~F.col("email_confirmed")
    nothing = (F.col("n_evidence") == 0) & ~unconfirmed
    if supplied is None:
        rows = rows.withColumn("source_warning", F.lit(None).cast("string"))
    else:
        rows = rows.join(supplied.select("request_id", F.col("warning").alias("source_warning")), "request_id", "left")
    warnings = F.array(
        F.col("source_warning"),
        F.when(unconfirmed, F.lit("Work email was not publicly confirmed; mailbox ownership and deliverability are untested.")),
        F.when(nothing, F.lit("No result named this person; this does not prove the person does not exist.")),
    )
    return rows.withColumns(
        {"warnings": F.array_compact(warnings), "queries": T.query_plan(*[F.col(x) for x in ("name", "company", "company_domain", "work_email")])}
    ).drop("source_warning")


def pages_of_domains(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (company_domain, ...) with each page whose host is their domain or under it: an equi-join on host suffixes."""
    rows = pages.withColumn("_suffix", F.explode(U.host_suffixes(U.host(F.col("url")))))
    wanted = requests.where(F.coalesce("company_domain", F.lit("")) != "").withColumn("_domain", U.bare_domain(F.col("company_domain")))
    return rows.join(wanted, F.col("_suffix") == F.col("_domain")).drop("_suffix", "_domain")


#: Bits of the filter of word pairs at least and at most, and bits for each pair between.
LEAST, FILTER, ROOM = 1 << 16, 1 << 21, 32


def pair_filter(pairs: DataFrame):
    """A predicate on a word pair that holds for all of these pairs (one column) and for few others.

    A bit for each hash of a pair, at most FILTER of them whatever the number of
    pairs, so its 256 KB fit in the plan. Past FILTER / ROOM pairs it lets more
    others through; who asks checks exactly afterwards.
    """
    name = pairs.columns[0]
    size = 1 << min(FILTER, max(LEAST, ROOM * pairs.limit(FILTER).count())).bit_length() - 1
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int")
    held = bytearray(size // 8)
    bits = pairs.select(place(F.col(name)).alias("at")).groupBy(F.expr("at div 8").cast("int").alias("byte")).agg(F.expr("bit_or(shiftleft(1, at % 8))").alias("bits"))
    for byte, value in bits.toLocalIterator():  # at most size / 8 rows
        held[byte] = value

    def wanted(x):
        byte = F.conv(F.hex(F.substring(F.lit(bytes(held)), F.shiftright(place(x), 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, place(x).bitwiseAND(7)) == 1

    return wanted


def page_mentions(pages: DataFrame, people: DataFrame) -> DataFrame:
    """(page_id, request_id) of pages that name a person, without a domain to join on.

    Each spelling is looked up by its rarest pair of neighbouring words. A
    filter of all the spellings' pairs is applied inside a page's row, so only
    pairs that people have (and few others) are exploded and joined; the whole
    phrase is then checked.
    """
    pair = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.array_join(F.slice(ws, i, 2), " "))
    spelled = people.select("request_id", F.explode(T.name_variants(F.col("name"))).alias("variant"))
    keys = staged(spelled.withColumn("pair", F.explode(pair(F.split("variant", " ")))), "name_pairs")
    names = keys.select("pair").distinct()
    known = staged(candidate_pairs(pages, pair_filter(names), pair).join(names, "pair", "left_semi"), "page_pairs")
    often = known.groupBy("pair").agg(F.count("*").alias("n"))
    rarest = keys.join(often, "pair").groupBy("request_id", "variant").agg(F.min_by("pair", F.struct("n", "pair")).alias("pair"))
    met = known.join(rarest, "pair").select("page_id", "request_id", "variant")
    texts = pages.select(F.col("page_id").alias("_id"), "text")
    whole = met.join(texts, F.col("page_id") == F.col("_id"))
    return whole.where(F.contains(T.padded(F.col("text")), F.concat(F.lit(" "), "variant", F.lit(" ")))).select("page_id", "request_id").distinct()


def candidate_pairs(pages: DataFrame, wanted, pair) -> DataFrame:
    """(page_id, pair) of each page's distinct neighbouring words that the filter lets through."""
    rows = pages.withColumn("_w", T.words(F.col("text"))).where(F.size("_w") > 1)
    return rows.select("page_id", F.explode(F.array_distinct(F.filter(pair(F.col("_w")), wanted))).alias("pair"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
