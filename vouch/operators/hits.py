"""Search hits: parsing of saved results, one hit a page, and what is chosen to be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import urls as U

#: Where result lists stand in the bodies of two search services.
BODY = "struct<web:struct<results:array<struct<title:string,url:string,description:string>>>,results:array<struct<title:string,url:string,content:string>>>"


def parse_hits(raw: DataFrame, most: int = 8) -> DataFrame:
    """Hits of JSON bodies (response_id, provider, query, body): the first `most`, then https only, then once a URL."""
    body = F.from_json("body", BODY)
    brave = F.transform(body["web"]["results"], lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["description"].alias("snippet")))
    searx = F.transform(body["results"], lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["content"].alias("snippet")))
    rows = raw.select("response_id", "provider", "query", F.posexplode(F.slice(F.when(F.col("provider") == "brave", brave).otherwise(searx), 1, most)).alias("rank", "h"))
    rows = rows.select(
        "response_id", "provider", "query", "rank", F.coalesce("h.title", F.lit("")).alias("title"),
        F.coalesce("h.url", F.lit("")).alias("url"), F.coalesce("h.snippet", F.lit("")).alias("snippet"),
    ).where((U.scheme(F.col("url")) == "https") & (U.host(F.col("url")) != ""))
    once = Window.partitionBy("response_id", "url").orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def parse_profiles(raw: DataFrame) -> DataFrame:
    """Public profiles of people from JSON bodies (url, body); other kinds of account are dropped."""
    fields = "type string, login string, name string, company string, bio string, email string, html_url string"
    rows = raw.select("url", F.from_json("body", fields).alias("p")).where("p.type = 'User'")
    return rows.select("url", "p.login", "p.name", "p.company", "p.bio", "p.email", "p.html_url")


def entity_websites(entities: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """Official websites (lookup_id, pos, url) of looked-up entities.

    entities: id, body (JSON with claims.P856); wanted: lookup_id, rank, id.
    """
    schema = "claims struct<P856:array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>"
    sites = entities.select("id", F.posexplode(F.from_json("body", schema)["claims"]["P856"]).alias("claim", "c"))
    rows = wanted.where(F.col("id").rlike(r"^Q\d+$")).join(sites, "id")
    order = Window.partitionBy("lookup_id").orderBy("rank", "claim")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most)
    return rows.select("lookup_id", "pos", F.coalesce(F.col("c.mainsnak.datavalue.value"), F.lit("")).alias("url"))


def first_hits(hits: DataFrame) -> DataFrame:
    """One hit for each page of a request: by source, then query, then rank (columns source_order, query_pos, rank)."""
    order = Window.partitionBy("request_id", "canonical").orderBy("source_order", "query_pos", "rank")
    rows = hits.withColumn("canonical", U.canonical_url(F.col("url")))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order that ends in a position, so that equal rows keep theirs."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def chosen_pages(hits: DataFrame, most: int = 4) -> DataFrame:
    """The company pages of each request to read, best first by the person's name in the URL."""
    own = hits.where(U.is_company_url(F.col("url"), F.col("company_domain")))
    rank = U.profile_page_rank(F.col("url"), F.col("name"))
    return top(own, ["request_id"], [rank.desc(), F.col("source_order"), F.col("query_pos"), F.col("rank"), F.col("url")], most)


def first_listing_hits(hits: DataFrame, most: int = 6) -> DataFrame:
    """The listing hits of each organization (record_id, hit, ...) that are read, in the order of `hit`."""
    return top(hits, ["record_id"], [F.col("hit"), F.col("source_url")], most)


def chosen_profiles(hits: DataFrame, most: int = 2) -> DataFrame:
    own = hits.where(U.github_username(F.col("url")).isNotNull())
    return top(own, ["request_id"], [F.col("source_order"), F.col("query_pos"), F.col("rank"), F.col("url")], most)


def named_search_pages(hits: DataFrame) -> DataFrame:
    """Up to four pages of the site, personal ones first, and three elsewhere."""
    rows = hits.withColumns(
        {"on_site": U.is_company_url(F.col("url"), F.col("company_domain")), "personal": U.personal_rank(F.col("url"), F.col("contact_name"))}
    )
    order = Window.partitionBy("record_id", "on_site").orderBy(F.when(F.col("on_site"), -F.col("personal")).otherwise(0), "pos")
    rows = rows.withColumn("n", F.row_number().over(order))
    return rows.where(F.col("n") <= F.when(F.col("on_site"), 4).otherwise(3)).drop("personal", "n")


def company_search_pages(hits: DataFrame, each: int = 4, most: int = 8) -> DataFrame:
    """Eight pages: four of the site, four elsewhere, then the others, contact pages first in each."""
    rows = hits.withColumns({"on_site": U.is_company_url(F.col("url"), F.col("company_domain")), "hint": U.contact_path_rank(F.col("url"))})
    pool = Window.partitionBy("record_id", "on_site").orderBy(F.desc("hint"), "pos")
    rows = rows.withColumn("n", F.row_number().over(pool))
    overall = Window.partitionBy("record_id").orderBy(F.when(F.col("n") <= each, 0).otherwise(1), F.desc("on_site"), "n")
    return rows.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= most).drop("hint", "n")


def provider_fallback(results: DataFrame) -> DataFrame:
    """The hits of the first provider with any, for each request, or why there are none.

    results: request_id, provider_order, failed, n_hits. Returns request_id,
    provider_order (of the provider taken) and outcome: found, nothing or
    unavailable (every provider failed).
    """
    some = F.min(F.when(~F.col("failed") & (F.col("n_hits") > 0), F.col("provider_order")))
    rows = results.groupBy("request_id").agg(some.alias("provider_order"), F.bool_and("failed").alias("all_failed"))
    outcome = F.when(F.col("provider_order").isNotNull(), "found").when(F.col("all_failed"), "unavailable").otherwise("nothing")
    return rows.select("request_id", "provider_order", outcome.alias("outcome"))


def cached(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (provider, base, query) with the payload cached for them, if it hasn't expired."""
    key = F.sha2(F.concat_ws(":", "provider", "base", "query"), 256)
    live = cache.where(F.col("expires_at") > now).select(F.col("cache_key").alias("_key"), "payload")
    return requests.withColumn("cache_key", key).join(live, F.col("cache_key") == F.col("_key"), "left").drop("_key")
