"""Columns over URLs and hosts, by patterns on the raw string, so that no URL makes a job fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import constants as K
from vouch.functions.text import letters, literals, name_tokens, name_variants

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def netloc(url: Column) -> Column:
    return part(url, AUTHORITY)


def host(url: Column) -> Column:
    """The lower-cased host, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[^:]*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":([^:@]*)$", 1)


def path(url: Column) -> Column:
    return part(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")


def has_user(url: Column) -> Column:
    return F.contains(netloc(url), F.lit("@"))


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")


def within(name: Column, domain: Column) -> Column:
    """Whether a host is a domain or under it."""
    return (domain != "") & ((name == domain) | F.endswith(name, F.concat(F.lit("."), domain)))


def fetchable(url: Column) -> Column:
    return (scheme(url) == "https") & (host(url) != "") & ~has_user(url) & port(url).isin("", "443")


def canonical_url(url: Column) -> Column:
    """Scheme, lower-cased authority and path, without a slash at its end."""
    trimmed = F.regexp_replace(F.regexp_replace(path(url), r";[^/]*$", ""), r"/+$", "")
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), trimmed)


def is_company_url(url: Column, domain: Column) -> Column:
    return fetchable(url) & within(host(url), bare_domain(domain))


def host_suffixes(name: Column) -> Column:
    """A host and its parents: the equi-join form of `is under`."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def excluded_host(name: Column, listed: list[str] = K.BROKER_HOSTS) -> Column:
    return F.arrays_overlap(host_suffixes(name), literals(listed))


def without_hosts(rows: DataFrame, url: str, listed: DataFrame) -> DataFrame:
    """Rows whose host is not in or under a table of hosts (column host): an anti-join on host suffixes."""
    names = rows.select(host(F.col(url)).alias("_host")).distinct().withColumn("_suffix", F.explode(host_suffixes(F.col("_host"))))
    bad = names.join(listed.select(F.col("host").alias("_suffix")), "_suffix", "left_semi").select("_host").distinct()
    return rows.withColumn("_own", host(F.col(url))).join(bad, F.col("_own") == F.col("_host"), "left_anti").drop("_own")


def github_username(url: Column) -> Column:
    user = F.regexp_extract(path(url), r"^/*([A-Za-z0-9][A-Za-z0-9-]{0,38})/*$", 1)
    known = (scheme(url) == "https") & host(url).isin("github.com", "www.github.com") & (user != "")
    return F.when(known & ~F.lower(user).isin(K.RESERVED_PROFILES), user)


def crawl_candidate(url: Column, domain: Column) -> Column:
    return is_company_url(url, domain) & ~F.lower(path(url)).rlike(r"\.(?:pdf|jpg|png|gif|svg|zip|js|css|mp4)$") & (F.length(path(url)) < 250)


def held(tokens: Column, where: Column) -> Column:
    """How many of some words a string holds."""
    return F.size(F.filter(tokens, lambda w: F.contains(where, w)))


def slashes(where: Column) -> Column:
    return F.length(where) - F.length(F.replace(where, F.lit("/")))


def page_score(url: Column, name: Column) -> Column:
    low = F.lower(path(url))
    tokens = F.filter(letters(name), lambda w: F.length(w) > 2)
    return 15 * held(tokens, low) + 5 * held(literals(K.PATH_HINTS), low) - slashes(low)


def document_score(url: Column, name: Column) -> Column:
    """Null for what is no PDF."""
    low = F.lower(path(url))
    tokens = F.filter(letters(name), lambda w: F.length(w) > 2)
    return F.when(F.endswith(low, F.lit(".pdf")), 10 * held(tokens, low) + 3 * held(literals(K.DOCUMENT_HINTS), low) - slashes(low))


def profile_page_rank(url: Column, name: Column) -> Column:
    low = F.lower(F.substring_index(F.coalesce(url, F.lit("")), "?", 1))
    tokens = name_tokens(name)
    surnames = F.transform(name_variants(name), lambda v: F.substring_index(v, " ", -1))
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return (
        yes(F.contains(low, F.get(tokens, F.lit(0))), 4)
        + yes(F.contains(low, F.get(tokens, F.lit(1))), 3)
        + yes(F.exists(surnames, lambda s: F.contains(low, s)), 4)
        + yes(F.exists(literals(K.PROFILE_HINTS), lambda h: F.contains(low, h)), 3)
        + yes(F.endswith(low, F.lit(".pdf")), 1)
    )


def site_candidate(url: Column) -> Column:
    """The main site for a URL on a test or staging host, else the URL."""
    url = F.coalesce(url, F.lit(""))
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    labels = F.split(F.regexp_replace(host(whole), r"^www\.", ""), r"\.")
    front = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    testing = F.exists(front, lambda x: x.rlike(r"(?:^|-)(?:test|tst|dev|stage|staging|qa|uat|sandbox|preprod|demo)(?:-|[0-9]|$)"))
    return F.when(testing, F.concat(F.lit("https://"), F.array_join(F.slice(labels, -2, 2), "."))).otherwise(url)


def site_candidates(urls: Column) -> Column:
    return F.array_distinct(F.transform(urls, site_candidate))


def homepage_account(url: Column, domain: Column, proof: Column) -> Column:
    """The LinkedIn or Facebook account that a homepage links to, as a struct; else null."""
    parts = F.split(F.regexp_replace(path(url), r"^/+|/+$", ""), "/")
    linkedin = host(url).isin("linkedin.com", "www.linkedin.com") & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "company")
    facebook = host(url).isin("facebook.com", "www.facebook.com") & (F.size(parts) == 1)
    handle = F.when(linkedin, F.get(parts, F.lit(1))).when(facebook, F.get(parts, F.lit(0)))
    good = handle.rlike(r"^[\p{L}\p{N}_.-]+$") & ~F.lower(handle).isin(K.RESERVED_HANDLES) & fetchable(url)
    return F.when(
        good,
        F.struct(
            domain.alias("domain"), F.when(linkedin, "linkedin").otherwise("facebook").alias("platform"), handle.alias("handle"),
            url.alias("account_url"), proof.alias("proof_url"),
            F.lit("Account linked from the institution homepage.").alias("proof_note"),
        ),
    )


def personal_rank(url: Column, name: Column) -> Column:
    low = F.lower(F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url)))
    tokens = F.filter(letters(name), lambda w: F.length(w) >= 3)
    own = F.endswith(low, F.lit(".pdf")) | F.array_contains(F.split(low, "[^a-z]+"), "cv")
    return held(tokens, low) + F.when(own, 1).otherwise(0)


def contact_path_rank(url: Column) -> Column:
    return held(literals(K.CONTACT_HINTS), F.lower(path(url)))
