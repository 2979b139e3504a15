"""Requests, hits and pages derived from the driver's tables, once in Spark and once in SQL.

The given tables hold raw pages, texts and events but no requests; these views
make some of each: a page's title gives a person and a company, its host a
domain. Everything is derived row by row or by equi-joins, so it grows with the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import constants as K
from vouch.functions import urls as U
from vouch.session import ship, small_batches

MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """page_id, url (https), host, domain, title, text, name, company, email, html; with `only`, of its page_ids alone."""
    rows = table(spark, sf_dir, "pages")
    if only is not None:  # ahead of all that is made of the markup
        rows = rows.join(only.select("page_id"), "page_id", "left_semi")
    rows = rows.withColumn("url", F.regexp_replace("url", "^http://", "https://"))
    rows = rows.withColumns(
        {
            "host": U.host(F.col("url")),
            "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1),
            "text": F.trim(F.regexp_replace(F.regexp_replace("html", MARKUP, " "), r"[ \t\n\f\r]+", " ")),
        }
    ).withColumn("domain", F.regexp_replace("host", r"^(www|m|blog)\.", ""))
    rows = rows.withColumn("w", F.regexp_extract_all("title", F.lit(r"\p{L}+"), F.lit(0))).where(F.size("w") >= 4)
    return rows.select(
        "page_id", "url", "host", "domain", "title", "text",
        F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("name"),
        F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("company"),
        F.concat(F.lower(F.get("w", F.lit(0))), F.lit("@"), "domain").alias("email"), "html",
    )


PAGES_SQL = r"""cut as (
  select page_id, regexp_replace(url, '^http://', 'https://') as url, html,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
    trim(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')) as text
  from pages),
worded as (select *, regexp_replace(host, '^(www|m|blog)\.', '') as domain, regexp_extract_all(title, '\p{L}+') as w from cut),
v_pages as (
  select page_id, url, host, domain, title, text, w[1] || ' ' || w[2] as name, w[3] || ' ' || w[4] as company,
    lower(w[1]) || '@' || domain as email, html, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as path
  from worded where len(w) >= 4)"""


def people(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One person request a domain, from its page with the smallest id; rows: pages() where it has been made."""
    rows = pages(spark, sf_dir) if rows is None else rows
    first = rows.groupBy("domain").agg(F.min("page_id").alias("page_id"))
    return rows.join(first, ["domain", "page_id"]).select(
        F.col("page_id").alias("request_id"), "name", "company", F.col("domain").alias("company_domain"), F.col("email").alias("work_email")
    )


PEOPLE_SQL = """v_people as (
  select page_id as request_id, name, company, domain as company_domain, email as work_email from v_pages
  qualify row_number() over (partition by domain order by page_id) = 1)"""


# Pieces of the SQL twins.
def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_fold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def sql_norm(x: str) -> str:
    return rf"array_to_string(regexp_extract_all({sql_fold(x)}, '[\p{{L}}\p{{N}}_]+'), ' ')"


def sql_phrase(text: str, phrase: str) -> str:
    return f"({sql_norm(phrase)} <> '' and contains(' ' || {sql_norm(text)} || ' ', ' ' || {sql_norm(phrase)} || ' '))"


def sql_letters(x: str, least: int) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+'), lambda t: length(t) >= {least})"


def sql_held(tokens: str, where: str) -> str:
    return f"len(list_filter({tokens}, lambda t: contains({where}, t)))"


def sql_variants(name: str) -> str:
    """The spellings of a name; the surnames with another one are in SURNAME_VARIANTS."""
    tokens = rf"list_filter(regexp_extract_all({sql_fold(name)}, '[\p{{L}}\p{{N}}_]+'), lambda t: t not in ({', '.join(repr(h) for h in K.HONORIFICS)}))"
    pairs = " ".join(f"when '{a}' then '{b}'" for a, b in K.SURNAME_VARIANTS.items())
    return f"""(case when len({tokens}) < 2 then [] else list_filter([array_to_string({tokens}, ' '),
      array_to_string({tokens}[:-2], ' ') || ' ' || (case {tokens}[-1] {pairs} end)], lambda v: v is not null) end)"""


def sql_person(text: str, name: str) -> str:
    return f"(len(list_filter({sql_variants(name)}, lambda v: contains(' ' || {sql_norm(text)} || ' ', ' ' || v || ' '))) > 0)"
