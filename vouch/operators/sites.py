"""What is known of a site before its pages are read: sitemaps, robots rules, an index of URLs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import urls as U

AGENT = "vouch/0.1 (+public professional research)"


def sitemap_urls(xml: Column) -> Column:
    """The locations of a sitemap, whatever its namespace prefix."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<(?:\w+:)?loc\s*>\s*([^<]*?)\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    plain = F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.filter(plain, lambda u: u != "")


def sitemap_kind(xml: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(xml, F.lit("")), r"<(?:\w+:)?(urlset|sitemapindex)\b", 1), F.lit(""))


def robots_sitemaps(robots: Column, base: Column, most: int = 3) -> Column:
    """The sitemaps that robots.txt names, at most three, or else the usual one."""
    found = F.slice(F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(base, F.lit("/sitemap.xml"))))


def rules_of(text: str | None, agent: str) -> str:
    """The rules of a robots.txt that an agent keeps to, as a short robots.txt of their own."""
    whole = RobotFileParser()
    whole.parse((text or "").splitlines())
    group = next((g for g in whole.entries if g.applies_to(agent)), whole.default_entry)
    return "\n".join(["User-agent: *", *map(str, group.rulelines)]) if group else ""


def agent_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, status, rules): each host's file is read once, however many URLs the host has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, status, texts in (batch.columns for batch in batches):
            rules = [rules_of(t, agent) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([host, status, pa.array(rules, pa.string())], names=["_host", "_status", "_robots"])

    return robots.select("host", F.col("status").cast("int"), "robots_text").mapInArrow(each, "_host string, _status int, _robots string")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT, blocking: tuple[int, ...] = (401, 403, 429)) -> DataFrame:
    """urls (url) with the column allowed, by the robots rules (host, status, robots_text) of their hosts.

    The first rule that fits decides. A blocking status forbids the host, any
    other but 200 allows it; hosts without an answer are allowed. What is joined
    to URLs are the agent's own rules, not the whole files.
    """
    rules = agent_rules(robots, agent)
    rows = urls.withColumn("_own", U.host(F.col("url"))).join(rules, F.col("_own") == F.col("_host"), "left")
    names = [c for c in urls.columns if c != "allowed"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, RobotFileParser] = {}
        for batch in batches:
            *_, status, texts = batch.columns
            out = []
            for url, code, text in zip(batch.column(names.index("url")).to_pylist(), status.to_pylist(), texts.to_pylist(), strict=True):
                if code in blocking or code != 200:
                    out.append(code not in blocking)
                    continue
                if text not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[text] = RobotFileParser()
                    parsed[text].parse((text or "").splitlines())
                out.append(parsed[text].can_fetch(agent, url))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.bool_())], names=[*names, "allowed"])

    ddl = ", ".join(f"`{c}` {urls.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "_status", "_robots").mapInArrow(each, f"{ddl}, allowed boolean")


def build_site_index(urls: DataFrame, most_pages: int = 1500, most_documents: int = 300) -> DataFrame:
    """(domain, urls, documents) from the links and sitemap entries (domain, source, pos, url) of each domain.

    Fragments are cut, repeats keep their first place; the caps are applied
    before anything is gathered, so a portal's millions of links never meet in
    one row.
    """
    rows = urls.withColumn("url", F.substring_index("url", "#", 1)).where(U.is_company_url(F.col("url"), F.col("domain")))
    rows = rows.groupBy("domain", "url").agg(F.min(F.struct("source", "pos")).alias("at"))
    pdf = F.endswith(F.lower(U.path(F.col("url"))), F.lit(".pdf"))
    rows = rows.withColumns({"pdf": pdf, "page": U.crawl_candidate(F.col("url"), F.col("domain"))}).where("pdf or page")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("domain", "pdf").orderBy("at", "url")))
    rows = rows.where(F.col("n") <= F.when(F.col("pdf"), most_documents).otherwise(most_pages))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "url")))), lambda x: x["url"])
    return rows.groupBy("domain").agg(in_order(~F.col("pdf")).alias("urls"), in_order(F.col("pdf")).alias("documents"))


def ranked_pages(index: DataFrame, names: DataFrame, robots: DataFrame, most: int = 10) -> DataFrame:
    """The pages to read for each name on a domain: the homepage first, the best by the name in the URL, then robots rules.

    index: domain, base, urls; names: record_id, domain, name. A page that
    robots rules forbid has used its place.
    """
    rows = names.join(index, "domain").select("record_id", "domain", "name", "base", F.posexplode("urls").alias("pos", "url"))
    order = [F.desc(F.col("url") == F.col("base")), U.page_score(F.col("url"), F.col("name")).desc(), F.col("pos")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy(*order))).where(F.col("place") <= most)
    return robots_allowed(rows.select("record_id", "domain", "place", "url"), robots).where("allowed").drop("allowed")


def top_documents(documents: DataFrame, most: int = 3) -> DataFrame:
    """The best three documents with a score above zero of each record (record_id, name, pos, url)."""
    rows = documents.withColumn("score", U.document_score(F.col("url"), F.coalesce("name", F.lit("")))).where("score > 0")
    order = Window.partitionBy("record_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
