"""URL rules by hashed host-suffix and path-prefix expressions, all in DataFrame functions.

Every URL is expanded into expressions `suffix of its host` + `prefix of its
path`; an expression equi-joins the rules on the first 32 bits of its SHA-256,
the whole digest then confirms the match, and the longest rule wins (of two as
long, the one whose host is longer; of one rule given with both verdicts,
block).

Only prefix lengths and label counts that some rule has are expanded, so a URL
yields at most (distinct label counts of rule hosts) x (distinct lengths of rule
paths) rows, however long its host is. Distinct lengths and counts are the one
thing taken to the driver: a number for each, however many rules have it, and at
most as many as the longest rule has characters.

Only distinct (host, path) pairs are expanded, and their verdicts are joined
back to the rows, so a URL that repeats is looked up once. A common host only
repeats keys on the side of the pairs, which is salted when the rules are too
many to broadcast.

Null URLs and URLs without `://` have an empty host and path, fit no rule and
get the default verdict. Rows that repeat are judged each on its own; an empty
table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import fresh, table

#: Rules up to this many are broadcast (about 100 bytes each); beyond it both sides are shuffled and the URL side is salted.
BROADCAST_RULES = 50_000
SALTS = 16

#: The rules of the registered query as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The host's last so many labels, for each of the counts that it has enough labels for."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*[F.when(labels >= n, F.substring_index(host, ".", -n)) for n in counts]))


def key_of(digest: Column) -> Column:
    """The short hash prefix on which expressions are joined: 32 bits of the hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict.

    rules: verdict, host, path. Rows with a null in any of the three, with an
    empty host, or with another verdict are refused as rules and do nothing.
    """
    spark = urls.sparkSession
    rules = rules.select(
        F.lower("verdict").alias("r_verdict"), F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")
    ).where("r_host <> '' and r_path is not null and r_verdict in ('allow', 'block')")
    rules = (
        rules.groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block stands after allow
        .withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
        .withColumn("key", key_of(F.col("r_digest")))
    )
    labels = F.size(F.split("r_host", r"\."))
    found = rules.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"), F.sort_array(F.collect_set(labels)).alias("labels")
    ).first()

    taken = {"host", "path", "rule", "verdict"}
    base = urls.select(*[F.col(f"`{c}`") for c in urls.columns if c not in taken])
    base = base.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    if not found.n:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    lengths = F.array(*[F.lit(n) for n in found.lengths])
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    expressions = F.flatten(
        F.transform(
            host_suffixes(F.col("host"), found.labels),
            lambda h: F.transform(fitting, lambda n: F.struct(h.alias("h"), F.substring(F.col("path"), F.lit(1), n).alias("p"))),
        )
    )
    pairs = base.select("host", "path").where("host <> ''").distinct()
    keyed = pairs.select("host", "path", F.explode(expressions).alias("e"))
    keyed = keyed.select("host", "path", F.sha2(F.concat("e.h", F.lit("\n"), "e.p"), 256).alias("digest"))
    keyed = keyed.withColumn("key", key_of(F.col("digest")))
    if found.n <= BROADCAST_RULES:
        joined = keyed.join(F.broadcast(rules), (keyed.key == rules.key) & (F.col("digest") == F.col("r_digest")))
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        joined = keyed.join(
            salted, (keyed.key == salted.key) & (keyed.salt == salted.salt) & (F.col("digest") == F.col("r_digest"))
        )
    size = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = joined.groupBy("host", "path").agg(F.max(size).alias("best"))
    h, p, b = (fresh(name, base.columns) for name in ("b_host", "b_path", "best"))
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best").alias(b))
    judged = base.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    rows = [F.col(f"`{c}`") for c in base.columns]
    return judged.select(*rows, F.col(f"{b}.rule").alias("rule"), F.coalesce(F.col(f"{b}.verdict"), F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL = {
    "op8_url_filter": r"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits as (
  select page_id, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) rn
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select page_id, rule, verdict from fits where rn = 1) using (page_id)
"""
}
