"""Files in and out: CSV batches, official accounts, reports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.functions import urls as U
from vouch.session import staged

RECORD_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,119}$"
CONTACT_COLUMNS = ["contact_name", "contact_title", "contact_email", "email_source", "verification_tool", "verification_status", "phone", "linkedin_url"]
EXTRA = [
    "website", *CONTACT_COLUMNS, "research_notes", "source_urls", "confidence", "time_spent_min", "discovery_status", "discovery_warnings",
    "contact_candidates", "background",
]


def check_org_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a safe record_id that no other row has, and the rejected ones with the reason."""
    missing = {"record_id", "organization_name"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    safe = F.coalesce(F.col("record_id").rlike(RECORD_ID), F.lit(False))
    # Ids are counted before they are joined, and unsafe ones (blank ones, say) meet nobody.
    many = rows.where(safe).groupBy(F.col("record_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    told = rows.where(safe).join(many, F.col("record_id") == F.col("_id"), "left")
    why = F.when(F.col("_id").isNotNull(), "repeated record_id")
    told = told.withColumn("reason", why).drop("_id")
    unsafe = rows.where(~safe).withColumn("reason", F.lit("unsafe record_id"))
    return told.where("reason is null").drop("reason"), told.where("reason is not null").unionByName(unsafe)


def read_org_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV file with a header, all columns text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return check_org_rows(rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns}))


def select_range(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows with a numeric record_id in a range; without a range all rows."""
    if start is None:
        return rows
    return rows.where(F.col("record_id").rlike(r"^\d+$") & F.col("record_id").try_cast("decimal(38,0)").between(start, end))


def suppress(rows: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Rows that may be contacted: not marked, and not in a list (record_id)."""
    if "do_not_contact" in rows.columns:
        rows = rows.where(~F.lower(F.coalesce("do_not_contact", F.lit(""))).isin("true", "yes", "1"))
    return rows if listed is None else rows.join(listed.select("record_id").distinct(), "record_id", "left_anti")


def guarded(value: Column) -> Column:
    """A value that a spreadsheet won't take for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def enriched(rows: DataFrame, results: DataFrame, best: DataFrame, facts: DataFrame) -> DataFrame:
    """All original rows, with what was found for those that have a result.

    results: record_id, status, website, warnings, sources (arrays), n_contacts,
    minutes; best: record_id, name, title, email, source_url, background, phone,
    linkedin_url; facts: record_id, field, value.
    """
    known = [c for c in rows.columns if c in EXTRA]
    base = rows.withColumns({c: F.lit(None).cast("string") for c in EXTRA if c not in known})
    fields = rows.columns + [c for c in EXTRA if c not in known]
    wide = facts.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_facts"))
    found = results.select("record_id", F.struct("status", "website", "warnings", "sources", "n_contacts", "minutes").alias("_r"))
    first = best.select("record_id", F.struct("name", "title", "email", "source_url", "background", "phone", "linkedin_url").alias("_b"))
    joined = base.join(found, "record_id", "left").join(first, "record_id", "left").join(wide, "record_id", "left")
    b = F.col("_b")
    new = {
        "discovery_status": F.col("_r.status"), "discovery_warnings": F.array_join("_r.warnings", "; "), "website": F.coalesce("_r.website", F.lit("")),
        "contact_candidates": F.col("_r.n_contacts").cast("string"), "contact_name": b["name"], "contact_title": b["title"], "contact_email": b["email"],
        "email_source": b["source_url"], "phone": b["phone"], "linkedin_url": b["linkedin_url"], "verification_tool": F.lit(""),
        "verification_status": F.lit("NOT_CHECKED"), "source_urls": F.array_join("_r.sources", "; "), "time_spent_min": F.col("_r.minutes").cast("string"),
    }
    has = F.col("_r").isNotNull()
    out = []
    for c in fields:
        value = F.col(c)
        if c in new:
            value = F.when(has, F.coalesce(new[c], F.lit(""))).otherwise(value)
        elif c == "background":
            value = F.when(has & b.isNotNull(), b["background"]).otherwise(value)
        if c != "record_id":
            value = guarded(F.when(has, F.coalesce(F.try_element_at(F.col("_facts"), F.lit(c)), value)).otherwise(value))
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return joined.select(*out)


def write_enriched_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, escape='"', mode="errorifexists")


ACCOUNT = "domain string, platform string, handle string, account_url string, proof_url string, proof_note string"


def valid_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts whose proof is on the institution's own site and whose address has their platform and handle."""
    site = F.when(F.col("platform") == "linkedin", "linkedin.com").otherwise("facebook.com")
    account, proof = F.col("account_url"), F.col("proof_url")
    return accounts.where(
        F.col("platform").isin("linkedin", "facebook")
        & (U.scheme(proof) == "https") & U.within(U.host(proof), F.col("domain"))
        & (U.scheme(account) == "https") & (F.regexp_replace(U.host(account), r"^www\.", "") == site) & F.contains(U.path(account), F.col("handle"))
    )


def read_official_accounts(spark: SparkSession, path: str) -> DataFrame:
    return valid_accounts(spark.read.schema(ACCOUNT).json(path, multiLine=True))


def save_reports(reports: DataFrame, path: str) -> None:
    """Append reports (run_id, created_at, ...), by day."""
    reports.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def recent_reports(reports: DataFrame, n: int = 20) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), "run_id").limit(n)


def get_report(reports: DataFrame, run_id: str) -> DataFrame:
    return reports.where(F.col("run_id") == run_id)


def without_reports(reports: DataFrame, deleted: DataFrame) -> DataFrame:
    """Reports but for some (run_id), to be written anew."""
    return reports.join(deleted.select("run_id").distinct(), "run_id", "left_anti")


def day_folder(path: str, day) -> str:
    return f"{path.rstrip('/')}/day={day}"


def drop_days(spark: SparkSession, path: str, days: list) -> None:
    """Remove whole day folders of saved reports; a folder that is gone already is no error."""
    for day in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(day_folder(path, day))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rewrite_days(spark: SparkSession, path: str, days: list, kept: DataFrame) -> None:
    """Give days of saved reports the rows `kept` instead of theirs; no other day is read again or written.

    The rows are staged first, so that a run that fails before the end can be
    repeated and loses none.
    """
    rows = staged(kept, "reports-kept")
    left = [r.day for r in rows.select("day").distinct().collect()]  # days, of a bounded retention
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    drop_days(spark, path, [d for d in days if d not in left])


def delete_reports(spark: SparkSession, path: str, deleted: DataFrame) -> None:
    """Remove reports (run_id) from where save_reports has put them, in the days that hold some of them."""
    reports, ids = spark.read.parquet(path), deleted.select("run_id").distinct()
    days = [r.day for r in reports.join(ids, "run_id", "left_semi").select("day").distinct().collect()]
    if days:
        rewrite_days(spark, path, days, without_reports(reports.where(F.col("day").isin(days)), ids))


def purge_reports(spark: SparkSession, path: str, now, days: int = 30) -> None:
    """Remove reports that are older than some days at `now`: days before the last one by their folders, that one by its rows."""
    cutoff = now - datetime.timedelta(days=days)
    reports = spark.read.parquet(path)
    there = [r.day for r in reports.select("day").distinct().collect()]
    drop_days(spark, path, [d for d in there if d < cutoff.date()])
    if cutoff.date() in there:
        of_day = reports.where(F.col("day") == F.lit(cutoff.date()))
        rewrite_days(spark, path, [cutoff.date()], of_day.where(F.col("created_at") >= F.lit(cutoff)))
