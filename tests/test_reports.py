"""The whole person job on invented requests, and the stream form of resuming."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from vouch.operators import identity as I
from vouch.plans import evidence as E
from vouch.streaming import incremental as R

PAGE = "page_id long, url string, domain string, title string, text string, name string"
TEXT = "Anna Berg runs the wells of North Plain. "


@pytest.fixture(scope="module")
def made(spark):
    asked = spark.createDataFrame(
        [
            (1, "Anna Berg", "North Plain", "np.example", "", "https://np.example/team/"),
            (2, "Carl Dorn", "South Plain", "sp.example", "", "https://other.example/x"),
            (3, "Eva Falk", "West Plain", "wp.example", "", "https://wp.example/empty"),
            (4, "Gus Holm", "East Plain", "ep.example", "", "https://ep.example/gone"),
            (5, "Ida Jung", "Mid Plain", "mp.example", "", None),
        ],
        "request_id long, name string, company string, company_domain string, work_email string, source_url string",
    )
    pages = spark.createDataFrame(
        [
            (11, "https://np.example/team", "np.example", "Team", "lorem " * 100 + TEXT, "Team X"),
            (13, "https://wp.example/empty", "wp.example", "Nothing", "nobody is named", "Nothing X"),
        ],
        PAGE,
    )
    found = spark.createDataFrame(
        [
            (1, "g1", "https://github.com/aberg", "Anna Berg", "code", 0, 1),
            (2, "s1", "https://www.linkedin.com/posts/sp_carl-dorn-1", "Carl Dorn", "Carl Dorn joins South Plain", 0, 1),
            (5, "s2", "https://www.linkedin.com/posts/unlisted_ida-jung-1", "Ida Jung", "Ida Jung joins Mid Plain", 0, 1),
        ],
        "request_id long, hit_id string, url string, title string, text string, query_pos int, rank long",
    )
    accounts = spark.createDataFrame(
        [("sp.example", "linkedin", "sp", "https://sp.example/about", 0)], "domain string, platform string, handle string, proof_url string, list_order int"
    )
    profiles = spark.createDataFrame(
        [("https://github.com/aberg", "Anna Berg", "North Plain", None, None)], "url string, name string, company string, bio string, email string"
    )
    rows = E.person_reports(asked, pages, found, accounts, profiles)
    return {r.request_id: r for r in rows.collect()}


def test_statuses(made):
    # A site page and a profile elsewhere; a post of a listed account; a post of none.
    assert {k: r.status for k, r in made.items()} == {1: "corroborated", 2: "supported", 3: "unresolved", 4: "unresolved", 5: "possible"}
    assert {e.category for e in made[1].evidence} == {"company_page", "github_public_profile"}
    assert made[2].evidence[0].category == "official_social_post_indexed"


def test_supplied_page_is_the_hit(made):
    # Site and supplied page are one page; the supplied one comes first and is read.
    assert [e.title for e in made[1].evidence if e.category == "company_page"] == ["Supplied page: https://np.example/team/"]


def test_warnings(made):
    first = {k: r.warnings[:1] for k, r in made.items()}
    assert first[2] == [I.OUTSIDE] and first[3] == [I.NOT_NAMED] and first[4] == [I.UNREAD] and first[1] == first[5] == []


def test_query(spark, sf):
    rows = entry.queries()["person_reports"](spark, sf).collect()
    assert len(rows) == len({r.request_id for r in rows}) == entry.queries()["person_status"](spark, sf).count()
    assert {"corroborated"} <= {r.status for r in rows} and any(I.OUTSIDE in r.warnings for r in rows)


def test_resume_stream(spark, tmp_path):
    source, folder, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.createDataFrame([("1",), ("2",)], "record_id string").coalesce(1).write.parquet(source)

    def work(rows):
        seen.append(sorted(r.record_id for r in rows.collect()))
        return rows.withColumn("n", F.length("record_id"))

    def run(mark):
        stream = spark.readStream.schema("record_id string").parquet(source)
        R.resume_stream(stream, folder, work).option("checkpointLocation", str(tmp_path / mark)).trigger(availableNow=True).start().awaitTermination(120)

    run("a")
    spark.createDataFrame([("2",), ("3",)], "record_id string").coalesce(1).write.mode("append").parquet(source)
    run("a")
    run("b")  # All again without a checkpoint: every record has its result.
    assert seen == [["1", "2"], ["3"]]
    assert sorted(r.record_id for r in spark.read.parquet(f"{folder}/results").collect()) == ["1", "2", "3"]


def test_deleting_and_purging_touch_their_days_only(spark, tmp_path):
    import datetime as dt
    import os

    from vouch.sources import tables as IO

    path = str(tmp_path / "reports")
    day = lambda n, hour=12: dt.datetime(2024, 3, n, hour)
    rows = [(f"r{n}{k}", day(n, 2 * k + 1)) for n in range(1, 6) for k in range(3)]
    IO.save_reports(spark.createDataFrame(rows, "run_id string, created_at timestamp"), path)
    files = lambda: {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    ids = lambda: sorted(r.run_id for r in spark.read.parquet(path).collect())
    before = files()
    IO.delete_reports(spark, path, spark.createDataFrame([("r21",), ("r40",), ("r41",), ("r42",), ("none",), ("r21",)], "run_id string"))
    assert ids() == sorted(r for r, _ in rows if r not in ("r21", "r40", "r41", "r42"))
    after = files()
    assert "day=2024-03-04" not in after and all(after[f"day=2024-03-0{n}"] == before[f"day=2024-03-0{n}"] for n in (1, 3, 5))
    IO.purge_reports(spark, path, day(3, 4) + dt.timedelta(days=30))
    assert ids() == ["r32", "r50", "r51", "r52"] and files()["day=2024-03-05"] == before["day=2024-03-05"]
    IO.delete_reports(spark, path, spark.createDataFrame([("none",)], "run_id string"))
    assert ids() == ["r32", "r50", "r51", "r52"]


def test_accounts_are_read_from_a_file(spark, tmp_path):
    import json

    from vouch.sources import tables as IO

    good = {"domain": "birch.edu", "platform": "linkedin", "handle": "birch", "account_url": "https://www.linkedin.com/school/birch/", "proof_url": "https://www.birch.edu/about", "proof_note": "footer"}
    rows = [good, good | {"platform": "other"}, good | {"proof_url": "https://elsewhere.example/x"}, good | {"handle": "oak"}, good | {"proof_url": "http://birch.edu/"}]
    (tmp_path / "accounts.json").write_text(json.dumps(rows, indent=1))
    assert [r.asDict() for r in IO.read_official_accounts(spark, str(tmp_path / "accounts.json")).collect()] == [good]
