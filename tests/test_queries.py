"""Every query with an SQL twin gives the twin's rows; the others run."""

import pytest

import __spark_entry__ as entry

TWINS = {n: s for n, s in entry.oracle_sql().items() if n in entry.OWN}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    duck.execute(f"create or replace temp table twin as {TWINS[name]}")
    wanted = duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + " from twin").fetchall()
    assert sorted(c[0] for c in duck.execute("describe twin").fetchall()) == columns
    assert found and found == sorted(map(repr, wanted))


#: Held against a plain version in test_organizations.
HELD = {"organization_results", "organization_contacts"}


@pytest.mark.parametrize("name", sorted(set(entry.OWN) - set(TWINS) - HELD))
def test_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:2] == ["request_id", "status"] and rows.count() > 0
