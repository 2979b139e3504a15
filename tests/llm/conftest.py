import pytest


@pytest.fixture(scope="session")
def twin(spark, duck, sf):
    """Assert that a registered query gives the rows of its SQL twin."""

    def check(module, name):
        df = module.QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        duck.execute(f"create or replace temp table twin_llm as {module.ORACLE_SQL[name]}")
        wanted = duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + " from twin_llm").fetchall()
        assert found and found == sorted(map(repr, wanted))

    return check
