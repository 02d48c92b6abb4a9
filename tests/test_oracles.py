"""Each registered query with SQL gives DuckDB's rows; the others run; every class of the vocabularies occurs."""

import duckdb
import pandas as pd
import pytest

from jobloom.plans import registry
from tests.conftest import DATA

TABLES = "customer supplier part orders lineitem events documents pages conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str(tuple(cell(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_class_occurs(spark):
    from jobloom import schemas

    got = registry._enriched(spark, DATA).select("employment_type", "ir35_status", "rate_verdict", "language_tier", "clearance_status").toPandas()
    for c, values in (("employment_type", schemas.EMPLOYMENT), ("ir35_status", schemas.IR35), ("rate_verdict", schemas.RATE_VERDICT), ("language_tier", ("priority", "secondary", "none", "mismatch")), ("clearance_status", schemas.CLEARANCE)):
        assert set(got[c]) == set(values)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
