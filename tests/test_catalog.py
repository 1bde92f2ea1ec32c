"""Each registered query of the core library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents events labels pages benchmark conversations part".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(frame):
    columns = sorted(frame.columns)
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, sql, name):
    ours, theirs = table(catalog.QUERIES[name](spark, SF).toPandas()), table(sql.execute(catalog.ORACLE[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
