"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

from spanloom.plans.oracles import ORACLES  # noqa: E402
from spanloom.plans.queries import REGISTRY  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "nation region customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def canonical(rows, columns, order):
    picked = [columns.index(c) for c in order]
    rounded = ([round(v, 9) + 0.0 if isinstance(v, float) else v for v in (row[i] for i in picked)] for row in rows)
    return sorted(map(tuple, rounded), key=repr)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_matches_sql(spark, sql, name):
    df = REGISTRY[name](spark, SF_DIR)
    order = sorted(df.columns)
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == order
    expected = canonical(cursor.fetchall(), columns, order)
    assert canonical(df.collect(), df.columns, order) == expected
    assert expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
