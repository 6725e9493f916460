import duckdb
import pytest

import __spark_entry__ as entry
from assayer.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df, columns):
    fixed = df[columns].map(lambda v: round(v, 6) if isinstance(v, float) else v).astype(str)
    return sorted(map(tuple, fixed.values.tolist()))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
