"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from keyloom import catalog

NAMES = sorted(catalog.oracle_sql())


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, data, name):
    found = catalog.queries()[name](spark, data)
    wanted = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, wanted.fetchall())


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(catalog.queries()) - set(NAMES)):
        assert catalog.queries()[name](spark, data).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
