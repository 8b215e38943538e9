"""Every named query against its SQL on the smallest sample."""

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FLAT = {"bigint", "int", "string", "boolean", "double", "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck(sample):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sample}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sample, duck, name):
    result = registry.QUERIES[name](spark, sample)
    assert {kind for _, kind in result.dtypes} <= FLAT
    rows = result.toPandas()
    if name not in registry.ORACLES:
        assert len(rows) > 0
        return
    expected = duck.execute(registry.ORACLES[name])
    names = [column[0] for column in expected.description]
    assert sorted(rows.columns) == sorted(names)
    ours = sorted((tuple(map(_plain, row)) for row in rows[names].astype(object).itertuples(index=False)), key=repr)
    theirs = sorted((tuple(map(_plain, row)) for row in expected.fetchall()), key=repr)
    assert ours == theirs
