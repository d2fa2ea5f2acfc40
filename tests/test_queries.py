"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from bitweave.plans.oracles import ORACLES
from bitweave.plans.queries import QUERIES


@pytest.fixture(scope="module")
def database(sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    return c


def test_each_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted(map(tuple, frame.select(columns).collect()), key=repr)
    result = database.execute(ORACLES[name])
    places = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(places) == columns
    assert mine == sorted((tuple(r[places[c]] for c in columns) for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
