"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, norm

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def oracle(root):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, root, oracle, name):
    frame = QUERIES[name](spark, root)
    columns = sorted(frame.columns)
    cursor = oracle.execute(ORACLES[name])
    names = [item[0] for item in cursor.description]
    assert columns == sorted(names)
    order = [names.index(column) for column in columns]
    theirs = Counter(tuple(norm(row[i]) for i in order) for row in cursor.fetchall())
    ours = Counter(tuple(norm(row[column]) for column in columns) for row in frame.collect())
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
