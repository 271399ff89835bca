"""Every registered query against its SQL, over whole tables."""

import pytest
from conftest import FOLDER, canonical

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLES[key])
    expected_names, expected = canonical([c[0] for c in found.description], found.fetchall())
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
