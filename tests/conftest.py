from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    from farelens.session import build_session

    session = build_session(
        "tests",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield con
    con.close()


def canonical(columns, rows):
    """Rows with columns by name, numbers as floats, in a fixed order."""
    places = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ("null",)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return ("number", float(v) + 0.0)
        return ("text", str(v))

    out = [tuple(cell(r[i]) for i in places) for r in rows]
    return [columns[i] for i in places], sorted(out, key=repr)
