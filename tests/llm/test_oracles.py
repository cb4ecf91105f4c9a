"""Registered queries against their SQL, over whole tables."""

import os

import duckdb
import pytest

from masteria.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        at = f"{FOLDER}/{table}.parquet"
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}{'/*' if os.path.isdir(at) else ''}')")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(r) for r in frame.select(*columns).collect())
    result = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE[name]})")
    assert got == sorted(result.fetchall())
    assert got
