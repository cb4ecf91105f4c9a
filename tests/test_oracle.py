"""Every registered query against its SQL, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


# The operators on texts have tests of their own.
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.TEXT_QUERIES)))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    kinds = dict(frame.dtypes)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=_key)
    assert len(set(frame.columns)) == len(frame.columns)
    assert got
    if name not in entry.oracle_sql():
        assert name == "skill_pca_map"
        return
    result = duck.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in result.description}
    assert sorted(described) == columns
    rows = result.fetchall()
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rows), key=_key)
    assert {c: KINDS[kinds[c]] for c in columns} == described
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w or all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
                             for a, b in zip(g, w)), (g, w)
