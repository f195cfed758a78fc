"""Every query of the engine's own against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest
from quadrille.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def value(x):
    return ("nan" if math.isnan(x) else round(x, 9) + 0.0) if isinstance(x, float) else x


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = compared(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert got[1]
        return
    found = db.execute(catalogue.ORACLE_SQL[name])
    want = compared([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got == want


def test_most_queries_give_rows(spark, db):
    empty = [n for n, text in catalogue.ORACLE_SQL.items() if not db.execute(text).fetchall()]
    assert empty == []
