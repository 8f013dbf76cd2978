"""Every registered query of the log engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallylog import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def values(rows):
    return sorted(str([None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    assert values(map(tuple, rows)) == values(db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5 and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["roundtrip_json", "roundtrip_pairs", "roundtrip_plain"])
def test_texts_are_read_by_more_tasks_than_the_file_has_row_groups(spark, name):
    plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan
