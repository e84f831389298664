"""Every query of the document operators against SQL, at the scale of the correctness gate."""

import math

import duckdb
import pytest

from quirion.plans import catalogue

SF = "/root/testdata/sf0.01"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    got, expected = canonical(frame.columns, frame.collect()), canonical(want.columns, want.fetchall())
    assert len(got) == len(expected)
    different = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not different, different[:3]
    assert got


def test_queries_without_sql_give_rows(spark):
    for name in set(catalogue.queries()) - set(ORACLES):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
