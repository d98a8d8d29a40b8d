"""Queries against their SQL, and the streaming and file forms."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scribeflow.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=str)
    cur = db.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert len(cur.description) == len(cols)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_overlap_merge_takes_all_lengths(spark):
    got = {r.doc_id for r in QUERIES["overlap_merge"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got == {r.doc_id for r in docs.where("length(text) > 0").select("doc_id").collect()}
