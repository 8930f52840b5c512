"""Every catalogue query against its SQL on DuckDB over the smallest tables."""

import math
import os

import pytest

from jointspark.plans.catalogue import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert len(rows) == len(want) > 0
    for a, b in zip(rows, want, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_kmers_of_whole_documents(spark):
    import collections

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("lang", "text").collect()
    want = collections.Counter((r["lang"], r["text"][k : k + 5]) for r in docs for k in range(len(r["text"] or "") - 4))
    got = {(r["lang"], r["kmer"]): r["n"] for r in QUERIES["q46_kmer_count_documents"](spark, DIR).collect()}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_every_region_is_joined_with_every_region(spark, duck):
    keys = {k for (k,) in duck.execute("SELECT o_orderkey FROM orders").fetchall()}
    found = QUERIES["q09_reciprocal_overlap_all"](spark, DIR).collect()
    assert {r["key"] for r in found} == keys and all(r["least_partner"] <= r["key"] for r in found)
