"""Every query with SQL gives what DuckDB gives on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.functions.porter2 import STOP, porter2
from tessera.queries import ORACLES, QUERIES
from test_parser import plain_tokens


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df, rel = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_porter2_terms_by_a_plain_loop(spark, sf):
    """The one query that SQL can't express."""
    assert set(QUERIES) - set(ORACLES) == {"porter2_terms"}
    counts, chunks = Counter(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("text").collect():
        words = [porter2(t) if kind in ("word", "compound", "part") and not any(c.isnumeric() for c in t) else t for kind, t in plain_tokens(r.text) if t not in STOP]
        counts.update(words)
        chunks.update(set(words))
    assert {r.lexeme: (r.cf, r.df) for r in QUERIES["porter2_terms"](spark, sf).collect()} == {w: (counts[w], chunks[w]) for w in counts}
