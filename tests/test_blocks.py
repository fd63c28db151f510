"""Compressed postings, top-k search over them and joins of many queries, against the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import index as I
from tessera.operators import search as S


def test_bytes_round_trip():
    rng = np.random.default_rng(0)
    for v in ([], [0], [127, 128, 16383, 16384, 2**62], rng.integers(0, 2 ** rng.integers(1, 62, size=5000))):
        v = np.array(v, dtype=np.int64)
        assert (B.unpacked(B.packed(v)) == v).all() and len(B.unpacked(B.packed(v))) == len(v)
    assert len(B.packed(np.full(1000, 100))) == 1000


@pytest.fixture(scope="module")
def corpus(spark):
    """A frequent word, one that few documents hold often, words side by side and far apart, ties and equal texts."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "filler", "other"], [6, 2, 1, 0.2, 20, 20], k=rng.randint(1, 60))
        rows.append((i * 7 - 5000, " ".join(words)))
    rows += [(100_000 + i, "alpha beta " * (i % 40)) for i in range(60)] + [(200_000 + i, "alpha beta") for i in range(300)]
    return spark.createDataFrame(rows, "chunk_id long, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def posts(corpus):
    return I.postings(corpus, ["chunk_id"]).cache()


@pytest.fixture(scope="module", params=[(1, 128), (5, 16)])
def blocks(posts, request):
    return B.build_blocks(posts, shards=request.param[0], block=request.param[1]).cache()


def test_blocks_hold_the_postings(posts, blocks):
    key = ["chunk_id", "lexeme", "tf", "positions"]
    assert sorted(map(tuple, B.postings_of(blocks).select(key).collect())) == sorted(map(tuple, posts.select(key).collect()))
    size = blocks.agg(F.sum(F.length("docs") + F.length("counts") + F.length("positions"))).first()[0]
    plain = posts.agg(F.sum(8 + 4 + 4 * F.size("positions"))).first()[0]
    assert size < 0.35 * plain


@pytest.mark.parametrize("query", ["alpha", "delta", "alpha beta", "alpha delta", "beta gamma delta", "alpha beta gamma delta", "alpha nowhere", ""])
@pytest.mark.parametrize("k", [1, 20, 5000])
def test_top_hits_are_those_of_full_ranking(posts, blocks, query, k):
    lexemes = S.RULE.query(query)
    want = [(r.chunk_id, r.s) for r in S.ranked(posts, lexemes, ["chunk_id"]).select("chunk_id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "chunk_id").limit(k).collect()] if lexemes else []
    got = [(r.chunk_id, r.score) for r in B.top_hits(blocks, lexemes, k, decimals=9).collect()]
    assert [d for d, _ in got] == [d for d, _ in want] and all(abs(a - b) < 2e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def test_blocks_that_cannot_reach_the_top_stay_closed(blocks):
    """Of a word's blocks only those are opened that may hold one of the best."""
    rows = {}
    for r in blocks.where(F.col("lexeme").isin("alpha", "beta")).collect():
        rows.setdefault(r.shard, {}).setdefault(r.lexeme, []).append((r.first, r.last, r.n, r.most, bytes(r.docs), bytes(r.counts), bytes(r.positions)))
    total, opened, placed = 0, 0, 0
    for held in rows.values():
        _, read = B.shard_top([B.Postings.of(x) for x in held.values()], 5)
        total, opened, placed = total + read.blocks, opened + read.opened, placed + read.placed
    assert opened < 0.5 * total and placed <= opened


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        lists = [np.sort(rng.choice(40, size=rng.integers(1, 12), replace=False)) for _ in range(rng.integers(1, 5))]
        n = np.array([[len(x)] for x in lists])
        assert B.score(lists) <= B.bound(n)[0] + 1e-12
        assert B.bound(n)[0] <= B.bound(n + rng.integers(0, 5, size=n.shape))[0] + 1e-12


def test_many_queries_meet_the_blocks(spark, posts, blocks):
    rows = [(i, q.split()) for i, q in enumerate(["alpha beta", "delta", "beta gamma delta", "nowhere alpha", "alpha alpha", ""])] + [(None, ["gamma", "delta"]), (1, ["gamma"])]
    queries = spark.createDataFrame(rows, "item long, lexemes array<string>").withColumn("note", F.lit("x"))
    held = {}
    for r in posts.collect():
        held.setdefault(r.lexeme, set()).add(r.chunk_id)
    want = sorted((str(i), "x", d) for i, q in rows if q for d in set.intersection(*[held.get(w, set()) for w in q]))
    assert sorted((str(r.item), r.note, r.chunk_id) for r in B.many_hits(queries, blocks, ["item", "note"]).collect()) == want
    assert B.many_hits(queries.where("false"), blocks, ["item"]).count() == 0
    plan = B.many_hits(queries, blocks, ["item"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "positions array" not in plan


def test_empty_tables(spark, posts):
    none = B.build_blocks(posts.where("false"))
    assert none.count() == 0 and B.top_hits(none, ["alpha"], 5).count() == 0 and B.postings_of(none).count() == 0
