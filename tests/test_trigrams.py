"""The trigram index against a look at every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search as S
from tessera.operators import trigrams as G


def test_code_sets_are_those_of_plain_text(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "ab c", "É-x", "Ünï 12.5", "a" * 50] + ["".join(rng.choices("abz019 -\né世", k=rng.randint(1, 80))) for _ in range(500)]
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(G, "PIECE", piece)
        for t in texts:
            assert [G.name(x) for x in G.code_set(np.frombuffer(t.lower().encode(), dtype=np.uint8)).tolist()] == sorted(T.trigram_set(t))


def test_classes_cover_all_sizes():
    sizes = np.arange(1, G.ALL + 1)
    at, ends = G.classes(sizes), np.append(G.FLOOR, G.ALL + 1)
    assert (ends[at] <= sizes).all() and (sizes < ends[at + 1]).all()


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of every size, near the queries and far from them, with ties, repeated rows, nulls, and documents below 0."""
    rng = random.Random(5)
    words = ["configure", "security", "kafka", "stream", "reactive", "rest", "json", "a", "über", "42", "openid"]
    rows = [(i * 3 - 900, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 40])))) for i in range(700)]
    rows += [(5000 + i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 400)))) for i in range(300)]
    rows += [(9000, "Security"), (9000, "security json"), (9000, "Security"), (9001, None), (9002, ""), (9003, "--"), (None, "security"), (2**62, "kafka"), (-(2**62), "kafka streams")]
    return spark.createDataFrame(rows, "chunk_id long, content string").withColumn("score", F.lit("clash")).repartition(3).cache()


@pytest.mark.parametrize("shards", [1, 6])
def test_index_gives_what_a_look_at_every_text_gives(corpus, shards):
    index = G.build_trigrams(corpus, shards=shards).cache()
    for query in ["secruity", "configure open id json", "a", "--", "abcdefgh abc"]:
        for threshold in (0.0, 0.1, 0.5):
            want = sorted((r.chunk_id, r.score) for r in S.fuzzy(corpus.where("chunk_id is not null"), query, threshold=threshold).select("chunk_id", "score").collect()) if threshold else None
            got = sorted((r.chunk_id, r.score) for r in G.similar(index, query, threshold).collect())
            if want is None:
                asked = T.trigram_set(query)
                want = sorted((r.chunk_id, len(x & asked) / len(x | asked)) for r in corpus.where("chunk_id is not null and content is not null").collect() if (x := T.trigram_set(r.content)) & asked)
            assert got == want, (query, threshold)
    index.unpersist()


def test_lists_that_cannot_matter_stay_closed():
    """Of a class's lists the longest stay closed where no row can reach its number any more."""
    rng = np.random.default_rng(3)
    n, asked = 5000, 12
    common = [np.arange(n)] * 6
    rare = [np.sort(rng.choice(n, size=5, replace=False)) for _ in range(asked - 6)]
    lists = [(len(x), G.packed(np.diff(x, prepend=0))) for x in common + rare]
    sizes = np.full(n, 12)
    at, scores, opened = G.class_hits(lists, sizes, asked, 0.7, 12)
    held = np.zeros(n, dtype=int)
    for x in common + rare:
        held[x] += 1
    want = held / (asked + sizes - held)
    assert at.tolist() == np.flatnonzero(want > 0.7).tolist() and scores.tolist() == want[want > 0.7].tolist() and opened < len(lists)


def test_only_asked_lists_and_sizes_are_read(spark, corpus, tmp_path):
    G.build_trigrams(corpus, shards=2).repartitionByRange("trigram", "shard", "class").sortWithinPartitions("trigram", "shard", "class").write.parquet(f"file://{tmp_path}/index")
    hits = G.similar(spark.read.parquet(f"file://{tmp_path}/index"), "security")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram" in plan and "GreaterThanOrEqual(class" in plan
    with pytest.raises(ValueError):
        G.similar(spark.read.parquet(f"file://{tmp_path}/index"), "security", -0.1)


def test_search_falls_back_to_the_index(spark, corpus):
    chunks = corpus.drop("score").where("chunk_id is not null and chunk_id <> 9000").withColumn("extensions", F.array(F.lit("core")))
    posts = S.RULE.posts(chunks, ["chunk_id"])
    page, total = S.search(chunks, posts, "secruity jsno", trigrams=G.build_trigrams(chunks))
    plain, plain_total = S.search(chunks, posts, "secruity jsno")
    key = ["chunk_id", "score"]
    assert total == plain_total and sorted(map(tuple, page.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))


def test_empty_table(corpus):
    assert G.similar(G.build_trigrams(corpus.where("false")), "security").count() == 0
