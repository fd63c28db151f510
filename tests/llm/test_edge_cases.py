"""Odd rows and empty tables: every operator gives its defined result."""

import hashlib
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import hnsw, jaccard_join, licenses, order_minhash, packing, piece_dropout, pseudo_likelihood, repair, secrets, toxicity
from tessera.llm.common import table_path

N = 11


def test_token_files(spark, odd_docs, no_docs):
    for docs, n in ((odd_docs, N), (no_docs, 0)):
        path = table_path(spark, "t")
        repair.write_token_files(docs, path)
        got = sorted(repair.read_token_files(spark, path).collect(), key=lambda r: r.start)
        assert len(got) == n and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(n)]
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert ids == sorted(ids) and all(r.n_tokens >= 1 for r in got)


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    assert sum(r.start == 0 for r in got) == N and sum(r.doc_tokens == 1 for r in got) == 4
    assert packing.pack(no_docs).count() == 0


def test_order_minhash(odd_docs, no_docs):
    got = order_minhash.fingerprints(odd_docs).collect()
    assert len(got) == N
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].fingerprint == by[3][0].fingerprint and by[1][0].fingerprint == by[1][1].fingerprint
    assert by[2][0].n_chars == 0 and by[2][0].edited_sha256 == hashlib.sha256(b"").hexdigest() and by[2][0].near_edited == 1.0
    assert order_minhash.fingerprints(no_docs).count() == 0


def test_jaccard(odd_docs, no_docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd_docs).collect())
    assert got == [(-1, 0, None), (-1, 1, None), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (8, 3, 1)]
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7]


def test_secrets(odd_docs, no_docs):
    got = secrets.secret_spans(odd_docs).collect()
    assert len(got) == N and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.mask_secrets(odd_docs).columns == odd_docs.columns and secrets.secret_spans(no_docs).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 1), (None, 1, 1), (8, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        got = toxicity.toxicity(odd_docs, known).collect()
        assert len(got) == N and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    insult = spark.createDataFrame([(1, "you stupid idiot")], "doc_id long, text string")
    assert toxicity.toxicity(insult, labels.where("false")).first().predicted == 1


def test_dropout_and_scores(odd_docs, no_docs):
    got = piece_dropout.round_trip(odd_docs).collect()
    assert len(got) == N and all(r.lossless for r in got) and piece_dropout.round_trip(no_docs).count() == 0
    got = pseudo_likelihood.pseudo_likelihood(odd_docs).collect()
    assert len(got) == N and all((r.n_tokens == 0) == (r.mean_log_prob is None) and r.log_prob <= 0 for r in got)
    assert pseudo_likelihood.pseudo_likelihood(no_docs).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    files = odd_docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    assert licenses.license_scan(files).count() == N and licenses.license_scan(files.where("false")).count() == 0
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code"), (3, "a/b/d.py", "def area(width, height): return width * height\nAll rights reserved.\nprint(area(3, 4)) # twelve square metres of carpet"), (4, "z/e.py", None), (5, None, "Licensed under CC BY-NC 4.0."), (6, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), (7, "a/b/c/d/e.py", "")]
    got = {r.id: (r.licence, r.licence_from, r.ancestor) for r in licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("mit", "header", None), 2: ("mit", "directory", "a"), 3: ("proprietary", "header", None), 4: (None, None, None), 5: ("cc-by-nc-4.0", "header", None), 6: ("apache-2.0", "header", None), 7: ("apache-2.0", "directory", "a/b/c")}


def test_whole_licence_files(spark):
    texts = {name: " ".join(text.split()) for name, text in licenses.TEMPLATES if len(text) > 300}
    assert {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "unlicense", "apache-2.0"} <= set(texts)
    rows = [(i, f"p{i}/notes", f"Some Project\n\nCopyright (c) 2020 Some Body\n\n{text.replace('. ', '.\n')}") for i, text in enumerate(texts.values())]
    rows += [(100, "p0/src/a.py", "x = 1"), (101, "q/readme", "Nothing is said here about any rights at all, only about walks by the sea."), (102, "q/b.py", None)]
    got = {r.id: r for r in licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert all(got[i].licence == name and got[i].whole_cosine >= licenses.WHOLE for i, name in enumerate(texts))
    assert got[100].licence == next(iter(texts)) and got[100].licence_from == "directory" and got[101].licence is None and got[102].licence is None


def test_hnsw(spark):
    v = [[1.0, 0.0], [0.5, 0.5], [1.0, 0.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0], [2.0, 0.0]]
    rows = [(20 * i, x) for i, x in enumerate(v)] + [(None, [1.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit("x"))
    got = {}
    for r in hnsw.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 180}
    assert got[0] == [(180, 2.0), (5, 1.0), (40, 1.0), (20, 0.5)] and got[180] == [(0, 2.0), (5, 2.0), (40, 2.0), (20, 1.0)]
    assert hnsw.nearest(df.where("false")).count() == 0


def test_hnsw_of_any_size(spark):
    """Large and tiny finite components, beside ordinary ones, and repeated ids: exact neighbours, each once."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 6))
    v[:5] *= 1e39
    v[5:10] *= 1e160
    v[10:60] *= 1e-50
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (100, v[100].tolist()), (101, v[101].tolist()), (7, v[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    distinct = sorted({(i, tuple(x)) for i, x in rows})
    ids, x = np.array([i for i, _ in distinct]), np.array([w for _, w in distinct])
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        with np.errstate(over="ignore", invalid="ignore"):
            score = (x * v[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        assert found == [(int(ids[j]), score[j]) for j in order], q


def test_hnsw_recall_at_the_largest_shard():
    """Vectors without any structure are the hard case."""
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(hnsw.SHARD_ROWS, 64)), rng.normal(size=(100, 64))
    shard = hnsw.Held(hnsw._dump(v=x, x=hnsw.augmented(x), ids=np.arange(len(x)), count=np.ones(len(x), dtype=np.int64), **{f"layer{i}": y for i, y in enumerate(hnsw.Graph.build(hnsw.augmented(x)).layers)}))
    got = shard.nearest(np.full(100, -1) - np.arange(100), q * 1e-50, 20, hnsw.EF_SEARCH).to_pandas()
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(got.vec_id[got.query_id == -1 - i]) & set(true[i].tolist())) / 20 for i in range(100)]) >= 0.9


def test_packing_of_a_million_empty_texts(tmp_path):
    """A group of pieces of one id is packed without waste, in bounded memory."""
    code = "import numpy as np, resource; from tessera.llm.packing import pack_sizes; w = pack_sizes(np.ones(1_000_000, dtype=np.int64)); assert len(w) == 245 and sorted(i for x in w for i in x) == list(range(1_000_000)); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1000


def test_pipeline(spark, odd_docs, tmp_path):
    clashing = odd_docs.withColumns({c: odd_docs.text for c in ("_th", "_id", "_row", "_key", "_passes", "_salt", "comp", "best", "stays", "count", "toxic_score_", "a b.c")})
    assert sorted(jaccard_join.keep_one(clashing).columns) == sorted(clashing.columns)
    for name, docs in (("a", clashing), ("b", clashing.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "a")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
