import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import related as R
from tessera.operators import search as S
from tessera.operators import sections as X
from tessera.operators import trigrams as G
from tessera.plans import validate as V
from tessera.plans.api import Service, Status, total_count_header

PAGES = {
    "security.adoc": "= Security\n:topics: security\n\nSecurity overview of tokens.\n\n== Tokens\n\ntoken security rules apply",
    "rest.adoc": "= REST\n:topics: rest-apis, security\n\nWriting endpoints.\n\n== JSON\n\nendpoints return json",
    "kafka.adoc": "= Kafka\n:topics: messaging\n\nReading topics.",
}


@pytest.fixture(scope="module")
def service(spark):
    raw = spark.createDataFrame([("main", p, c, "core") for p, c in PAGES.items()] + [("old", "kafka.adoc", "= Kafka\nold security", "core")], "version string, path string, content string, extension string").cache()
    chunks = X.chunks(raw).withColumn("chunk_id", F.xxhash64("version", "page", "ordinal")).cache()
    return Service(raw, chunks, I.postings(chunks, ["version", "chunk_id"]).cache(), Status(1))


def test_search_ranks_and_is_kept_to_its_version(service):
    page, info = service.search("security")
    got = page.collect()
    assert [r.page for r in got][0] == "security" and sorted(r.page for r in got) == ["rest", "security", "security"] and {r.version for r in got} == {"main"}
    assert info["totalCount"] == 3 and not info["hasMore"]
    assert got[0].score == pytest.approx(0.1 * 1.25 / 1.64493406685) and got[-1].score == pytest.approx(0.1 / 1.64493406685)


def test_fuzzy_fallback(service):
    page, info = service.search("endpoinds jsn")
    assert info["totalCount"] >= 1 and page.first().page == "rest"


def test_fuzzy_fallback_from_the_index(service):
    """The same page, of the asked version alone."""
    indexed = Service(service.raw, service.chunks, service.posts, trigrams=lambda v: G.build_trigrams(service.chunks.where(F.col("version") == v)))
    key = ["version", "page", "chunk_id", "score"]
    for version in ("main", "old"):
        (a, one), (b, two) = (s.search("endpoinds jsn secruity", version=version) for s in (indexed, service))
        assert one == two and a.select(key).collect() == b.select(key).collect() and {r.version for r in a.collect()} <= {version}


def test_document_batch_related_catalog(service):
    d = service.document("security.adoc").first()
    assert d.title == "Security" and d.subject == "security" and [s.title for s in d.sections] == ["Security", "Tokens"]
    got, counts = service.batch(["rest.adoc", "none.adoc", "rest.adoc"], brief=True)
    assert counts == {"requested": 2, "retrieved": 1, "errors": 1} and [r.error for r in got.collect()] == [None, "Document not found"]
    r = service.related("security.adoc").first()
    assert r.page == "rest" and r.similarity == 1.0
    assert service.catalog()["subjects"][0] == {"name": "security", "displayName": "Security", "docCount": 2}
    with pytest.raises(V.NotFound):
        service.document("none.adoc")
    hits, info = service.documents("the security", subject="security", limit=5)
    assert info["returnedCount"] == 3 and hits.first().path == "security.adoc"


def test_versions_filters_fields_and_totals(service):
    for call in (lambda v: service.search("security", version=v), lambda v: service.related("rest.adoc", version=v), lambda v: service.document("rest.adoc", version=v), lambda v: service.catalog(version=v)):
        with pytest.raises(V.InvalidInput, match="old"):
            call("9.9")
    assert service.search("security", version="old")[1]["totalCount"] == 1
    assert service.related("security.adoc", subject="security").first().page == "rest" and service.related("security.adoc", subject="messaging").first().page == "kafka" and service.related("security.adoc", subject="cloud").count() == 0
    assert service.related("security.adoc", extension="other").count() == 0 and {r.page for r in service.related("security.adoc", extension="core").collect()} == {"rest", "kafka"}
    with pytest.raises(V.InvalidInput):
        service.related("security.adoc", subject="nothing")
    assert service.related("security.adoc", fields="page,similarity").columns == ["page", "similarity"]
    assert service.document("rest.adoc", fields="title").columns == ["title"] and sorted(service.batch(["rest.adoc"], fields="title")[0].columns) == ["error", "path", "pos", "title"]
    hits, info = service.documents("security", fields="path,score")
    assert hits.columns == ["path", "score"] and total_count_header(info) == {"X-Total-Count": "3"}
    with pytest.raises(V.InvalidInput, match="Available"):
        service.search("security", fields="nothing")


def test_english_service(spark, service):
    posts = S.ENGLISH.posts(service.chunks, ["version", "chunk_id"])
    english = Service(service.raw, service.chunks, posts, analyzer=S.ENGLISH)
    assert english.search("the tokens of a rule")[1]["totalCount"] == 1 and english.search("writes")[0].first().page == "rest"
    assert english.syntax()["stemming"]["algorithm"] == "Porter2" and "the" in english.syntax()["stopWords"]["words"]
    assert S.combined(service.chunks.where("version = 'main'"), service.posts.where("version = 'main'"), "kafka", limit=1).first().page == "kafka"


def test_related_pages_of_all_agree_with_all_pairs(spark):
    random.seed(11)
    for names, most, rare in ((30, 6, 4), (8, 4, 2), (60, 5, 100), (12, 5, 0)):
        rows = [("v" if i % 3 else "w", f"p{random.randrange(1000):03d}x{i}", random.sample([f"t{min(random.randrange(names), random.randrange(names))}" for _ in range(most)], random.randint(0, most)), [f"e{random.randrange(4)}"] if random.random() < 0.7 else []) for i in range(90)]
        got = {}
        for r in R.related_all(spark.createDataFrame(rows, "version string, page string, topics array<string>, extensions array<string>"), 4, rare).collect():
            got.setdefault((r.version, r.page), set()).add((r.other, r.n_shared))
        for v, p, topics, extensions in rows:
            mine = {("t", x) for x in topics} | {("e", x) for x in extensions}
            near = [(-len(mine & ({("t", x) for x in t} | {("e", x) for x in e})), q) for w, q, t, e in rows if w == v and q != p]
            assert got.get((v, p), set()) == {(q, -n) for n, q in sorted(near)[:4] if n}


def test_static_and_status(service):
    assert {e["name"] for e in service.meta()["endpoints"]} >= {"search", "documents", "document", "batch", "related", "catalog", "syntax", "status"}
    assert {"tokenization", "stemming", "stopWords", "scoring", "fuzzyMatching", "unsupported", "examples", "tips"} <= set(service.syntax())
    assert service.syntax()["supported"] and service.root()["links"] and "old" in service.meta()["versions"]
    assert service.status.report()[0] == 503
    service.status.finish("main")
    assert service.status.report()[0] == 200


def test_cached_versions(service):
    cached = Service(service.raw, service.chunks, service.posts, cached=1)
    assert cached.search("security")[1]["totalCount"] == 3 and list(cached.cache._held) == ["main"]
    assert cached.search("security", version="old")[1]["totalCount"] == 1 and list(cached.cache._held) == ["old"]
    cached.cache.invalidate()
    assert not cached.cache._held


def test_and_rank_of_neighbours(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "chunk_id int, content string")
    r = S.ranked(I.postings(df, ["chunk_id"]), S.RULE.query("alpha beta"), ["chunk_id"]).first()
    assert r.score == pytest.approx(S.adjacent_rank()) and math.isclose(r.score, 0.0991032, abs_tol=1e-6)


@pytest.mark.parametrize("call", [lambda: V.query(""), lambda: V.query("x" * 501), lambda: V.limit(0), lambda: V.limit(101), lambda: V.limit("many"), lambda: V.offset("x"), lambda: V.offset(-1), lambda: V.filter_value("a b", "f"), lambda: V.version("../x"), lambda: V.version("9", ["1"]), lambda: V.path("/etc"), lambda: V.path("a/../b"), lambda: V.batch_paths([]), lambda: V.batch_paths(["a"] * 11), lambda: V.keywords("the and"), lambda: V.subject("zz", ["misc"])])
def test_invalid(call):
    with pytest.raises(V.InvalidInput) as e:
        call()
    assert e.value.problem()["status"] == 400


def test_valid():
    assert V.version(None) == "main" and V.limit(None) == 20 and V.limit("7") == 7 and V.offset("") == 0 and V.batch_paths(["a", "b", "a"]) == ["a", "b"] and V.keywords("The REST api") == ["rest", "api"]


def test_stored_postings_follow_the_table(spark, tmp_path):
    """A table that is rewritten under the same path in the same session is indexed anew; an unchanged one isn't."""
    from tessera import queries as Q

    def write(texts):
        rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    write(["hest one tion", "nothing here"])
    found = [r.chunk_id for r in Q.search_and(spark, str(tmp_path)).collect()]
    before = Q.index_of(spark, str(tmp_path)).inputFiles()
    assert found == [0] and Q.index_of(spark, str(tmp_path)).inputFiles() == before
    write(["no more", "hest then tion", "tion and hest"])
    spark.catalog.refreshByPath(f"{tmp_path}/documents.parquet")
    assert sorted(r.chunk_id for r in Q.search_and(spark, str(tmp_path)).collect()) == [1, 2] == sorted(r.chunk_id for r in Q.search_unindexed(spark, str(tmp_path)).collect())
