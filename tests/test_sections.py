import random
import re

from pyspark.sql import functions as F

from tessera.functions.sqlfuncs import _sections
from tessera.operators import incremental as N
from tessera.operators import sections as X

DOC = "= Title\n:topics: a, b\n:topics: c, , d\n\nIntro text here.\nmore of it.\n\n== One\n[source, Java ]\n----\nx = 1\n== not a head\n----\ntext\n=== Two\n\n== Three\nlast"


def rows(spark, *texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    return X.section_rows(df, ["id"], **kw).orderBy("id", "ordinal").collect()


def test_boundaries(spark):
    got = [(r.title, r.start_line, r.end_line) for r in rows(spark, "= T\n\nintro\n\n== A\n\nbody\n\n== B\n\nbody\n")]
    assert got == [("T", 1, 4), ("A", 5, 8), ("B", 9, 12)]


def test_heading_only_sections_vanish_and_code_hides_headings(spark):
    assert [r.title for r in rows(spark, DOC)] == ["Title", "One", "Three"]


def test_blank_null_and_plain(spark):
    assert rows(spark, "", None, " \n ") == []
    (r,) = rows(spark, "just text\nmore")
    assert (r.title, r.start_line, r.chunk_content, r.section_content) == ("", 1, "more", "just text\nmore")


def test_code_blocks(spark):
    df = spark.createDataFrame([(0, DOC + "\n----\nopen")], "id int, content string")
    (b,) = X.code_blocks(df, ["id"]).collect()
    assert (b.language, b.content, b.context, b.start_line, b.end_line) == ("java", "x = 1\n== not a head", "One", 10, 13)


def test_metadata(spark):
    df = spark.createDataFrame([(DOC,)], "c string")
    c = F.col("c")
    df = X.with_description(X.with_description(X.with_first_paragraph(df, c, "p"), c, None, "d"), c, F.lit("Sum"), "s")
    r = df.select(X.listed(X.attribute(c, "topics")).alias("t"), X.attribute(c, "none").alias("n"), "p", "d", "s", X.page_title(c, F.lit("x")).alias("title")).first()
    assert (r.t, r.n, r.p, r.s, r.title) == (["c", "d"], None, "Intro text here. more of it.", "Sum", "Title")
    assert r.d == r.p


def test_random_documents_agree_with_a_plain_parser(spark):
    random.seed(3)
    lines = ["= A", "== B", "=== C c", "text", "", "----", "  ", "====== six", "== ", "-----", "x == y"]
    texts = ["\n".join(random.choice(lines) for _ in range(random.randint(1, 14))) for _ in range(300)]
    got: dict[int, list] = {}
    for r in rows(spark, *texts):
        got.setdefault(r.id, []).append((r.ordinal, r.title, r.start_line, r.end_line))
    for i, t in enumerate(texts):
        assert got.get(i, []) == list(_sections(t)), repr(t)


def paragraph(text):
    lines, out, block, depth = [x.strip() for x in text.split("\n")], [], None, 0
    if not any(x.startswith("= ") for x in lines):
        return ""
    for x in lines[next(i for i, x in enumerate(lines) if x.startswith("= ")) + 1 :]:
        edge = len(x) >= 4 and set(x) in ({"="}, {"-"})
        if block or edge:
            block = block if block and not (edge and x[0] == block) else None if block else x[0]
        elif x.startswith(("ifdef::", "ifndef::")):
            depth += 1
        elif x.startswith("endif::"):
            depth = max(0, depth - 1)
        elif depth or x.startswith((":", "include::", "[")) or (not x and not out):
            pass
        elif not x or re.fullmatch("={2,6} .+", x):
            break
        else:
            out.append(x)
    return " ".join(out)


def test_first_paragraphs_agree_with_a_plain_loop(spark):
    random.seed(5)
    lines = ["= A", "= A", "== B", "text here", "more", "", "----", "====", "=====", "ifdef::x[]", "endif::x[]", ":k: v", "[note]", "include::y[]", "endif::[]"]
    texts = ["\n".join(random.choice(lines) for _ in range(random.randint(1, 16))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {r.id: r.p for r in X.with_first_paragraph(df, F.col("content"), "p").collect()}
    assert [got[i] for i in range(len(texts))] == [paragraph(t or "") for t in texts] and sum(map(bool, got.values())) > 100


def test_rebuild_equals_parsing_everything(spark):
    old = spark.createDataFrame([("v", f"p{i}.adoc", f"= T{i}\ntext {i}\n== S\nbody", None) for i in range(6)], "version string, path string, content string, extension string")
    new = old.where("path <> 'p1.adoc'").withColumn("content", F.when(F.col("path") == "p2.adoc", "= New\nother").otherwise(F.col("content")))
    built = N.rebuild(new, X.chunks(old), N.manifest(old))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(built) == key(X.chunks(new).select(*built.columns))
    assert {r.changed for r in N.any_changed(N.manifest(new), N.manifest(old)).collect()} == {True}
