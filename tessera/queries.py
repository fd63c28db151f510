"""Every operator of the library as a query over the given tables, and the same answer in plain SQL."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fuzzy as Z
from .functions import parser as E
from .functions import text as T
from .operators import blocks as L
from .operators import catalog as C
from .operators import documents as D
from .operators import incremental as N
from .operators import index as I
from .operators import related as R
from .operators import search as S
from .operators import sections as X
from .operators import subjects as J
from .operators import trigrams as G
from .plans.api import Service
from .plans.session import shared_dir, workers_find_package
from .sources import archives as A_
from .sources import playbook as P
from .sources import rawdocs as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- the corpus view: documents as one-chunk pages ------------------------------------------------------------------

CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS chunk_id, d.lang AS version, 'doc-' || d.doc_id AS page, [d.source] AS extensions, d.text AS content,
         list_distinct_ordered AS topics
  FROM documents d JOIN (
    SELECT d2.doc_id, list_filter([d2.lang, CASE WHEN d2.n_chars < 1000 THEN 'short' WHEN d2.n_chars < 5000 THEN 'medium' ELSE 'long' END,
           'q' || l.quality, 't' || l.toxic], lambda x: x IS NOT NULL) AS list_distinct_ordered
    FROM documents d2 LEFT JOIN labels l ON d2.doc_id = l.doc_id) t ON t.doc_id = d.doc_id)
"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    bucket = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    tags = F.array("lang", bucket, F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("page"),
        F.array("source").alias("extensions"), F.array_distinct(F.filter(tags, lambda x: x.isNotNull())).alias("topics"), F.col("text").alias("content"),
    )


def plain(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without topics: no join where none is needed."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("page"), F.array("source").alias("extensions"), F.col("text").alias("content"))


# ---- synthetic markup: every document with a title, attributes, headings and fences -----------------------------------

MARKUP_SQL = """
markup AS (
  SELECT doc_id, lang AS version, 'doc-' || doc_id || '.adoc' AS path, source AS extension,
    '= Doc ' || doc_id || chr(10) || ':topics: ' || lang || ', ' || source || chr(10) || ':categories: web, data' || chr(10) || ':summary: About ' || source || chr(10) || chr(10) ||
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN i % 5 = 0 THEN '== ' || array_to_string(list_slice(string_split(x, ' '), 1, 3), ' ') || chr(10) ELSE '' END ||
      CASE WHEN i % 7 = 0 THEN '[source,Java]' || chr(10) || '----' || chr(10) || x || chr(10) || '----' WHEN i % 3 = 0 THEN 'NOTE: *' || x || '* {attr} xref:a.adoc[see] <<b,c>>' ELSE x END), chr(10)) AS content
  FROM documents)
"""


def markup(spark: SparkSession, sf: str) -> DataFrame:
    nl = F.lit("\n")

    def line(x, i):
        place = i + 1
        head = F.when(place % 5 == 0, F.concat(F.lit("== "), F.array_join(F.slice(F.split(x, " "), 1, 3), " "), nl)).otherwise("")
        body = F.when(place % 7 == 0, F.concat(F.lit("[source,Java]\n----\n"), x, F.lit("\n----"))).when(place % 3 == 0, F.concat(F.lit("NOTE: *"), x, F.lit("* {attr} xref:a.adoc[see] <<b,c>>"))).otherwise(x)
        return F.concat(head, body)

    docs = table(spark, sf, "documents")
    head = F.concat(F.lit("= Doc "), F.col("doc_id").cast("string"), F.lit("\n:topics: "), "lang", F.lit(", "), "source", F.lit("\n:categories: web, data\n:summary: About "), "source", F.lit("\n\n"))
    content = F.concat(head, F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))
    return docs.select("doc_id", F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"), F.col("source").alias("extension"), content.alias("content"))


# ---- SQL building blocks ------------------------------------------------------------------------------------------------

def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({trim_sql(c)}, '\\s+'), lambda w: lower(regexp_replace(w, '[^a-zA-Z0-9-]', '', 'g'))), lambda w: length(w) >= 3)"


def stem_sql(w: str) -> str:
    from .functions.sqlfuncs import stem_sql as spark_form

    return spark_form(w)


def clean_sql(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        to = to.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')" if "\n" not in to else f"regexp_replace({c}, '{pattern}', chr(10) || chr(10), 'g')"
    return c


SLUG_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[''`]', '', 'g'), '[^a-z0-9-]', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"

TERMS_SQL = f"""
tokens AS (SELECT chunk_id, version, unnest({tokens_sql('content')}) AS token, generate_subscripts({tokens_sql('content')}, 1) AS pos FROM corpus),
terms AS (SELECT chunk_id, version, {stem_sql('token')} AS lexeme, pos FROM tokens)
"""
POSTS_SQL = "posts AS (SELECT chunk_id, version, lexeme, list_slice(list_sort(list(DISTINCT least(pos, 16383))), 1, 256) AS positions FROM terms GROUP BY ALL)"


def trgm_sql(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


# ---- scans, filters, projections ----------------------------------------------------------------------------------------

@query("scan_version", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def scan_version(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id", "n_chars")


@query("scan_page", "SELECT doc_id, lang AS version, md5(text) AS digest, 0.0::DOUBLE AS score FROM documents WHERE lang = 'en' AND 'doc-' || doc_id = 'doc-7'")
def scan_page(spark, sf):
    some = plain(spark, sf).where((F.col("version") == "en") & (F.col("page") == "doc-7")).orderBy("chunk_id").limit(1000)
    return some.select(F.col("chunk_id").alias("doc_id"), "version", F.md5("content").alias("digest"), F.lit(0.0).alias("score"))


@query("list_versions", "SELECT DISTINCT lang AS version FROM documents")
def list_versions(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("version")).distinct()


@query("version_exists", "SELECT v.version, EXISTS (SELECT 1 FROM documents d WHERE d.lang = v.version) AS present FROM (VALUES ('en'), ('xx')) v(version)")
def version_exists(spark, sf):
    asked = spark.createDataFrame([("en",), ("xx",)], "version string")
    have = table(spark, sf, "documents").select(F.col("lang").alias("version")).distinct().withColumn("present", F.lit(True))
    return asked.join(have, "version", "left").select("version", F.coalesce("present", F.lit(False)).alias("present"))


@query("filter_tag_member", f"WITH {CORPUS_SQL} SELECT chunk_id FROM corpus WHERE list_contains(extensions, 'src3')")
def filter_tag_member(spark, sf):
    return plain(spark, sf).where(F.array_contains("extensions", "src3")).select("chunk_id")


@query("filter_tag_overlap", f"WITH {CORPUS_SQL} SELECT chunk_id FROM corpus WHERE list_has_any(topics, ['de', 't1']) OR list_has_any(extensions, ['src3'])")
def filter_tag_overlap(spark, sf):
    topics, ext = F.array(F.lit("de"), F.lit("t1")), F.array(F.lit("src3"))
    return corpus(spark, sf).where(F.coalesce(F.arrays_overlap("topics", topics), F.lit(False)) | F.coalesce(F.arrays_overlap("extensions", ext), F.lit(False))).select("chunk_id")


@query("exclude_self", f"WITH {CORPUS_SQL} SELECT chunk_id FROM corpus WHERE page <> 'doc-7'")
def exclude_self(spark, sf):
    return plain(spark, sf).where(F.col("page") != "doc-7").select("chunk_id")


@query("optional_filter", "SELECT doc_id, 'none' AS mode FROM documents UNION ALL SELECT doc_id, 'given' FROM documents WHERE source = 'src2'")
def optional_filter(spark, sf):
    docs = table(spark, sf, "documents")

    def matching(value: str | None):
        return F.lit(True) if value is None or not value.strip() else F.col("source") == value

    return docs.where(matching(" ")).select("doc_id", F.lit("none").alias("mode")).unionByName(docs.where(matching("src2")).select("doc_id", F.lit("given").alias("mode")))


@query("subject_after_limit", f"WITH {CORPUS_SQL}, page AS (SELECT * FROM corpus ORDER BY chunk_id LIMIT 50) SELECT chunk_id FROM page WHERE list_contains(topics, 'short')")
def subject_after_limit(spark, sf):
    return corpus(spark, sf).orderBy("chunk_id").limit(50).where(F.array_contains("topics", "short")).select("chunk_id")


@query("url_fallback", f"WITH {CORPUS_SQL} SELECT chunk_id, coalesce(CASE WHEN chunk_id % 2 = 0 THEN 'https://given.example.org/' || chunk_id END, 'https://docs.example.org/guides/' || page) AS url FROM corpus")
def url_fallback(spark, sf):
    given = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("https://given.example.org/"), F.col("chunk_id").cast("string")))
    return plain(spark, sf).select("chunk_id", F.coalesce(given, T.build_url(F.col("page"))).alias("url"))


@query("first_tag", f"WITH {CORPUS_SQL} SELECT chunk_id, topics[1] AS subject, extensions[1] AS extension FROM corpus")
def first_tag(spark, sf):
    return corpus(spark, sf).select("chunk_id", F.get("topics", F.lit(0)).alias("subject"), F.get("extensions", F.lit(0)).alias("extension"))


@query("path_to_page", f"WITH {MARKUP_SQL} SELECT doc_id, regexp_replace(path, '\\.adoc$', '') AS page, regexp_replace(path, '\\.adoc$', '') || '.adoc' AS path FROM markup WHERE ends_with(path, '.adoc') AND starts_with(path, 'doc-')")
def path_to_page(spark, sf):
    m = markup(spark, sf).where(F.col("path").endswith(".adoc") & F.col("path").startswith("doc-"))
    return m.select("doc_id", T.page_name(F.col("path")).alias("page"), F.concat(T.page_name(F.col("path")), F.lit(".adoc")).alias("path"))


@query("field_projection", "SELECT doc_id, source FROM documents")
def field_projection(spark, sf):
    from .operators.documents import select_fields

    return select_fields(table(spark, sf, "documents"), "source, doc_id")


@query("brief_projection", "SELECT doc_id, '{\"page\":\"doc-' || doc_id || '\"' || CASE WHEN l.toxic IS NULL THEN '' ELSE ',\"toxic\":' || l.toxic END || '}' AS body FROM documents LEFT JOIN labels l USING (doc_id)")
def brief_projection(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.select("doc_id", F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("page"), "toxic")).alias("body"))


# ---- text functions -------------------------------------------------------------------------------------------------------

@query("tokenize_terms", f"SELECT doc_id, len({tokens_sql('text')}) AS n, md5(array_to_string({tokens_sql('text')}, ' ')) AS digest FROM documents")
def tokenize_terms(spark, sf):
    t = T.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("stem_terms", f"WITH {CORPUS_SQL}, {TERMS_SQL} SELECT lexeme, count(*) AS cf, count(DISTINCT chunk_id) AS df FROM terms GROUP BY lexeme")
def stem_terms(spark, sf):
    found = I.term_counts(plain(spark, sf), ["chunk_id"])
    return found.groupBy("lexeme").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("stopword_filter", f"SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array({trim_sql('text')}, '\\s+'), lambda w: lower(w)), lambda w: w <> '' AND w NOT IN ({STOP_SQL})), ' ') AS keywords FROM benchmark")
def stopword_filter(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.parse_keywords(F.col("text")), " ").alias("keywords"))


@query("keyword_freq", f"WITH {CORPUS_SQL}, {TERMS_SQL}, words AS (SELECT chunk_id, {stem_sql('token')} AS stem FROM tokens WHERE token NOT IN ({STOP_SQL})) SELECT chunk_id, stem, count(*) AS frequency FROM words GROUP BY ALL")
def keyword_freq(spark, sf):
    tokens = plain(spark, sf).select("chunk_id", F.explode(T.tokenize(F.col("content"))).alias("token")).where(~F.col("token").isin(*T.STOP_WORDS))
    return tokens.groupBy("chunk_id", T.stem(F.col("token")).alias("stem")).agg(F.count("*").alias("frequency"))


@query("keyword_longest_original", f"WITH {CORPUS_SQL}, {TERMS_SQL}, words AS (SELECT chunk_id, token, pos, {stem_sql('token')} AS stem FROM tokens WHERE token NOT IN ({STOP_SQL})) SELECT chunk_id, stem, arg_max(token, length(token) * 1000000 - pos) AS original, count(*) AS frequency FROM words GROUP BY chunk_id, stem")
def keyword_longest_original(spark, sf):
    tokens = plain(spark, sf).select("chunk_id", F.posexplode(T.tokenize(F.col("content"))).alias("pos", "token")).where(~F.col("token").isin(*T.STOP_WORDS))
    return tokens.groupBy("chunk_id", T.stem(F.col("token")).alias("stem")).agg(F.max_by("token", F.struct(F.length("token"), -F.col("pos"))).alias("original"), F.count("*").alias("frequency"))


@query("clean_markup", f"WITH {MARKUP_SQL} SELECT doc_id, md5({trim_sql(clean_sql('content', T.CLEANING))}) AS digest FROM markup")
def clean_markup(spark, sf):
    return markup(spark, sf).select("doc_id", F.md5(T.clean_markup(F.col("content"))).alias("digest"))


@query("clean_description", f"WITH {MARKUP_SQL} SELECT doc_id, md5({trim_sql(clean_sql(trim_sql(clean_sql('content', T.CLEANING)), T.DESCRIPTION_CLEANING))}) AS digest FROM markup")
def clean_description(spark, sf):
    return markup(spark, sf).select("doc_id", F.md5(T.clean_description(F.col("content"))).alias("digest"))


LINES_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM markup),
marked AS (SELECT *, {trim_sql('line')} AS bare FROM lines),
fenced AS (SELECT *, regexp_full_match(bare, '-{{4,}}') AS fence, sum(regexp_full_match(bare, '-{{4,}}')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS nf FROM marked),
headed AS (SELECT *, NOT fence AND nf % 2 = 0 AND regexp_full_match(bare, '={{1,5}}\\s+.+') AS head FROM fenced)
"""


@query("strip_code", f"WITH {MARKUP_SQL}, {LINES_SQL} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM headed WHERE NOT fence AND nf % 2 = 0 GROUP BY doc_id")
def strip_code(spark, sf):
    return markup(spark, sf).select("doc_id", F.md5(T.strip_code_blocks(F.col("content"))).alias("digest"))


# ---- sections and chunks ----------------------------------------------------------------------------------------------------

SECTIONS_SQL = f"""
{MARKUP_SQL}, {LINES_SQL},
segged AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM headed),
segs AS (SELECT doc_id, seg, max(CASE WHEN head THEN {trim_sql("regexp_extract(bare, '^={1,5}\\s+(.+)$', 1)")} ELSE '' END) AS title,
         min(i) AS first_i, max(CASE WHEN NOT head AND bare <> '' THEN 1 ELSE 0 END) AS visible, max(i) AS last_i FROM segged GROUP BY doc_id, seg),
zero AS (SELECT doc_id, 0 AS seg, '' AS title, 0 AS first_i, 0 AS visible, -1 AS last_i FROM segs GROUP BY doc_id HAVING min(seg) > 0 UNION ALL SELECT * FROM segs),
nexted AS (SELECT *, CASE WHEN seg = 0 THEN 1 ELSE first_i + 1 END AS start_line, last_i + 1 AS end_line, lead(first_i) OVER (PARTITION BY doc_id ORDER BY seg) AS next_i FROM zero),
kept AS (SELECT * FROM nexted WHERE visible = 1 OR (next_i IS NOT NULL AND start_line = 1 AND next_i > 0)),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS ordinal, title, start_line, end_line, lead(start_line) OVER (PARTITION BY doc_id ORDER BY seg) AS next_start FROM kept)
"""


@query("parse_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, ordinal::INT AS ordinal, title, start_line::INT AS start_line, end_line::INT AS end_line FROM sections")
def parse_sections(spark, sf):
    return X.section_rows(markup(spark, sf), ["doc_id"]).select("doc_id", "ordinal", "title", "start_line", "end_line")


@query("chunk_content", f"WITH {SECTIONS_SQL} SELECT s.doc_id, s.ordinal::INT AS ordinal, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '')) AS digest FROM sections s LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.i >= s.start_line AND (s.next_start IS NULL OR l.i < s.next_start) GROUP BY ALL")
def chunk_content(spark, sf):
    return X.section_rows(markup(spark, sf), ["doc_id"]).select("doc_id", "ordinal", F.md5("chunk_content").alias("digest"))


@query("section_content", f"WITH {SECTIONS_SQL} SELECT s.doc_id, s.ordinal::INT AS ordinal, md5(string_agg(l.line, chr(10) ORDER BY l.i)) AS digest FROM sections s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN s.start_line - 1 AND s.end_line - 1 GROUP BY ALL")
def section_content(spark, sf):
    return X.section_rows(markup(spark, sf), ["doc_id"]).select("doc_id", "ordinal", F.md5("section_content").alias("digest"))


@query("section_level", f"WITH {SECTIONS_SQL} SELECT s.doc_id, s.ordinal::INT AS ordinal, coalesce(arg_max(length(regexp_extract(m.bare, '^(=+)', 1)), m.i), 2)::INT AS level FROM sections s LEFT JOIN marked m ON m.doc_id = s.doc_id AND m.i < s.start_line AND regexp_full_match(m.bare, '={{2,5}}\\s+.+') GROUP BY ALL")
def section_level(spark, sf):
    return X.section_rows(markup(spark, sf), ["doc_id"]).select("doc_id", "ordinal", F.col("level").cast("int").alias("level"))


CHUNK_SQL = "chunk AS (SELECT s.doc_id, s.ordinal, s.title AS section, coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '') AS content FROM sections s LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.i >= s.start_line AND (s.next_start IS NULL OR l.i < s.next_start) GROUP BY ALL)"


def chunk_table_sql() -> str:
    t = f"regexp_replace({trim_sql('c.content')}, '^={{1,5}}\\s+', '')"
    summary = f"CASE WHEN {trim_sql('c.content')} = '' THEN '' ELSE left(coalesce(nullif(regexp_extract({t}, '^(.*?\\.)(?:\\s|$)', 1), ''), {t}), 200) END"
    slug = SLUG_SQL.format("c.section")
    return f"""WITH {SECTIONS_SQL}, {CHUNK_SQL} SELECT d.lang AS version, 'doc-' || d.doc_id AS page, 'doc-' || d.doc_id || '#' || {slug} AS chunk_key, 'Doc ' || d.doc_id AS title, c.section, c.ordinal::INT AS ordinal,
    'https://docs.example.org/guides/doc-' || d.doc_id || CASE WHEN {slug} = '' THEN '' ELSE '#' || {slug} END AS url, array_to_string(list_concat([d.lang, d.source], ['web', 'data']), ',') AS topics, d.source AS extensions, {summary} AS summary, md5(c.content) AS digest
    FROM chunk c JOIN documents d USING (doc_id)"""


@query("chunk_table", chunk_table_sql())
def chunk_table(spark, sf):
    out = X.chunks(markup(spark, sf))
    return out.select("version", "page", "chunk_key", "title", "section", "ordinal", "url", F.array_join("topics", ",").alias("topics"), F.array_join("extensions", ",").alias("extensions"), "summary", F.md5("content").alias("digest"))


@query("parse_code_blocks", f"WITH {MARKUP_SQL}, {LINES_SQL}, f AS (SELECT doc_id, i, nf FROM headed WHERE fence), p AS (SELECT a.doc_id, a.nf, a.i AS open_i, b.i AS shut_i FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.nf % 2 = 1 AND b.nf = a.nf + 1) SELECT p.doc_id, p.open_i::INT + 1 AS start_line, p.shut_i::INT + 1 AS end_line, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '')) AS digest FROM p LEFT JOIN lines l ON l.doc_id = p.doc_id AND l.i > p.open_i AND l.i < p.shut_i GROUP BY ALL")
def parse_code_blocks(spark, sf):
    return X.code_blocks(markup(spark, sf), ["doc_id"]).select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


@query("code_block_language", f"WITH {MARKUP_SQL}, {LINES_SQL}, f AS (SELECT doc_id, i, nf FROM headed WHERE fence), p AS (SELECT a.doc_id, a.nf, a.i AS open_i FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.nf % 2 = 1 AND b.nf = a.nf + 1), prev AS (SELECT p.doc_id, p.open_i, coalesce(max(f.i), -1) AS after_i FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i < p.open_i GROUP BY ALL), pick AS (SELECT v.doc_id, v.open_i, arg_max(h.bare, h.i) AS bare FROM prev v LEFT JOIN headed h ON h.doc_id = v.doc_id AND h.i > v.after_i AND h.i < v.open_i AND h.bare <> '' AND NOT h.head GROUP BY ALL), ctx AS (SELECT p.doc_id, p.open_i, arg_max({trim_sql("regexp_extract(h.bare, '^={1,5}\\s+(.+)$', 1)")}, h.i) AS context FROM p LEFT JOIN headed h ON h.doc_id = p.doc_id AND h.i < p.open_i AND h.head GROUP BY ALL) SELECT k.doc_id, k.open_i::INT + 1 AS start_line, coalesce(lower({trim_sql("regexp_extract(k.bare, '^\\[source(?:,\\s*([^\\]]+))?\\]$', 1)")}), '') AS language, coalesce(c.context, '') AS context FROM pick k JOIN ctx c USING (doc_id, open_i)")
def code_block_language(spark, sf):
    return X.code_blocks(markup(spark, sf), ["doc_id"]).select("doc_id", "start_line", "language", "context")


def described_sql() -> str:
    """Documents with a summary, with a description, with neither; blocks, conditions and directives before the paragraph."""
    return """
described AS (SELECT doc_id, '= Doc ' || doc_id || chr(10) || CASE doc_id % 4 WHEN 0 THEN ':summary: ' || left(replace(text, chr(10), ' '), 500) || chr(10) WHEN 1 THEN ':description: All about *' || source || '* and ' || left(replace(text, chr(10), ' '), 400) || chr(10) ELSE '' END
  || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'ifdef::a[]' || chr(10) || 'left out' || chr(10) || 'endif::[]' || chr(10) || '----' || chr(10) || 'code' || chr(10) || chr(10) || '----' || chr(10) WHEN 1 THEN '[NOTE]' || chr(10) || 'include::x.adoc[]' || chr(10) ELSE '' END
  || list_slice(string_split(text, chr(10)), 1, 2)[1] || chr(10) || coalesce(list_slice(string_split(text, chr(10)), 1, 2)[2], '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE chr(10) || '== Next' END || chr(10) || 'more' AS content, list_slice(string_split(text, chr(10)), 1, 2) AS wanted FROM documents),
paragraphs AS (SELECT doc_id, content, array_to_string(CASE WHEN """ + trim_sql("wanted[1]") + """ = '' THEN CASE WHEN """ + trim_sql("coalesce(wanted[2], '')") + """ = '' THEN CASE WHEN doc_id % 2 = 0 THEN ['more'] ELSE [] END ELSE [""" + trim_sql("wanted[2]") + """] END WHEN """ + trim_sql("coalesce(wanted[2], '')") + """ = '' THEN [""" + trim_sql("wanted[1]") + """] ELSE [""" + trim_sql("wanted[1]") + ", " + trim_sql("wanted[2]") + """] END, ' ') AS raw FROM described),
found AS (SELECT doc_id, content, """ + trim_sql(clean_sql(trim_sql(clean_sql("raw", T.CLEANING)), T.DESCRIPTION_CLEANING)) + """ AS paragraph FROM paragraphs)"""


def described(spark, sf) -> DataFrame:
    nl, text = F.lit("\n"), F.col("text")
    flat, lines = F.replace(text, F.lit("\n"), F.lit(" ")), F.split(text, "\n")
    i = F.col("doc_id")
    about = F.when(i % 4 == 0, F.concat(F.lit(":summary: "), F.substring(flat, 1, 500), nl)).when(i % 4 == 1, F.concat(F.lit(":description: All about *"), F.col("source"), F.lit("* and "), F.substring(flat, 1, 400), nl)).otherwise("")
    before = F.when(i % 3 == 0, "ifdef::a[]\nleft out\nendif::[]\n----\ncode\n\n----\n").when(i % 3 == 1, "[NOTE]\ninclude::x.adoc[]\n").otherwise("")
    after = F.when(i % 2 == 0, "\n").otherwise("\n== Next")
    content = F.concat(F.lit("= Doc "), i.cast("string"), nl, about, nl, before, F.get(lines, F.lit(0)), nl, F.coalesce(F.get(lines, F.lit(1)), F.lit("")), after, F.lit("\nmore"))
    return table(spark, sf, "documents").select("doc_id", content.alias("content"))


@query("first_paragraph", f"WITH {described_sql()} SELECT doc_id, paragraph FROM found")
def first_paragraph(spark, sf):
    return X.with_first_paragraph(described(spark, sf), F.col("content"), "paragraph").select("doc_id", "paragraph")


@query("header_metadata", f"WITH {MARKUP_SQL}, h AS (SELECT doc_id, regexp_split_to_array(content, '(?m)^== ')[1] AS header FROM markup) SELECT doc_id, array_to_string(list_transform(string_split(regexp_extract(header, '(?m)^:topics:\\s*(.*)$', 1), ','), lambda x: trim(x)), '|') AS topics, array_to_string(list_transform(string_split(regexp_extract(header, '(?m)^:categories:\\s*(.*)$', 1), ','), lambda x: trim(x)), '|') AS categories, regexp_extract(header, '(?m)^:summary:\\s*(.*)$', 1) AS summary FROM h")
def header_metadata(spark, sf):
    c = F.col("content")
    return markup(spark, sf).select("doc_id", F.array_join(X.listed(X.attribute(c, "topics")), "|").alias("topics"), F.array_join(X.listed(X.attribute(c, "categories")), "|").alias("categories"), X.attribute(c, "summary").alias("summary"))


@query("doc_title", f"WITH {MARKUP_SQL} SELECT doc_id, coalesce(nullif(regexp_extract(content, '(?m)^= (.+)$', 1), ''), 'doc-' || doc_id) AS title, regexp_extract(content, '(?m)^=\\s+(.+)$', 1) AS api_title FROM markup")
def doc_title(spark, sf):
    c = F.col("content")
    return markup(spark, sf).select("doc_id", X.page_title(c, T.page_name(F.col("path"))).alias("title"), X.document_title(c).alias("api_title"))


def truncated_sql(c: str, n: int = 300) -> str:
    head = f"left({c}, {n + 1})"
    at = f"(CASE WHEN contains({head}, ' ') THEN length({head}) - position(' ' IN reverse({head})) ELSE -1 END)"
    return f"CASE WHEN length({c}) <= {n} THEN {c} WHEN {at} > {round(0.7 * n)} THEN left({c}, {at}) || '…' ELSE left({c}, {n}) || '…' END"


NAMED_SQL = trim_sql(clean_sql(trim_sql(clean_sql("regexp_extract(content, '(?m)^:description:\\s*(.+)$', 1)", T.CLEANING)), T.DESCRIPTION_CLEANING))


@query("description", f"WITH {described_sql()}, c AS (SELECT doc_id, coalesce(nullif(regexp_extract(content, '(?m)^:summary:\\s*(.*)$', 1), ''), nullif({NAMED_SQL}, ''), paragraph) AS d FROM found) SELECT doc_id, {truncated_sql('d')} AS description FROM c")
def description(spark, sf):
    c = F.col("content")
    return X.with_description(described(spark, sf), c, X.attribute(c, "summary")).select("doc_id", "description")


@query("first_sentence", f"WITH s AS (SELECT doc_id, regexp_replace({trim_sql('text')}, '^={{1,5}}\\s+', '') AS t FROM documents) SELECT doc_id, left(coalesce(nullif(regexp_extract(t, '^(.*?\\.)(?:\\s|$)', 1), ''), t), 200) AS summary FROM s")
def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("summary"))


@query("truncate_words", "WITH s AS (SELECT doc_id, text, left(text, 301) AS head FROM documents), p AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - position(' ' IN reverse(head)) ELSE -1 END AS cut_at FROM s) SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN cut_at > 210 THEN left(text, cut_at) || '…' ELSE left(text, 300) || '…' END AS cut FROM p")
def truncate_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_words(F.col("text"), 300).alias("cut"))


@query("slug_url", f"SELECT p_partkey, {SLUG_SQL.format('p_name')} AS slug, 'https://docs.example.org/guides/part-' || p_partkey || CASE WHEN {SLUG_SQL.format('p_name')} = '' THEN '' ELSE '#' || {SLUG_SQL.format('p_name')} END AS url FROM part")
def slug_url(spark, sf):
    page = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".adoc"))
    return table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.build_url(page, F.col("p_name")).alias("url"))


@query("display_name", f"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split({SLUG_SQL.format('p_name')}, '-'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS name FROM part")
def display_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.display_name(T.slug(F.col("p_name"))).alias("name"))


@query("etag_hash", "SELECT p_partkey, left(sha256('{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\"}'), 16) AS etag FROM part")
def etag_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.etag("p_partkey", "p_brand").alias("etag"))


@query("cache_tier", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1800 WHEN doc_id % 3 = 1 THEN 900 ELSE 3600 END AS seconds FROM documents")
def cache_tier(spark, sf):
    i = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", T.cache_seconds(F.when(i == 0, "catalog").otherwise("search"), F.when(i == 1, "main").otherwise("3.1")).alias("seconds"))


@query("base64_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def base64_decode(spark, sf):
    coded = table(spark, sf, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("c"))
    return coded.select("doc_id", F.md5(T.decoded_content(F.col("c"), F.lit("base64"))).alias("digest"))


@query("branch_resolve", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'v1' WHEN 2 THEN 'dev' ELSE 'main' END AS branch FROM documents")
def branch_resolve(spark, sf):
    i = F.col("doc_id") % 4
    lists = F.when(i == 0, F.array(F.lit("HEAD"), F.lit("/rel.*/"))).when(i == 1, F.array(F.lit("v*"), F.lit("v1"), F.lit("v2"))).when(i == 2, F.array(F.lit("dev")))
    return table(spark, sf, "documents").select("doc_id", T.concrete_branch(lists).alias("branch"))


# ---- index and ranked search ------------------------------------------------------------------------------------------------

@query("inverted_index_df", f"WITH {CORPUS_SQL}, {TERMS_SQL} SELECT version, lexeme, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM terms GROUP BY ALL")
def inverted_index_df(spark, sf):
    return I.document_frequency(plain(spark, sf), ["chunk_id"], ["version"])


@query("postings_positions", f"WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL} SELECT chunk_id, lexeme, len(positions)::INT AS tf, array_to_string(positions, ',') AS positions FROM posts")
def postings_positions(spark, sf):
    return I.postings(plain(spark, sf), ["chunk_id"]).select("chunk_id", "lexeme", "tf", F.array_join("positions", ",").alias("positions"))


RANK_ONE_SQL = "list_sum(list_transform(range(1, len(positions) + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685"


@query("search_single_term", f"WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL} SELECT chunk_id, round({RANK_ONE_SQL}, 6) AS score FROM posts WHERE version = 'en' AND lexeme = 'shth'")
def search_single_term(spark, sf):
    return S.ranked(index_of(spark, sf), ["shth"], ["chunk_id"]).select("chunk_id", F.round("score", 6).alias("score"))


def and_sql(terms: list[str]) -> str:
    """Documents with every term, and their rank by all position pairs."""
    listed = ", ".join(f"'{t}'" for t in terms)
    weight = "sqrt(0.01 * CASE WHEN abs(x.p - y.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)) END)"
    return f"""WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL},
    hit AS (SELECT chunk_id, extensions FROM corpus WHERE chunk_id IN (SELECT chunk_id FROM posts WHERE version = 'en' AND lexeme IN ({listed}) GROUP BY chunk_id HAVING count(*) = {len(terms)})),
    flat AS (SELECT chunk_id, lexeme, unnest(positions) AS p FROM posts WHERE lexeme IN ({listed}) AND chunk_id IN (SELECT chunk_id FROM hit)),
    ranked AS (SELECT h.chunk_id, any_value(h.extensions) AS extensions, round(1 - exp(sum(CASE WHEN x.p = y.p THEN 0 ELSE ln(1 - {weight}) END)), 6) AS score
               FROM hit h JOIN flat x ON x.chunk_id = h.chunk_id JOIN flat y ON y.chunk_id = h.chunk_id AND x.lexeme < y.lexeme GROUP BY h.chunk_id)"""


def _store(spark, sf) -> I.IndexStore:
    return I.IndexStore(spark, f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()}")


def index_of(spark, sf, version: str | None = "en", analyzer: str = "rule") -> DataFrame:
    """The stored postings of a version of the corpus, or of all; they are made when they are first asked for, and again
    after the table's files have changed."""
    build = S.RULE.posts if analyzer == "rule" else S.ENGLISH.posts
    some = plain(spark, sf).where(F.col("version") == version) if version else plain(spark, sf)
    return _store(spark, sf).read_through(f"postings-{analyzer}", version or "_all", lambda: build(some, ["chunk_id"]), ["lexeme"], I.stamp(spark, f"{sf}/documents.parquet"))


def blocks_of(spark, sf, version: str | None = None) -> DataFrame:
    """The posting blocks of a version, or of all, made of the stored postings and stored like them."""
    build = lambda: L.build_blocks(index_of(spark, sf, version))
    return _store(spark, sf).read_through("blocks-rule", version or "_all", build, made_of=I.stamp(spark, f"{sf}/documents.parquet")).drop("version")


def trigrams_of(spark, sf, version: str = "en") -> DataFrame:
    """The trigram index of a version, stored like the postings."""
    build = lambda: G.build_trigrams(plain(spark, sf).where(F.col("version") == version))
    return _store(spark, sf).read_through("trigrams", version, build, ["trigram", "shard", "class"], I.stamp(spark, f"{sf}/documents.parquet")).drop("version")


def _ranked(spark, sf, text: str) -> DataFrame:
    return S.ranked(index_of(spark, sf), S.RULE.query(text), ["chunk_id"]).select("chunk_id", F.round("score", 6).alias("score"))


@query("index_store", f"WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL} SELECT version, lexeme, count(*) AS chunks, sum(len(positions))::BIGINT AS places FROM posts WHERE version = 'en' GROUP BY ALL")
def index_store(spark, sf):
    return index_of(spark, sf).groupBy("version", "lexeme").agg(F.count("*").alias("chunks"), F.sum("tf").alias("places"))


PAIR = ["hest", "tion"]


@query("search_and", f"{and_sql(PAIR)} SELECT chunk_id FROM hit")
def search_and(spark, sf):
    return _ranked(spark, sf, " ".join(PAIR)).select("chunk_id")


@query("search_and_rank", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked")
def search_and_rank(spark, sf):
    return _ranked(spark, sf, " ".join(PAIR))


@query("search_unindexed", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked")
def search_unindexed(spark, sf):
    """The same search over texts of which nothing is stored."""
    return S.ranked_texts(plain(spark, sf).where("version = 'en'"), " ".join(PAIR), ["chunk_id"]).select("chunk_id", F.round("score", 6).alias("score"))


ENGLISH_SQL = f"""WITH words AS (SELECT doc_id AS chunk_id, {E.tokens_sql('text')} AS w FROM documents WHERE lang = 'en'),
    tokens AS (SELECT chunk_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM words),
    named AS (SELECT chunk_id, least(pos, 16383) AS p, CASE WHEN regexp_full_match(token, '(word|part):hest(ed|ly|ing|es)?') THEN 'hest' WHEN regexp_full_match(token, '(word|part):tion(ed|ing|ly|es|lying|lyed|edly|ingly)?') THEN 'tion' END AS lexeme FROM tokens),
    posts AS (SELECT chunk_id, lexeme, list_slice(list_sort(list(DISTINCT p)), 1, 256) AS positions FROM named WHERE lexeme IS NOT NULL GROUP BY ALL),
    flat AS (SELECT chunk_id, lexeme, unnest(positions) AS p FROM posts WHERE chunk_id IN (SELECT chunk_id FROM posts GROUP BY chunk_id HAVING count(*) = 2))
    SELECT x.chunk_id, round(1 - exp(sum(CASE WHEN x.p = y.p THEN 0 ELSE ln(1 - sqrt(0.01 * CASE WHEN abs(x.p - y.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)) END)) END)), 6) AS score
    FROM flat x JOIN flat y ON x.chunk_id = y.chunk_id AND x.lexeme < y.lexeme GROUP BY x.chunk_id"""


@query("search_english", ENGLISH_SQL)
def search_english(spark, sf):
    """Under the English analyzer: the query's forms and its stop words fall away."""
    lexemes = S.ENGLISH.query("the hesting of tions")
    return S.ranked(index_of(spark, sf, analyzer="english"), lexemes, ["chunk_id"]).select("chunk_id", F.round("score", 6).alias("score"))


@query("search_count", f"{and_sql(PAIR)} SELECT count(*) AS total FROM hit")
def search_count(spark, sf):
    return _ranked(spark, sf, " ".join(PAIR)).agg(F.count("*").alias("total"))


@query("search_ext_filter", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked WHERE list_contains(extensions, 'src0')")
def search_ext_filter(spark, sf):
    some = plain(spark, sf).where("version = 'en'").where(F.array_contains("extensions", "src0")).select("chunk_id")
    return _ranked(spark, sf, " ".join(PAIR)).join(some, "chunk_id", "left_semi")


@query("search_page2", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked ORDER BY score DESC, chunk_id LIMIT 10 OFFSET 10")
def search_page2(spark, sf):
    return _ranked(spark, sf, " ".join(PAIR)).orderBy(F.desc("score"), "chunk_id").offset(10).limit(10)


@query("pagination_envelope", f"{and_sql(PAIR)}, page AS (SELECT * FROM ranked ORDER BY score DESC, chunk_id LIMIT 10 OFFSET 10) SELECT (SELECT count(*) FROM ranked) AS total_count, count(*) AS returned_count, 10 + count(*) < (SELECT count(*) FROM ranked) AS has_more FROM page")
def pagination_envelope(spark, sf):
    return _ranked(spark, sf, " ".join(PAIR)).agg(F.count("*").alias("n")).select(*S.page_info(F.col("n"), 10, 10))


QUERY_SQL = f"SELECT item_id, unnest(list_distinct(list_transform({tokens_sql('text')}, lambda w: {stem_sql('w')}))) AS lexeme, len(list_distinct(list_transform({tokens_sql('text')}, lambda w: {stem_sql('w')}))) AS k FROM benchmark"


@query("batch_search", f"WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL}, q AS ({QUERY_SQL}) SELECT q.item_id, p.version, count(*) AS hits FROM (SELECT item_id, version, chunk_id FROM q JOIN posts USING (lexeme) GROUP BY item_id, version, chunk_id HAVING count(*) = any_value(k)) p JOIN (SELECT DISTINCT item_id FROM q) q USING (item_id) GROUP BY ALL")
def batch_search(spark, sf):
    """Every passage of the benchmark, whole, as a query over all versions: the documents that hold all its words."""
    asked = table(spark, sf, "benchmark").select("item_id", T.stems(F.col("text")).alias("lexemes"))
    found = L.many_hits(asked, blocks_of(spark, sf), ["item_id"])
    versions = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("version"))
    return found.join(versions, "chunk_id").groupBy("item_id", "version").agg(F.count("*").alias("hits"))


@query("stored_blocks", f"WITH {CORPUS_SQL}, {TERMS_SQL}, {POSTS_SQL} SELECT chunk_id, lexeme, len(positions)::INT AS tf, array_to_string(positions, ',') AS positions FROM posts")
def stored_blocks(spark, sf):
    """What the compressed blocks of all versions hold."""
    return L.postings_of(blocks_of(spark, sf)).select("chunk_id", "lexeme", "tf", F.array_join("positions", ",").alias("positions"))


@query("search_topk", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked ORDER BY score DESC, chunk_id LIMIT 20")
def search_topk(spark, sf):
    """The best of full ranking, from the blocks that can hold them."""
    return L.top_hits(blocks_of(spark, sf, "en"), S.RULE.query(" ".join(PAIR)), 20, decimals=6)


TYPO = "thear onntsh retion"


@query("fuzzy_similarity", f"SELECT p_partkey, round({similarity_sql(trgm_sql('p_name'), trgm_sql(chr(39) + 'blue stel anodized' + chr(39)))}, 6) AS score FROM part")
def fuzzy_similarity(spark, sf):
    score = T.similarity(T.trigrams(F.col("p_name")), T.trigrams(F.lit("blue stel anodized")))
    return table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("trigram_store", f"WITH t AS (SELECT unnest({trgm_sql('text')}) AS trigram FROM documents WHERE lang = 'en') SELECT trigram, count(*) AS documents FROM t GROUP BY trigram")
def trigram_store(spark, sf):
    """What the stored trigram index holds."""
    return trigrams_of(spark, sf).where("trigram <> ''").groupBy("trigram").agg(F.sum("n").alias("documents"))


FUZZY_SQL = f"WITH s AS (SELECT doc_id, {similarity_sql(trgm_sql('text'), trgm_sql(chr(39) + TYPO + chr(39)))} AS score FROM documents WHERE lang = 'en') SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0.1 ORDER BY s.score DESC, doc_id LIMIT 20"


@query("fuzzy_topk", FUZZY_SQL)
def fuzzy_topk(spark, sf):
    """From the stored trigram index alone: no text is read."""
    hits = G.similar(trigrams_of(spark, sf), TYPO, S.THRESHOLD).orderBy(F.desc("score"), "chunk_id").limit(20)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("fuzzy_unindexed", FUZZY_SQL)
def fuzzy_unindexed(spark, sf):
    hits = S.fuzzy(plain(spark, sf).where("version = 'en'"), TYPO).orderBy(F.desc("score"), "chunk_id").limit(20)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("search_fallback", f"WITH s AS (SELECT doc_id, {similarity_sql(trgm_sql('text'), trgm_sql(chr(39) + 'zzthe theazz' + chr(39)))} AS score FROM documents WHERE lang = 'en') SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0.1 ORDER BY s.score DESC, doc_id LIMIT 20")
def search_fallback(spark, sf):
    base = plain(spark, sf).where("version = 'en'")
    page, _ = S.search(base, index_of(spark, sf).drop("version"), "zzthe theazz", extension="src0", trigrams=trigrams_of(spark, sf))
    return page.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("typed_tokens", f"WITH t AS (SELECT doc_id, {E.tokens_sql('text')} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS tokens, len(list_filter(w, lambda x: NOT starts_with(x, 'word:')))::BIGINT AS not_words, md5(array_to_string(w, ' ')) AS digest FROM t WHERE len(w) > 0")
def typed_tokens(spark, sf):
    """Every token of every document, whatever its language, with its kind, in its place."""
    found = E.typed_tokens(table(spark, sf, "documents"), ["doc_id"], "text")
    named = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "token"))), lambda t: F.concat(t["kind"], F.lit(":"), t["token"]))
    return found.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum((F.col("kind") != "word").cast("long")).alias("not_words"), F.md5(F.array_join(named, " ").cast("binary")).alias("digest"))


@query("porter2_terms")
def porter2_terms(spark, sf):
    return E.lexemes(plain(spark, sf).where("version = 'en'"), ["chunk_id"]).groupBy("lexeme").agg(F.count("*").alias("cf"), F.count_distinct("chunk_id").alias("df"))


# ---- facets, related pages, lookups -----------------------------------------------------------------------------------------

@query("facet_extensions", f"WITH {CORPUS_SQL}, u AS (SELECT page, unnest(extensions) AS value FROM corpus) SELECT value, count(DISTINCT page) AS pages FROM u GROUP BY value ORDER BY pages DESC, value LIMIT 500")
def facet_extensions(spark, sf):
    return C.facet(plain(spark, sf), "extensions")


@query("facet_topics", f"WITH {CORPUS_SQL}, u AS (SELECT page, unnest(topics) AS value FROM corpus) SELECT value, count(DISTINCT page) AS pages FROM u GROUP BY value ORDER BY pages DESC, value LIMIT 500")
def facet_topics(spark, sf):
    return C.facet(corpus(spark, sf), "topics")


@query("catalog_sorted", f"WITH {CORPUS_SQL}, u AS (SELECT page, unnest(extensions) AS name FROM corpus) SELECT name, upper(left(name, 1)) || substr(name, 2) AS display_name, CASE WHEN name = 'src1' THEN 'Source One' ELSE '' END AS title, count(DISTINCT page) AS pages FROM u GROUP BY name")
def catalog_sorted(spark, sf):
    titles = spark.createDataFrame([("src1", "Source One")], "name string, title string")
    return C.extension_facet(plain(spark, sf), titles).select("name", "display_name", "title", "pages")


@query("related_single", f"WITH {CORPUS_SQL}, s AS (SELECT version, topics AS st, extensions AS se FROM corpus WHERE page = 'doc-7'), r AS (SELECT c.page, (len(list_intersect(s.st, c.topics)) + len(list_intersect(s.se, c.extensions)))::DOUBLE / (len(s.st) + len(s.se)) AS similarity FROM corpus c JOIN s USING (version) WHERE c.page <> 'doc-7') SELECT page, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.05 ORDER BY r.similarity DESC, page LIMIT 20")
def related_single(spark, sf):
    pages = corpus(spark, sf).withColumn("title", F.lit(""))
    return R.related(pages, "doc-7", 20).select("page", F.round("similarity", 6).alias("similarity"))


@query("related_page_cut", f"WITH {CORPUS_SQL}, s AS (SELECT version, topics AS st, extensions AS se FROM corpus WHERE page = 'doc-7'), cut AS (SELECT c.*, s.st, s.se FROM corpus c JOIN s USING (version) WHERE c.page <> 'doc-7' AND (list_has_any(c.topics, s.st) OR list_has_any(c.extensions, s.se)) ORDER BY c.page LIMIT 15), r AS (SELECT page, (len(list_intersect(st, topics)) + len(list_intersect(se, extensions)))::DOUBLE / (len(st) + len(se)) AS similarity FROM cut) SELECT page, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.05 ORDER BY r.similarity DESC, page LIMIT 5")
def related_page_cut(spark, sf):
    pages = corpus(spark, sf).withColumn("title", F.lit(""))
    return R.related(pages, "doc-7", 5, exact=False).select("page", F.round("similarity", 6).alias("similarity"))


@query("related_all_pairs", f"WITH {CORPUS_SQL}, t AS (SELECT version, page, list_concat(list_transform(topics, lambda x: 't:' || x), list_transform(extensions, lambda x: 'e:' || x)) AS tags FROM corpus), r AS (SELECT a.version, a.page, b.page AS other, len(list_intersect(a.tags, b.tags)) AS n_shared FROM t a JOIN t b ON a.version = b.version AND a.page <> b.page), o AS (SELECT *, row_number() OVER (PARTITION BY version, page ORDER BY n_shared DESC, other) AS rn FROM r WHERE n_shared > 0) SELECT version, page, other, n_shared::BIGINT AS n_shared FROM o WHERE rn <= 5")
def related_all_pairs(spark, sf):
    return R.related_all(corpus(spark, sf), 5)


@query("topic_union", f"WITH {CORPUS_SQL}, u AS (SELECT extensions[1] AS source, unnest(topics) AS topic FROM corpus) SELECT source, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM u GROUP BY source")
def topic_union(spark, sf):
    tags = corpus(spark, sf).select(F.get("extensions", F.lit(0)).alias("source"), F.explode("topics").alias("topic")).distinct()
    return tags.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))


@query("ordered_distinct_union", f"WITH {CORPUS_SQL} SELECT chunk_id, array_to_string(list_concat(topics, list_filter(['data', version, 'web'], lambda x: NOT list_contains(topics, x))), ',') AS merged FROM corpus")
def ordered_distinct_union(spark, sf):
    other = F.array(F.lit("data"), F.col("version"), F.lit("web"))
    return corpus(spark, sf).select("chunk_id", F.array_join(F.array_distinct(F.concat("topics", other)), ",").alias("merged"))


@query("docs_batch_lookup", "SELECT q.pos, q.path, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 'Document not found' END AS error FROM (VALUES (0, 'doc-3.adoc'), (1, 'doc-x.adoc'), (2, 'doc-5.adoc')) q(pos, path) LEFT JOIN documents d ON 'doc-' || d.doc_id || '.adoc' = q.path")
def docs_batch_lookup(spark, sf):
    from .plans.validate import batch_paths

    wanted = batch_paths(["doc-3.adoc", "doc-x.adoc", "doc-5.adoc", "doc-3.adoc"])
    asked = spark.createDataFrame(list(enumerate(wanted)), "pos int, path string")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"))
    return asked.join(docs, "path", "left").select("pos", "path", "doc_id", F.when(F.col("doc_id").isNull(), "Document not found").alias("error"))


@query("batch_counters", "SELECT count(*) AS requested, count(d.doc_id) AS retrieved, count(*) - count(d.doc_id) AS errors FROM (VALUES ('doc-3.adoc'), ('doc-x.adoc'), ('doc-5.adoc')) q(path) LEFT JOIN documents d ON 'doc-' || d.doc_id || '.adoc' = q.path")
def batch_counters(spark, sf):
    got = docs_batch_lookup(spark, sf)
    return got.agg(F.count("*").alias("requested"), F.count_if(F.col("error").isNull()).alias("retrieved"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("search_join_docs", f"{and_sql(PAIR)}, page AS (SELECT * FROM ranked ORDER BY score DESC, chunk_id LIMIT 5) SELECT p.chunk_id, d.n_chars, p.score FROM page p JOIN documents d ON d.doc_id = p.chunk_id")
def search_join_docs(spark, sf):
    page = _ranked(spark, sf, " ".join(PAIR)).orderBy(F.desc("score"), "chunk_id").limit(5)
    return table(spark, sf, "documents").join(F.broadcast(page), F.col("doc_id") == F.col("chunk_id")).select("chunk_id", "n_chars", "score")


@query("first_chunk_per_page", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def first_chunk_per_page(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("turn", "role"), "turn").alias("f")).select("conv_id", "f.turn", "f.role")


# ---- incremental refresh ------------------------------------------------------------------------------------------------------

MANIFEST_SQL = """
old AS (SELECT lang AS version, 'doc-' || doc_id AS path, md5(text) AS sha FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT lang AS version, 'doc-' || doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS sha FROM documents WHERE doc_id % 13 <> 0)
"""


def _manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The manifests before and after a change of the corpus."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    i = F.col("doc_id")
    after = docs.where(i % 13 != 0).withColumn("content", F.when(i % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return N.manifest(docs.where(i % 10 != 0)), N.manifest(after)


@query("manifest_diff", f"WITH {MANIFEST_SQL} SELECT n.version, n.path, n.sha, CASE WHEN o.sha IS NULL THEN 'added' ELSE 'modified' END AS status FROM new n LEFT JOIN old o USING (version, path) WHERE o.sha IS DISTINCT FROM n.sha")
def manifest_diff(spark, sf):
    old, new = _manifests(spark, sf)
    return N.changed(new, old)


@query("manifest_tombstones", f"WITH {MANIFEST_SQL} SELECT o.version, o.path FROM old o LEFT JOIN new n USING (version, path) WHERE n.path IS NULL")
def manifest_tombstones(spark, sf):
    old, new = _manifests(spark, sf)
    return N.removed(new, old)


@query("any_changed", f"WITH {MANIFEST_SQL} SELECT version, bool_or(o.sha IS DISTINCT FROM n.sha) AS changed FROM old o FULL JOIN new n USING (version, path) GROUP BY version")
def any_changed(spark, sf):
    old, new = _manifests(spark, sf)
    return N.any_changed(new, old)


@query("latest_per_path", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_per_path(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return N.latest(rows, ["user_id", "event_type"], "event_id")


CHANGED_SQL = MARKUP_SQL.replace("markup AS (", "before AS (") + """, markup AS (SELECT doc_id, version, path, extension, content || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'More text.' ELSE '' END AS content FROM before WHERE doc_id % 13 <> 0)"""


@query("incremental_rebuild", f"WITH {SECTIONS_SQL.replace(MARKUP_SQL, CHANGED_SQL)}, {CHUNK_SQL} SELECT d.lang AS version, 'doc-' || d.doc_id AS page, c.ordinal::INT AS ordinal, c.section, md5(c.content) AS digest FROM chunk c JOIN documents d USING (doc_id)")
def incremental_rebuild(spark, sf):
    """Chunks after a change, by keeping unchanged pages: equal to parsing everything (tests compare the two)."""
    before = markup(spark, sf)
    i = F.col("doc_id")
    after = before.where(i % 13 != 0).withColumn("content", F.when(i % 7 == 0, F.concat("content", F.lit("\nMore text."))).otherwise(F.col("content")))
    out = N.rebuild(after, X.chunks(before), N.manifest(before))
    return out.select("version", "page", "ordinal", "section", F.md5("content").alias("digest"))


@query("versions_missing", "SELECT v.version FROM (VALUES ('en'), ('it'), ('pt')) v(version) WHERE v.version NOT IN (SELECT lang FROM documents)")
def versions_missing(spark, sf):
    configured = spark.createDataFrame([("en",), ("it",), ("pt",)], "version string")
    return configured.join(table(spark, sf, "documents").select(F.col("lang").alias("version")).distinct(), "version", "left_anti")


@query("rows_of_all_extensions", "SELECT 'core' AS extension, count(*) AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source, count(*) FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def rows_of_all_extensions(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("guide-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("extensions/"), F.col("source"), F.lit("/x.adoc")))
    return table(spark, sf, "documents").groupBy(T.extension_of(path).alias("extension")).agg(F.count("*").alias("n"))


@query("group_by_extension", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'core' ELSE source END AS extension, count(*) AS paths, min(doc_id) AS first_id, max(doc_id) AS last_id, bit_xor(doc_id * 2654435761 % 4294967296) AS digest FROM documents GROUP BY 1")
def group_by_extension(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("guide-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("extensions/"), F.col("source"), F.lit("/x.adoc")))
    docs = table(spark, sf, "documents").select("doc_id", T.extension_of(path).alias("extension"))
    return docs.groupBy("extension").agg(F.count("*").alias("paths"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.bit_xor(F.col("doc_id") * 2654435761 % 4294967296).alias("digest"))


# ---- subjects ---------------------------------------------------------------------------------------------------------------

WORDS = ["security-intro", "kafka-guide", "rest-client", "cdi-reference", "misc-notes", "getting-started-1", "test-basics", "docker/build", "Hibernate-ORM", "cli-tooling"]


def _subject_paths(spark, sf) -> DataFrame:
    words = F.array(*[F.lit(w) for w in WORDS])
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("guides/"), F.get(words, (F.col("page_id") % len(WORDS)).cast("int")), F.lit("-"), F.col("page_id").cast("string"), F.lit(".adoc")).alias("path"))


SUBJECT_PATH_SQL = f"SELECT page_id, lower('guides/' || [{', '.join(repr(w) for w in WORDS)}][page_id % {len(WORDS)} + 1] || '-' || page_id || '.adoc') AS path FROM pages"
RULE_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(path, '{r}') THEN '{s}'" for s, r in J.RULES) + " ELSE 'misc' END"


@query("subject_by_path", f"WITH p AS ({SUBJECT_PATH_SQL}) SELECT page_id, {RULE_SQL} AS subject FROM p")
def subject_by_path(spark, sf):
    return _subject_paths(spark, sf).select("page_id", J.by_path(F.col("path")).alias("subject"))


@query("subject_counts", f"WITH p AS ({SUBJECT_PATH_SQL}), s AS (SELECT {RULE_SQL} AS name FROM p) SELECT n.name, count(s.name) AS docs FROM (VALUES {', '.join(f'({s[0]!r})' for s in J.SUBJECTS)}) n(name) LEFT JOIN s USING (name) GROUP BY n.name")
def subject_counts(spark, sf):
    return J.counts(_subject_paths(spark, sf).select(J.by_path(F.col("path")).alias("subject")))


@query("subjects_present", f"WITH p AS ({SUBJECT_PATH_SQL}) SELECT {RULE_SQL} AS name, count(*) AS docs FROM p GROUP BY ALL")
def subjects_present(spark, sf):
    return J.counts(_subject_paths(spark, sf).select(J.by_path(F.col("path")).alias("subject")), present=True)


VOTES = ["rest", "kafka", "oidc", "metrics", "unknown", "docker", "http", "jwt"]
TOPIC_VALUES = ", ".join(f"('{w}', '{s}')" for w, s in J.topic_table().items())


@query("subject_by_topic_vote", f"WITH t AS (SELECT doc_id, unnest([doc_id % 8, doc_id % 5, doc_id % 7, doc_id % 3]) AS k, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM documents), m AS (SELECT doc_id, pos, s.subject FROM t JOIN (VALUES {TOPIC_VALUES}) s(word, subject) ON s.word = [{', '.join(repr(v) for v in VOTES)}][k + 1]), v AS (SELECT doc_id, subject, count(*) AS n, min(pos) AS first FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM v) SELECT d.doc_id, coalesce(r.subject, 'misc') AS subject FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rn = 1")
def subject_by_topic_vote(spark, sf):
    words = F.array(*[F.lit(w) for w in VOTES])
    topics = F.array(*[F.get(words, (F.col("doc_id") % k).cast("int")) for k in (8, 5, 7, 3)])
    return table(spark, sf, "documents").select("doc_id", F.coalesce(J.by_topics(topics), F.lit(J.DEFAULT)).alias("subject"))


# ---- fuzzy titles -----------------------------------------------------------------------------------------------------------

ASKED = ["large", "large rod", "old polished rod", "small widgets of the blue ring", "brass"]
A, B = "q", "lower(p_name)"
ASKED_SQL = f"asked(q) AS (VALUES {', '.join(f'({q!r})' for q in ASKED)}), pairs AS (SELECT q, p_partkey, p_name FROM part, asked)"
LEV_SQL = f"(CASE WHEN {B} = {A} THEN 1 ELSE 1 - levenshtein({A}, {B})::DOUBLE / greatest(length({B}), length({A})) END)"
CONT_SQL = f"(CASE WHEN contains({B}, {A}) OR contains({A}, {B}) THEN least(length({B}), length({A}))::DOUBLE / greatest(length({B}), length({A})) ELSE 0 END)"


def words_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({c}, '[^a-z0-9]+'), lambda w: w <> ''))"


OVER_SQL = f"(len(list_intersect({words_sql(A)}, {words_sql(B)}))::DOUBLE / len(list_distinct(list_concat({words_sql(A)}, {words_sql(B)}))))"


def _titles(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, ASKED))).alias("q"))
    return part, F.col("q"), F.col("p_name")


@query("levenshtein_similarity", f"WITH {ASKED_SQL} SELECT q, p_partkey, round({LEV_SQL}, 6) AS score FROM pairs")
def levenshtein_similarity(spark, sf):
    part, a, b = _titles(spark, sf)
    return part.select("q", "p_partkey", F.round(Z.levenshtein_similarity(a, b), 6).alias("score"))


@query("containment", f"WITH {ASKED_SQL} SELECT q, p_partkey, round({CONT_SQL}, 6)::DOUBLE AS score FROM pairs")
def containment(spark, sf):
    part, a, b = _titles(spark, sf)
    return part.select("q", "p_partkey", F.round(Z.containment(a, b), 6).alias("score"))


@query("word_overlap", f"WITH {ASKED_SQL} SELECT q, p_partkey, round({OVER_SQL}, 6) AS score FROM pairs")
def word_overlap(spark, sf):
    part, a, b = _titles(spark, sf)
    return part.select("q", "p_partkey", F.round(Z.word_overlap(a, b), 6).alias("score"))


@query("combined_score", f"WITH {ASKED_SQL} SELECT q, p_partkey, round(0.4 * {LEV_SQL} + 0.35 * {CONT_SQL} + 0.25 * {OVER_SQL}, 5) AS score FROM pairs")
def combined_score(spark, sf):
    part, a, b = _titles(spark, sf)
    return part.select("q", "p_partkey", F.round(Z.combined(a, b), 5).alias("score"))


@query("best_title_match", f"WITH {ASKED_SQL}, s AS (SELECT q, p_partkey, p_name, {B} = {A} AS exact, CASE WHEN {B} = {A} THEN 1 ELSE 0.4 * {LEV_SQL} + 0.35 * {CONT_SQL} + 0.25 * {OVER_SQL} END AS score, {CONT_SQL} AS held, {OVER_SQL} AS shared FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact DESC, score DESC, p_partkey) AS rn FROM s) SELECT q, p_name AS value, round(score, 5) AS score, CASE WHEN exact THEN 'exact' WHEN held > 0.5 THEN 'partial' WHEN shared > 0.3 THEN 'keyword' ELSE 'partial' END AS match_type FROM r WHERE rn = 1 AND score >= 0.3")
def best_title_match(spark, sf):
    part, _, _ = _titles(spark, sf)
    return Z.best_match(part, ["q"], "q", "p_name", "p_partkey").select("q", "value", F.round("score", 5).alias("score"), "match_type")


# ---- sources and SQL functions ----------------------------------------------------------------------------------------------

@query("sql_functions", f"SELECT p_partkey, {SLUG_SQL.format('p_name')} AS slug, round({similarity_sql(trgm_sql('p_name'), trgm_sql(chr(39) + 'steel' + chr(39)))}, 6) AS score FROM part")
def sql_functions(spark, sf):
    from .functions.sqlfuncs import register

    register(spark)
    return table(spark, sf, "part").selectExpr("p_partkey", "slug(p_name) AS slug", "round(trgm_similarity(p_name, 'steel'), 6) AS score")


@query("sql_parse_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, ordinal::INT AS ordinal, title, start_line::INT AS start_line, end_line::INT AS end_line FROM sections")
def sql_parse_sections(spark, sf):
    from .functions.sqlfuncs import register

    register(spark)
    markup(spark, sf).createOrReplaceTempView("markup_docs")
    return spark.sql("SELECT doc_id, s.* FROM markup_docs, LATERAL parse_sections(content) s")


@query("sql_parse_code_blocks", ORACLES["parse_code_blocks"])
def sql_parse_code_blocks(spark, sf):
    from .functions.sqlfuncs import register

    register(spark)
    markup(spark, sf).createOrReplaceTempView("markup_docs")
    return spark.sql("SELECT doc_id, b.start_line, b.end_line, md5(b.content) AS digest FROM markup_docs, LATERAL parse_code_blocks(content) b")


@query("sql_rank", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked")
def sql_rank(spark, sf):
    """The rank of two lexemes from their positions, in SQL."""
    from .functions.sqlfuncs import register

    register(spark)
    index_of(spark, sf).where(F.col("lexeme").isin(PAIR)).createOrReplaceTempView("stored_postings")
    return spark.sql(f"SELECT x.chunk_id, round(ts_rank_pair(x.positions, y.positions), 6) AS score FROM stored_postings x JOIN stored_postings y ON x.chunk_id = y.chunk_id AND x.lexeme = '{PAIR[0]}' AND y.lexeme = '{PAIR[1]}'")


@query("parser_sections", ORACLES["parse_sections"])
def parser_sections(spark, sf):
    """Sections by the parser that is registered for the path's suffix."""
    from .operators import parsers

    return parsers.section_rows(markup(spark, sf), ["doc_id"]).select("doc_id", "ordinal", "title", "start_line", "end_line")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


RAW_SQL = "SELECT lang AS version, 'doc-' || doc_id || '.adoc' AS path, md5(text) AS digest FROM documents"


def _raw(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"), F.col("text").alias("content"))


@query("raw_documents", RAW_SQL)
def raw_documents(spark, sf):
    """Documents written and read again."""
    path = _folder(spark, "raw")
    W.write(_raw(spark, sf), path)
    return W.read_table(spark, path).select("version", "path", F.md5("content").alias("digest"))


@query("raw_paths", "SELECT 'doc-' || doc_id || '.adoc' AS path FROM documents WHERE lang = 'en'")
def raw_paths(spark, sf):
    return W.list_paths(_raw(spark, sf), "en")


PAGE_SQL = "'doc-' || doc_id || '.adoc'"


def _archives(spark, sf, names: list[Column]) -> str:
    """Archives of the documents, written by the tasks that read them, each document under some names (null: left out)."""
    path = _folder(spark, "archives")
    docs = table(spark, sf, "documents").select(F.explode(F.array(*names)).alias("name"), F.col("text").alias("content"))
    A_.write_archives(docs, path)
    return path


def _in(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


@query("archive_versions", f"SELECT v.version, {PAGE_SQL} AS path, md5(coalesce(text, '')) AS digest FROM documents, (VALUES ('3.1'), ('main')) v(version) WHERE v.version = 'main' OR doc_id % 2 = 0")
def archive_versions(spark, sf):
    """An archive serves all versions; what isn't a page of one of them is left."""
    i = F.col("doc_id").cast("string")
    names = [_in("repo/_versions/main/guides/doc-", i, ".adoc"), F.when(F.col("doc_id") % 2 == 0, _in("repo/_versions/3.1/guides/doc-", i, ".adoc")), _in("repo/_versions/9/guides/doc-", i, ".adoc"), _in("repo/doc-", i, ".txt")]
    return A_.versioned_docs(A_.entries(spark, _archives(spark, sf, names), ".adoc"), ["3.1", "main"]).select("version", "path", F.md5("content").alias("digest"))


@query("archive_extension", f"SELECT 'extensions/some/' || {PAGE_SQL} AS path, md5(coalesce(text, '')) AS digest FROM documents")
def archive_extension(spark, sf):
    i = F.col("doc_id").cast("string")
    names = [_in("repo-1/docs/modules/ROOT/pages/doc-", i, ".adoc"), _in("repo-1/docs/modules/other/pages/doc-", i, ".adoc"), _in("repo-1/readme-", i, ".md")]
    return A_.extension_docs(A_.entries(spark, _archives(spark, sf, names), ".adoc"), "some").select("path", F.md5("content").alias("digest"))


@query(
    "playbook_sources",
    """SELECT doc_id, 'one-' || doc_id AS name, source AS owner, 'one-' || doc_id AS repo, CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE '2.' || doc_id || '.x' END AS branch, 'docs' AS start_path FROM documents WHERE doc_id % 7 <> 0
    UNION ALL SELECT doc_id, 'two', source, 'two', lang, '' FROM documents WHERE doc_id % 7 <> 0""",
)
def playbook_sources(spark, sf):
    """A playbook made of each document's columns, every seventh of them malformed: the sources of all, on the executors."""
    i = F.col("doc_id").cast("string")
    one = F.concat(F.lit('    - {url: "https://github.com/'), "source", F.lit("/one-"), i, F.lit('.git", branches: [HEAD, "/x/", '), F.when(F.col("doc_id") % 3 == 0, '"v*"').otherwise(F.concat(F.lit('"2.'), i, F.lit('.x"'))), F.lit("], start_path: docs}\n"))
    two = F.concat(F.lit('    - {url: "https://github.com/'), "source", F.lit('/two", branches: '), "lang", F.lit('}\n    - {url: "https://elsewhere.org/a/three"}\n'))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("content: [\n"), i)).otherwise(F.concat(F.lit("content:\n  sources:\n"), one, two))
    return P.sources_of(table(spark, sf, "documents").select("doc_id", text.alias("playbook")), "doc_id", "playbook")


@query("component_titles", "SELECT doc_id, CASE WHEN doc_id % 5 NOT IN (0, 1) THEN 'Part ' || source || ' ' || doc_id END AS title FROM documents")
def component_titles(spark, sf):
    """The title of a descriptor made for each document; blank and malformed ones have none."""
    i = F.col("doc_id")
    text = F.when(i % 5 == 0, "title: '  '").when(i % 5 == 1, "title: [").otherwise(F.concat(F.lit("name: x\ntitle: '  Part "), "source", F.lit(" "), i.cast("string"), F.lit(" '\n")))
    return P.titles_of(table(spark, sf, "documents").select("doc_id", text.alias("descriptor")), "doc_id", "descriptor")


@query("manifest_json", "SELECT 'item-' || doc_id || '.adoc' AS path, md5(text) AS sha FROM documents WHERE doc_id % 4 <> 0")
def manifest_json(spark, sf):
    """A JSON manifest of a file for each document, with fields that aren't known; paths lose their prefix, other files go."""
    path = _folder(spark, "manifest")
    name = F.concat(F.lit("item-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".adoc"))
    row = F.struct(name.alias("name"), F.concat(F.lit("docs/"), name).alias("path"), F.md5("text").alias("sha"), F.lit(1).alias("size"))
    table(spark, sf, "documents").select(F.to_json(row).alias("value")).write.text(path)
    return P.manifest_paths(P.read_manifest(spark, path, lines=True), "docs/")


@query("store_dropped", "SELECT lang AS version, count(*) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY lang")
def store_dropped(spark, sf):
    """All versions dropped, and others stored after it: nothing of the first is left."""
    store, docs = I.IndexStore(spark, _folder(spark, "store")), table(spark, sf, "documents").select("doc_id", "lang")
    for v in ("fr", "en"):
        store.replace(v, {"docs": docs.where(F.col("lang") == v)})
    store.drop_all()
    for v in ("de", "en"):
        store.replace(v, {"docs": docs.where(F.col("lang") == v)})
    versions = store.versions("docs")
    held = [store.read("docs", v) for v in versions]
    return functools.reduce(DataFrame.unionByName, held).groupBy("version").agg(F.count("*").alias("n"))


STORED_SQL = "SELECT lang AS version, 'doc-' || doc_id || '.adoc' AS path, md5(text) AS sha FROM documents WHERE lang IN ('en', 'fr')"


def _rows_of_documents(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").where("lang in ('en', 'fr')")
    return docs.select(F.col("lang").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"), F.col("text").alias("content"), F.col("source").alias("extension"), F.lit(1).cast("long").alias("seq"))


@query("warm_up", STORED_SQL)
def warm_up(spark, sf):
    """Versions loaded where they aren't there yet; one whose source fails is reported, and the others are loaded."""
    from .plans.api import Status
    from .streaming import refresh

    store, status, rows = I.IndexStore(spark, _folder(spark, "store")), Status(), _rows_of_documents(spark, sf)

    def load(v: str) -> DataFrame:
        if v == "none":
            raise OSError("no such source")
        return rows.where(F.col("version") == v)

    refresh.warm_up(store, load, ["en", "none", "fr"], status)
    assert status.report() == (200, {"ready": True, "total": 3, "completed": 2, "failed": ["none"]})
    return functools.reduce(DataFrame.unionByName, [store.read("manifest", v).select("version", "path", "sha") for v in store.versions("manifest")])


@query("refresh_stream", STORED_SQL)
def refresh_stream(spark, sf):
    """Documents arrive as files of a stream, some twice in other forms: the last one of each path is held."""
    from .streaming import refresh

    rows, source, store = _rows_of_documents(spark, sf), _folder(spark, "arrived"), I.IndexStore(spark, _folder(spark, "store"))
    old = rows.where(F.crc32(F.col("path").cast("binary")) % 3 == 0).withColumns({"content": F.concat("content", F.lit(" before")), "seq": F.lit(0).cast("long")})
    rows.unionByName(old).write.parquet(source)
    refresh.refresh_stream(spark, source, store, _folder(spark, "stream-state")).awaitTermination()
    return functools.reduce(DataFrame.unionByName, [store.read("manifest", v).select("version", "path", "sha") for v in store.versions("manifest")])


@query("store_tables", "SELECT lang AS version, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def store_tables(spark, sf):
    """A version's table replaced, another appended to, a third deleted."""
    store, docs = I.IndexStore(spark, _folder(spark, "store")), table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    store.replace("en", {"docs": docs.where("doc_id < 0")})
    store.replace("en", {"docs": docs.where("lang = 'en'")})
    store.replace("fr", {"docs": docs.where("lang = 'fr' AND doc_id % 2 = 0")})
    store.append("docs", "fr", docs.where("lang = 'fr' AND doc_id % 2 <> 0"))
    store.replace("de", {"docs": docs})
    store.delete("docs", "de")
    parts = [store.read("docs", v) for v in store.versions("docs")]
    return parts[0].unionByName(parts[1]).groupBy("version").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("refresh_version", "SELECT 'en' AS version, 'doc-' || doc_id || '.adoc' AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS sha FROM documents WHERE lang = 'en' AND doc_id % 13 <> 0")
def refresh_version(spark, sf):
    """A version loaded, then refreshed from a listing in which pages changed, came and went."""
    from .streaming import refresh

    store, i = I.IndexStore(spark, _folder(spark, "store")), F.col("doc_id")
    docs = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.concat(F.lit("doc-"), i.cast("string"), F.lit(".adoc")).alias("path"), F.col("text").alias("content"), F.col("source").alias("extension"))
    refresh.refresh_version(store, "en", docs.where(i % 10 != 0))
    refresh.refresh_version(store, "en", docs.where(i % 13 != 0).withColumn("content", F.when(i % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))))
    pages = store.read("chunks", "en").select(F.concat("page", F.lit(".adoc")).alias("path")).distinct()
    return store.read("manifest", "en").join(pages, "path", "left_semi").select("version", "path", "sha")


# ---- documents, tags, subjects ------------------------------------------------------------------------------------------------

@query("page_first_tags", "SELECT 'doc-' || doc_id AS page, lang AS subject, source AS extension FROM documents")
def page_first_tags(spark, sf):
    m = markup(spark, sf)
    pages = m.select("version", T.page_name(F.col("path")).alias("page"))
    return D.with_tags(pages, X.chunks(m)).select("page", "subject", "extension")


@query("page_chunks", f"WITH {SECTIONS_SQL} SELECT ordinal::INT AS ordinal, title AS section FROM sections WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en') ORDER BY ordinal LIMIT 1000")
def page_chunks(spark, sf):
    first = table(spark, sf, "documents").where("lang = 'en'").agg(F.min("doc_id")).first()[0]
    return D.page_chunks(X.chunks(markup(spark, sf).where(F.col("doc_id") == first)), "en", f"doc-{first}").select("ordinal", "section")


@query("select_fields", f"WITH {CORPUS_SQL} SELECT chunk_id, page FROM corpus")
def select_fields(spark, sf):
    return D.select_fields(plain(spark, sf), "page, chunk_id")


CATEGORY_WORDS = ["unknown", "Web", " data ", "nothing", "messaging", "core"]
CATEGORY_VALUES = ", ".join(f"('{c}', '{s}')" for c, s in J.CATEGORIES.items())


def first_category_sql(places: str) -> str:
    words = f"[{', '.join(repr(w) for w in CATEGORY_WORDS)}]"
    return f"cat AS (SELECT doc_id, arg_min(v.subject, pos) AS subject FROM (SELECT doc_id, unnest({places}) AS k, generate_subscripts({places}, 1) AS pos FROM documents) t JOIN (VALUES {CATEGORY_VALUES}) v(word, subject) ON v.word = lower(trim({words}[k + 1])) GROUP BY doc_id)"


def _categories():
    words = F.array(*[F.lit(w) for w in CATEGORY_WORDS])
    return F.array(*[F.get(words, (F.col("doc_id") % k).cast("int")) for k in (4, 6, 5)])


@query("subject_by_category", f"WITH {first_category_sql('[doc_id % 4, doc_id % 6, doc_id % 5]')} SELECT d.doc_id, coalesce(cat.subject, 'misc') AS subject FROM documents d LEFT JOIN cat USING (doc_id)")
def subject_by_category(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(J.by_categories(_categories()), F.lit(J.DEFAULT)).alias("subject"))


OVERRIDES = {"guides/security-intro-10.adoc": "cloud", "guides/kafka-*-?1.adoc": "tooling", "**/{cli,docker}*7.adoc": "extensions", "guides/[g-h]*2?.adoc": "messaging"}


@query("derive_subject", f"""WITH t AS (SELECT doc_id, unnest([doc_id % 8, doc_id % 5, doc_id % 7]) AS k, generate_subscripts([1, 2, 3], 1) AS pos FROM documents WHERE doc_id % 3 = 0),
m AS (SELECT doc_id, pos, s.subject FROM t JOIN (VALUES {TOPIC_VALUES}) s(word, subject) ON s.word = [{', '.join(repr(v) for v in VOTES)}][k + 1]), v AS (SELECT doc_id, subject, count(*) AS n, min(pos) AS first FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM v),
{first_category_sql('[doc_id % 4, doc_id % 6, doc_id % 5]')},
p AS (SELECT doc_id, lower('guides/' || [{', '.join(repr(w) for w in WORDS)}][doc_id % {len(WORDS)} + 1] || '-' || doc_id || '.adoc') AS path FROM documents)
SELECT p.doc_id, CASE WHEN path = 'guides/security-intro-10.adoc' THEN 'cloud' WHEN regexp_full_match(path, 'guides/kafka-[^/]*-[^/]1\\.adoc') THEN 'tooling' WHEN regexp_full_match(path, '.*/(cli|docker)[^/]*7\\.adoc') THEN 'extensions' WHEN regexp_full_match(path, 'guides/[g-h][^/]*2[^/]\\.adoc') THEN 'messaging'
  ELSE coalesce(CASE WHEN p.doc_id % 2 = 0 THEN cat.subject END, r.subject, {RULE_SQL}) END AS subject
FROM p LEFT JOIN cat ON cat.doc_id = p.doc_id LEFT JOIN r ON r.doc_id = p.doc_id AND rn = 1""")
def derive_subject(spark, sf):
    """All six steps: exact and glob overrides, categories, topics, path rules, the default."""
    i, words, votes = F.col("doc_id"), F.array(*map(F.lit, WORDS)), F.array(*map(F.lit, VOTES))
    path = F.concat(F.lit("guides/"), F.get(words, (i % len(WORDS)).cast("int")), F.lit("-"), i.cast("string"), F.lit(".adoc"))
    topics = F.when(i % 3 == 0, F.array(*[F.get(votes, (i % k).cast("int")) for k in (8, 5, 7)])).otherwise(F.array().cast("array<string>"))
    categories = F.when(i % 2 == 0, _categories()).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", J.derive(path, categories, topics, OVERRIDES).alias("subject"))


GLOBS = {"guides/*.adoc": r"guides/[^/]*\.adoc", "**/kafka-*": ".*/kafka-[^/]*", "guides/{rest,cli}-?*.adoc": r"guides/(rest|cli)-[^/][^/]*\.adoc", "guides/[!a-k]*": "guides/[^a-k][^/]*", "*.adoc": r"[^/]*\.adoc"}


@query("glob_match", f"WITH p AS ({SUBJECT_PATH_SQL}), g(path_glob, pattern) AS (VALUES " + ", ".join(f"('{g}', '{r}')" for g, r in GLOBS.items()) + ") SELECT path_glob, count(*) FILTER (regexp_full_match(path, pattern)) AS n FROM p, g GROUP BY path_glob")
def glob_match(spark, sf):
    paths = _subject_paths(spark, sf).select(F.lower("path").alias("path"))
    hit = F.array(*[F.struct(F.lit(g).alias("path_glob"), F.col("path").rlike(f"^(?:{J.glob_to_regex(g)})$").alias("hit")) for g in GLOBS])
    return paths.select(F.explode(hit).alias("g")).groupBy("g.path_glob").agg(F.count_if("g.hit").alias("n"))


# ---- the service --------------------------------------------------------------------------------------------------------------

def _service(spark, sf) -> Service:
    chunks = corpus(spark, sf).where("version = 'en'").withColumn("title", F.lit("")).withColumn("summary", F.lit("")).withColumn("ordinal", F.lit(0))
    return Service(markup(spark, sf).select("version", "path", "content", "extension"), chunks, index_of(spark, sf))


@query("service_search", f"{and_sql(PAIR)} SELECT chunk_id, score FROM ranked WHERE list_contains(extensions, 'src0') ORDER BY score DESC, chunk_id LIMIT 5")
def service_search(spark, sf):
    page, _ = _service(spark, sf).search(" ".join(PAIR), version="en", extension="src0", limit=5, fields="chunk_id,score")
    return page.select("chunk_id", F.round("score", 6).alias("score"))


@query("service_documents", f"{and_sql(PAIR)} SELECT 'doc-' || r.chunk_id || '.adoc' AS path, score FROM (SELECT * FROM ranked ORDER BY score DESC, chunk_id LIMIT 5) r JOIN corpus c ON c.chunk_id = r.chunk_id WHERE list_contains(c.topics, 'en')")
def service_documents(spark, sf):
    page, _ = _service(spark, sf).documents(" ".join(PAIR), version="en", limit=5, fields="path,score")
    return page.select("path", F.round("score", 6).alias("score"))


@query("service_documents_full", f"{and_sql(PAIR)} SELECT 'doc-' || r.chunk_id || '.adoc' AS path, score, 'Doc ' || r.chunk_id AS title FROM (SELECT * FROM ranked ORDER BY score DESC, chunk_id LIMIT 5) r")
def service_documents_full(spark, sf):
    """Whole documents are given for five hits at most, whatever the limit."""
    page, info = _service(spark, sf).documents(" ".join(PAIR), version="en", brief=False, limit=100)
    assert info["limit"] == 5
    return page.where("sections is not null").select("path", F.round("score", 6).alias("score"), "title")


@query("service_document", "SELECT 'doc-' || doc_id || '.adoc' AS path, 'Doc ' || doc_id AS title, 'en' AS subject, source AS extension FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE lang = 'en')")
def service_document(spark, sf):
    """One document by its path."""
    last = table(spark, sf, "documents").where("lang = 'en'").agg(F.max("doc_id")).first()[0]
    return _service(spark, sf).document(f"doc-{last}.adoc", version="en", fields="path,title,subject,extension")


@query("service_batch", "SELECT q.pos, q.path, CASE WHEN d.doc_id IS NOT NULL THEN 'Doc ' || d.doc_id END AS title, CASE WHEN d.doc_id IS NULL THEN 'Document not found' END AS error FROM (SELECT 0 AS pos, 'doc-' || min(doc_id) || '.adoc' AS path FROM documents WHERE lang = 'en' UNION ALL SELECT 1, 'none.adoc') q LEFT JOIN documents d ON 'doc-' || d.doc_id || '.adoc' = q.path")
def service_batch(spark, sf):
    first = table(spark, sf, "documents").where("lang = 'en'").agg(F.min("doc_id")).first()[0]
    return _service(spark, sf).batch([f"doc-{first}.adoc", "none.adoc"], version="en", brief=True, fields="title")[0].orderBy("pos")


@query("service_related", f"WITH {CORPUS_SQL}, s AS (SELECT version, topics AS st, extensions AS se, page AS own FROM corpus WHERE chunk_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en')), r AS (SELECT c.page, (len(list_intersect(s.st, c.topics)) + len(list_intersect(s.se, c.extensions)))::DOUBLE / (len(s.st) + len(s.se)) AS similarity FROM corpus c JOIN s USING (version) WHERE c.page <> s.own AND list_contains(c.extensions, 'src2')) SELECT page, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.05 ORDER BY r.similarity DESC, page LIMIT 20")
def service_related(spark, sf):
    first = table(spark, sf, "documents").where("lang = 'en'").agg(F.min("doc_id")).first()[0]
    return _service(spark, sf).related(f"doc-{first}.adoc", version="en", limit=20, extension="src2", fields="page,similarity").select("page", F.round("similarity", 6).alias("similarity"))


@query("service_catalog", f"WITH {CORPUS_SQL}, u AS (SELECT page, 'subject' AS kind, unnest(topics) AS name FROM corpus WHERE version = 'en' UNION ALL SELECT page, 'extension', unnest(extensions) FROM corpus WHERE version = 'en') SELECT kind, name, count(DISTINCT page) AS pages FROM u GROUP BY ALL")
def service_catalog(spark, sf):
    got = _service(spark, sf).catalog("en")
    rows = [("subject", x["name"], x["docCount"]) for x in got["subjects"]] + [("extension", x["name"], x["docCount"]) for x in got["extensions"]]
    return spark.createDataFrame(rows, "kind string, name string, pages long")


@query("search_weighted", f"{and_sql(PAIR)}, s AS (SELECT c.chunk_id, 0.7 * coalesce(r.score, 0) / (SELECT max(score) FROM ranked) + 0.3 * {similarity_sql(trgm_sql('c.page'), trgm_sql(chr(39) + ' '.join(PAIR) + chr(39)))} AS score FROM corpus c LEFT JOIN ranked r ON r.chunk_id = c.chunk_id WHERE c.version = 'en') SELECT chunk_id, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, chunk_id LIMIT 5")
def search_weighted(spark, sf):
    chunks = plain(spark, sf).where("version = 'en'").withColumn("title", F.col("page"))
    return S.combined(chunks, index_of(spark, sf), " ".join(PAIR), limit=5).select("chunk_id", F.round("score", 4).alias("score"))
