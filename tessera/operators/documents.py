"""Document retrieval: by path, in batches, by keywords, and projections of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.validate import InvalidInput, NotFound, batch_paths, keywords
from . import search as S
from . import sections as X

FULL_CAP, CHUNK_CAP = 5, 1000


def page_chunks(chunks: DataFrame, version: str, page: str) -> DataFrame:
    return chunks.where((F.col("version") == version) & (F.col("page") == page)).orderBy("ordinal").limit(CHUNK_CAP).withColumn("score", F.lit(0.0))


def with_tags(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """pages with the first subject and extension of each page's first chunk, left."""
    first = chunks.groupBy("version", "page").agg(F.min_by(F.struct("topics", "extensions"), "ordinal").alias("f"))
    first = first.select("version", "page", F.get("f.topics", F.lit(0)).alias("subject"), F.get("f.extensions", F.lit(0)).alias("extension"))
    return pages.join(first, ["version", "page"], "left")


def documents(raw: DataFrame, chunks: DataFrame, brief: bool = False) -> DataFrame:
    """version, path, page, title, description, subject, extension, and unless brief: sections and code blocks."""
    pages = raw.select("version", "path", "content", T.page_name(F.col("path")).alias("page"))
    out = X.with_description(with_tags(pages, chunks), F.col("content"))
    cols = [F.col("version"), F.col("path"), F.col("page"), X.document_title(F.col("content")).alias("title"), F.col("description"), F.col("subject"), F.col("extension"), F.array().cast("array<string>").alias("matched_keywords")]
    if brief:
        return out.select(*cols)
    keys = ["version", "path"]
    parts = X.section_rows(raw, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", "title", "level", "start_line", "end_line", "section_content"))).alias("sections"))
    code = X.code_blocks(raw, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", "language", "content", "context", "start_line", "end_line"))).alias("code_blocks"))
    return out.select(*cols).join(parts, keys, "left").join(code, keys, "left")


def by_path(raw: DataFrame, chunks: DataFrame, version: str, path: str) -> DataFrame:
    one = raw.where((F.col("version") == version) & (F.col("path") == path))
    if one.isEmpty():
        raise NotFound(f"Document not found: {path}")
    return documents(one, chunks)


def batch(raw: DataFrame, chunks: DataFrame, version: str, paths: list[str], brief: bool = False) -> tuple[DataFrame, dict]:
    """Requested paths in order, each with its document or an error, and the counters; an error if none is found."""
    wanted = batch_paths(paths)
    spark = raw.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "pos int, path string")
    some = raw.where(F.col("version") == version).join(F.broadcast(asked.select("path")), "path", "left_semi")
    out = asked.join(documents(some, chunks, brief), "path", "left").withColumn("error", F.when(F.col("page").isNull(), "Document not found"))
    got = out.agg(F.count("*").alias("requested"), F.count_if(F.col("error").isNull()).alias("retrieved"), F.count_if(F.col("error").isNotNull()).alias("errors")).first().asDict()
    if not got["retrieved"]:
        raise NotFound("No document found")
    return out.orderBy("pos"), got


def by_keywords(raw: DataFrame, chunks: DataFrame, posts: DataFrame, query: str, subject: str | None = None, extension: str | None = None, brief: bool = True, limit: int = S.DEFAULT_LIMIT, offset: int = 0, prefilter: bool = False) -> tuple[DataFrame, dict]:
    """Hits of a keyword search as documents. The subject filter works on the page of hits; prefilter puts it before."""
    text = " ".join(keywords(query))
    most = limit if brief else min(limit, FULL_CAP)
    source = chunks.where(F.array_contains("topics", subject)) if subject and prefilter else chunks
    page, total = S.search(source, posts, text, extension, most, offset)
    if subject and not prefilter:
        page = page.where(F.array_contains("topics", subject))
    hits = page.select("version", "page", F.concat("page", F.lit(".adoc")).alias("path"), "title", "summary", F.get("topics", F.lit(0)).alias("subject"), F.get("extensions", F.lit(0)).alias("extension"), "score")
    returned = hits.count()
    info = S.envelope(hits, total, most, offset, returned)
    if not brief:
        if total > FULL_CAP:
            info["warning"] = f"Full content is limited to {FULL_CAP} documents"
        keys = hits.select("version", "path", "score")
        hits = keys.join(documents(raw.join(F.broadcast(keys.select("version", "path").distinct()), ["version", "path"], "left_semi"), chunks), ["version", "path"])
    return hits, info


def select_fields(df: DataFrame, fields: str | None, kept: tuple[str, ...] = ()) -> DataFrame:
    """The named columns only, and those of the envelope; unknown names are an error that lists what there is."""
    if not fields or not fields.strip():
        return df
    names = [f.strip() for f in fields.split(",") if f.strip()]
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise InvalidInput(f"Unknown fields: {', '.join(unknown)}. Available: {', '.join(sorted(df.columns))}")
    return df.select(*[c for c in df.columns if c in names or c in kept])
