"""Ranked search over postings, with the fuzzy fallback, filters and pages."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import parser as P
from . import index as I
from . import trigrams as G

THRESHOLD = 0.1
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


@dataclass(frozen=True)
class Analyzer:
    """How texts become postings, and queries lexemes. posts(df, keys, content, only): only the lexemes of one query, if given."""

    query: Callable[[str], list[str]]
    posts: Callable[..., DataFrame]


RULE = Analyzer(lambda q: list(dict.fromkeys(map(T.stem_word, T.tokens(q)))), I.postings)
ENGLISH = Analyzer(P.query_lexemes, P.postings)


def ranked(posts: DataFrame, lexemes: list[str], doc_keys: list[str]) -> DataFrame:
    """doc_keys, score, for the documents that hold every lexeme. The lexemes reach the scan of stored postings as a filter;
    the rank of several combines all pairs of their positions, 1 - prod(1 - w), as a sum of logarithms."""
    item = F.struct("lexeme", "tf", "positions")
    got = posts.where(F.col("lexeme").isin(lexemes)).groupBy(*doc_keys).agg(F.sort_array(F.collect_list(item)).alias("held"))
    return got.where(F.size("held") == len(lexemes)).select(*doc_keys, rank(F.col("held")).alias("score"))


def ranked_texts(chunks: DataFrame, query: str, doc_keys: list[str], analyzer: Analyzer = RULE, content: str = "content") -> DataFrame:
    """ranked() where nothing is stored: of the texts, only what the query needs is analyzed."""
    lexemes = analyzer.query(query)
    return ranked(analyzer.posts(chunks, doc_keys, content, lexemes), lexemes, doc_keys)


def many(queries: DataFrame, posts: DataFrame, query_keys: list[str], doc_keys: list[str]) -> DataFrame:
    """query_keys, doc_keys for the documents that hold every lexeme of a query, for many queries at once.

    queries: query_keys, lexemes. A query meets the postings of its rarest lexeme alone; the other lexemes are then looked
    up for those documents, so that frequent words cost their candidates, not their postings.
    """
    asked = queries.select(*query_keys, F.explode(F.array_distinct("lexemes")).alias("lexeme"), F.size(F.array_distinct("lexemes")).alias("n"))
    sizes = posts.groupBy("lexeme").agg(F.count("*").alias("df"))
    sized = asked.join(sizes, "lexeme", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = sized.groupBy(*query_keys).agg(F.min(F.struct("df", "lexeme")).alias("r"), F.first("n").alias("n")).where("r.df > 0")
    met = rarest.select(*query_keys, "n", F.col("r.lexeme").alias("lexeme")).join(posts.select("lexeme", *doc_keys), "lexeme").drop("lexeme")
    rest = met.join(asked.select(*query_keys, "lexeme"), query_keys).join(posts.select("lexeme", *doc_keys), ["lexeme", *doc_keys])
    return rest.groupBy(*query_keys, *doc_keys).agg(F.count("*").alias("held"), F.first("n").alias("n")).where("held = n").select(*query_keys, *doc_keys)


def rank(held: Column) -> Column:
    """The rank of a document: held is an array of (lexeme, tf, positions), one for each lexeme."""
    n = F.size(held)
    one = I.rank_one(F.get(held, F.lit(0))["tf"])

    def pair_sum(x: Column, y: Column) -> Column:
        per = F.transform(x["positions"], lambda p: F.aggregate(y["positions"], F.lit(0.0), lambda a, q: a + F.when(p == q, 0.0).otherwise(F.log1p(-I.pair_weight(F.abs(p - q))))))
        return F.aggregate(per, F.lit(0.0), lambda a, v: a + v)

    places = F.sequence(F.lit(0), n - 1)
    sums = F.transform(places, lambda i: F.aggregate(F.filter(places, lambda j: j > i), F.lit(0.0), lambda a, j: a + pair_sum(F.get(held, i), F.get(held, j))))
    many = 1.0 - F.exp(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v))
    return F.when(n == 1, one).otherwise(many)


def fuzzy(chunks: DataFrame, query: str, content: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """chunks whose content's trigrams are like the query's, with the score.

    Sets of more than n / threshold trigrams, n the query's, can't reach the threshold: where a text's beginning has as many,
    the text isn't looked at whole.
    """
    asked = sorted(T.trigram_set(query))
    few = F.size(T.head_trigrams(F.col(content))) < len(asked) / threshold
    score = T.similarity(T.trigrams(F.col(content)), F.array(*map(F.lit, asked)).cast("array<string>"))
    return chunks.withColumn("score", F.when(few, score).otherwise(0.0)).where(F.col("score") > threshold)


def search(chunks: DataFrame, posts: DataFrame, query: str, extension: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0, fuzzy_respects_filters: bool = False, analyzer: Analyzer = RULE, trigrams: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The page of hits (chunk columns and score) and the total. posts: stored postings under the analyzer; trigrams: the
    stored trigram index of the chunks, from which the fuzzy search answers; without it, it looks at the texts.

    Without any ranked hit on the first page the fuzzy search answers: it leaves the extension filter out unless told
    otherwise, and its total is its number of rows.
    """
    hits = chunks.join(ranked(posts, analyzer.query(query), ["chunk_id"]), "chunk_id")
    if extension:
        hits = hits.where(F.array_contains("extensions", extension))
    total = hits.select("chunk_id").count()
    page = hits.orderBy(F.desc("score"), "chunk_id").offset(offset).limit(limit)
    if total == 0 and offset == 0:
        source = chunks.where(F.array_contains("extensions", extension)) if extension and fuzzy_respects_filters else chunks
        like = fuzzy(source, query) if trigrams is None else source.join(G.similar(trigrams, query, THRESHOLD), "chunk_id")
        page = like.orderBy(F.desc("score"), "chunk_id").limit(limit)
        total = page.count()
    return page, total


def combined(chunks: DataFrame, posts: DataFrame, query: str, weight: float = 0.7, limit: int = DEFAULT_LIMIT, analyzer: Analyzer = RULE) -> DataFrame:
    """Ranked and fuzzy scores in one: weight of the rank over its largest, the rest of the title's trigram similarity."""
    found = ranked(posts, analyzer.query(query), ["chunk_id"])
    best = found.agg(F.max("score")).first()[0] or 1.0
    title = T.similarity(T.trigrams(F.coalesce("title", F.lit(""))), F.array(*map(F.lit, sorted(T.trigram_set(query)))).cast("array<string>"))
    both = chunks.join(found, "chunk_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) / best * weight + title * (1 - weight))
    return both.where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(limit)


def page_info(total: Column, limit: int, offset: int) -> list[Column]:
    """An envelope's columns from the total alone."""
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset))
    return [total.alias("total_count"), returned.cast("long").alias("returned_count"), (offset + returned < total).alias("has_more")]


def envelope(page: DataFrame, total: int, limit: int, offset: int, returned: int) -> dict:
    return {"totalCount": total, "returnedCount": returned, "offset": offset, "limit": limit, "hasMore": offset + returned < total}


def adjacent_rank() -> float:
    """The rank of two lexemes side by side, for tests."""
    return math.sqrt(0.01 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
