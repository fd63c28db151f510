"""Fuzzy title scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds of the combined score (fixed values).
WEIGHTS = (0.4, 0.35, 0.25)
THRESHOLD, PARTIAL, KEYWORD = 0.3, 0.5, 0.3


def levenshtein_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.coalesce(F.when(x == y, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    share = F.try_divide(F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y)))
    return F.coalesce(F.when(y.contains(x) | x.contains(y), share).otherwise(0.0), F.lit(0.0))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def combined(a: Column, b: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    l, c, w = weights
    return l * levenshtein_similarity(a, b) + c * containment(a, b) + w * word_overlap(a, b)


def match_type(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), "exact").when(containment(a, b) > PARTIAL, "partial").when(word_overlap(a, b) > KEYWORD, "keyword").otherwise("partial")


def best_match(candidates, query_cols: list[str], query: str, candidate: str, position: str, threshold: float = THRESHOLD):
    """The best candidate of each query: an exact one, else the best score, the first of equals; at least the threshold.

    One partial aggregation, no sort of all candidates.
    """
    q, c = F.col(query), F.col(candidate)
    exact = F.lower(q) == F.lower(c)
    scored = candidates.where(q.isNotNull() & c.isNotNull()).withColumn("score", F.when(exact, 1.0).otherwise(combined(q, c))).withColumn("exact", exact)
    best = F.max_by(F.struct(F.col(candidate).alias("value"), "score", match_type(q, c).alias("match_type")), F.struct("exact", F.when(F.col("exact"), 1.0).otherwise(F.col("score")), -F.col(position)))
    return scored.groupBy(*query_cols).agg(best.alias("best")).where(F.col("best.score") >= threshold).select(*query_cols, "best.value", "best.score", "best.match_type")
