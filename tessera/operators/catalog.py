"""Facets and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_VALUES = 500


def facet(chunks: DataFrame, column: str, limit: int = MOST_VALUES) -> DataFrame:
    """value, pages: distinct pages per value of an array column, most first, ties by name."""
    out = chunks.select("page", F.explode(column).alias("value")).groupBy("value").agg(F.count_distinct("page").alias("pages"))
    return out.orderBy(F.desc("pages"), "value").limit(limit)


def extension_facet(chunks: DataFrame, titles: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """name, display_name, title ("" where there is none), pages. titles: name, title."""
    out = facet(chunks, "extensions").withColumnRenamed("value", "name").withColumn("display_name", T.display_name(F.col("name"), prefix))
    if titles is None:
        return out.withColumn("title", F.lit(""))
    return out.join(titles, "name", "left").withColumn("title", F.coalesce("title", F.lit("")))


def catalog(chunks: DataFrame, versions: list[str], titles: DataFrame | None = None) -> dict:
    """The catalog of one version as a plain dictionary; facets are bounded."""
    topics = facet(chunks, "topics").withColumn("display_name", T.display_name(F.col("value")))
    subjects = [{"name": r.value, "displayName": r.display_name, "docCount": r.pages} for r in topics.orderBy(F.desc("pages"), "value").collect()]
    extensions = [{"name": r["name"], "displayName": r.display_name, "title": r.title, "docCount": r.pages} for r in extension_facet(chunks, titles).orderBy(F.desc("pages"), "name").collect()]
    return {"subjects": subjects, "extensions": extensions, "versions": sorted(versions)}
