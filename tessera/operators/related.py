"""Related pages by shared topics and extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, DEFAULT_LIMIT, MAX_LIMIT, MOST_SHARED = 0.05, 5, 20, 10


def page_tags(chunks: DataFrame) -> DataFrame:
    """version, page, and the union of its chunks' topics and extensions in order; title and summary of its first chunk."""
    first = F.min_by(F.struct("title", "summary"), "ordinal")
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", c))), lambda x: x[c])))
    return chunks.groupBy("version", "page").agg(listed("topics").alias("topics"), listed("extensions").alias("extensions"), first.alias("f")).select("version", "page", "topics", "extensions", "f.title", "f.summary")


def related(pages: DataFrame, page: str, limit: int = DEFAULT_LIMIT, exact: bool = True, subject: str | None = None, extension: str | None = None) -> DataFrame:
    """Pages that share most tags with ``page``; of a subject or an extension, if given. exact=False first cuts the
    candidates to the 3 limit first by name (at most 100), as a plain index scan would, and filters those."""
    source = pages.where(F.col("page") == page).select(F.col("version"), F.col("topics").alias("st"), F.col("extensions").alias("se"))
    met = pages.where(F.col("page") != page).join(F.broadcast(source.limit(1)), "version")
    met = met.where(F.coalesce(F.arrays_overlap("topics", "st"), F.lit(False)) | F.coalesce(F.arrays_overlap("extensions", "se"), F.lit(False)))
    if not exact:
        met = met.orderBy("page").limit(min(3 * limit, 100))
    for wanted, tags in ((subject, "topics"), (extension, "extensions")):
        if wanted:
            met = met.where(F.array_contains(tags, wanted))
    shared = F.concat(F.array_intersect("st", "topics"), F.array_intersect("se", "extensions"))
    score = F.try_divide(F.size(shared), F.size("st") + F.size("se"))
    met = met.select("version", "page", "title", score.alias("similarity"), F.slice(shared, 1, MOST_SHARED).alias("shared"))
    return met.where(F.col("similarity") >= LEAST).orderBy(F.desc("similarity"), "page").limit(limit)


def related_all(pages: DataFrame, k: int, rare: int = 100) -> DataFrame:
    """version, page, other, n_shared for the k pages of most shared tags of each page, ties by name.

    A tag of at most ``rare`` pages pairs these pages, which costs so many rows a page and tag at most. More frequent tags
    are few: pages with the same frequent tags are one class, classes meet over their tags, and only a class's k + 1 first
    pages by name can be among anyone's k best that share frequent tags alone - a page that shares a rare one as well is
    found by it, with all it shares, and stands before them. So no frequent tag's pages are paired with each other.
    """
    tags = F.array_distinct(F.concat(F.transform("topics", lambda x: F.concat(F.lit("t:"), x)), F.transform("extensions", lambda x: F.concat(F.lit("e:"), x))))
    rows = pages.select("version", "page", F.explode(tags).alias("tag"))
    frequent = rows.groupBy("version", "tag").agg((F.count("*") > rare).alias("frequent"))
    rows = rows.join(frequent, ["version", "tag"])
    held = rows.groupBy("version", "page").agg(F.array_sort(F.collect_set(F.when(F.col("frequent"), F.col("tag")))).alias("common"))
    held = held.withColumn("cls", F.xxhash64("version", "common"))
    return _best(_by_rare(rows.where("not frequent"), held).unionByName(_by_classes(held.where("size(common) > 0"), k)), k)


def _by_rare(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of pages that share a rare tag, with all that they share."""
    one, two = rows.select("version", "tag", "page"), rows.select("version", "tag", F.col("page").alias("other"))
    pairs = one.join(two, ["version", "tag"]).where("page <> other").groupBy("version", "page", "other").agg(F.count("*").alias("n"))
    mine, theirs = held.select("version", "page", F.col("common").alias("x")), held.select("version", F.col("page").alias("other"), F.col("common").alias("y"))
    both = pairs.join(mine, ["version", "page"]).join(theirs, ["version", "other"])
    return both.select("version", "page", "other", (F.col("n") + F.size(F.array_intersect("x", "y"))).alias("n_shared"))


def _by_classes(held: DataFrame, k: int) -> DataFrame:
    """For each page the k + 1 best first pages of classes, by frequent tags."""
    first = held.withColumn("rn", F.row_number().over(Window.partitionBy("cls", F.pmod(F.xxhash64("page"), F.lit(32))).orderBy("page"))).where(F.col("rn") <= k + 1)
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy("page"))).where(F.col("rn") <= k + 1).select("cls", F.col("page").alias("other"))
    exploded = held.select("version", "cls", "common").distinct().select("version", "cls", F.explode("common").alias("tag"))
    shared = exploded.join(exploded.select("version", "tag", F.col("cls").alias("cls2")), ["version", "tag"]).groupBy("cls", "cls2").agg(F.count("*").alias("n_shared"))
    near = shared.join(first.withColumnRenamed("cls", "cls2"), "cls2").select("cls", "other", "n_shared")
    best = Window.partitionBy("cls").orderBy(F.desc("n_shared"), "other")
    near = near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
    return held.select("version", "page", "cls").join(near, "cls").where(F.col("page") != F.col("other")).select("version", "page", "other", "n_shared")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    pairs = pairs.groupBy("version", "page", "other").agg(F.max("n_shared").alias("n_shared"))
    mine = Window.partitionBy("version", "page").orderBy(F.desc("n_shared"), "other")
    return pairs.withColumn("rn", F.row_number().over(mine)).where(F.col("rn") <= k).select("version", "page", "other", "n_shared")
