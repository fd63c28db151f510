"""Incremental refresh: manifests, their differences, tombstones, and rebuilding only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sections as X


def manifest(raw: DataFrame) -> DataFrame:
    return raw.select("version", "path", F.md5("content").alias("sha"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``: partial aggregation instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def changed(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("version", "path")) -> DataFrame:
    """Keys, sha and status (added, modified) of rows that are new or whose sha differs."""
    before = old.select(*keys, F.col("sha").alias("old_sha"))
    met = new.join(before, list(keys), "left").where(~F.col("sha").eqNullSafe(F.col("old_sha")))
    return met.select(*keys, "sha", F.when(F.col("old_sha").isNull(), "added").otherwise("modified").alias("status"))


def removed(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("version", "path")) -> DataFrame:
    return old.join(new, list(keys), "left_anti").select(*keys)


def any_changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row per version: whether anything was added, modified or removed."""
    both = new.select("version", "path", "sha").join(old.select("version", "path", F.col("sha").alias("old_sha")), ["version", "path"], "full")
    return both.groupBy("version").agg(F.coalesce(F.bool_or(~F.col("sha").eqNullSafe(F.col("old_sha"))), F.lit(False)).alias("changed"))


def rebuild(raw: DataFrame, old_chunks: DataFrame, old_manifest: DataFrame, **options) -> DataFrame:
    """The chunk table of ``raw``: chunks of unchanged pages are kept, changed pages are parsed, removed ones go.

    Equal to parsing everything; only changed texts are read by the parser. All extensions of a version are one pass.
    """
    now = manifest(raw)
    moved = changed(now, old_manifest)
    page = lambda df: df.select("version", T.page_name(F.col("path")).alias("page"))
    stale = page(moved).union(page(removed(now, old_manifest)))
    kept = old_chunks.join(stale, ["version", "page"], "left_anti")
    fresh = X.chunks(raw.join(moved.select("version", "path"), ["version", "path"], "left_semi"), **options)
    return kept.unionByName(fresh)
