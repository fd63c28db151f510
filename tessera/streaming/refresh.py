"""Refresh as a stream: new document files are merged into the versions' tables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental as N
from ..operators import sections as X
from ..operators.index import IndexStore, postings

RAW = "version string, path string, content string, extension string, seq long"


COLUMNS = ["path", "content", "extension"]


SORTED = {"chunks": ["page", "ordinal"], "postings": ["lexeme"]}


def apply_changes(store: IndexStore, version: str, moved: DataFrame, gone: DataFrame) -> None:
    """New and changed documents (COLUMNS) and the paths that are gone, as segments of all tables, which turn at once: what
    is parsed, analyzed and written follows the change, not the version."""
    raw = moved.select(F.lit(version).alias("version"), *COLUMNS).persist()  # of a change, not of a version
    paths = raw.select("path").union(gone.select("path")).distinct().persist()
    fresh = X.chunks(raw).persist()
    try:
        pages = paths.select(T.page_name(F.col("path")).alias("page"))
        store.update(version, {"raw": (["path"], raw, paths), "manifest": (["path"], N.manifest(raw), paths), "chunks": (["page"], fresh, pages), "postings": (["page"], postings(fresh, ["page", "ordinal"]), pages)}, SORTED)
    finally:
        for df in (fresh, paths, raw):
            df.unpersist()
    store.compact(version)


def _whole(store: IndexStore, version: str) -> bool:
    return all(store.read(t, version) is not None for t in ("raw", "manifest", "chunks", "postings"))


def refresh_version(store: IndexStore, version: str, raw: DataFrame) -> bool:
    """All documents of a version, as they are now: changed pages are parsed and analyzed, removed ones go, and nothing else
    is written. False if nothing changed."""
    raw = raw.select(F.lit(version).alias("version"), *COLUMNS)
    if not _whole(store, version):
        table = X.chunks(raw)
        first = {"raw": (["path"], raw), "manifest": (["path"], N.manifest(raw)), "chunks": (["page"], table), "postings": (["page"], postings(table, ["page", "ordinal"]))}
        store.update(version, {k: (*v, None) for k, v in first.items()}, SORTED)
        return True
    now, before = N.manifest(raw), store.read("manifest", version)
    moved, gone = N.changed(now, before), N.removed(now, before)
    if moved.isEmpty() and gone.isEmpty():
        return False
    apply_changes(store, version, raw.join(moved.select("path"), "path", "left_semi"), gone)
    return True


def _held(store: IndexStore, version: str) -> DataFrame | None:
    old = store.read("raw", version)
    return None if old is None else old.select(*COLUMNS)


def refresh_batch(store: IndexStore, arrived: DataFrame) -> list[str]:
    """The latest row of each arrived path is merged; one without content removes the path. Of the version, only the
    manifest's rows of the arrived paths are read. Returns the versions that changed."""
    fresh = N.latest(arrived, ["version", "path"], "seq")
    turned = []
    for (version,) in sorted(fresh.select("version").distinct().collect()):  # versions are configured, and few
        mine = fresh.where(F.col("version") == version).select("version", *COLUMNS)
        raw = mine.where("content is not null")
        if not _whole(store, version):
            if refresh_version(store, version, raw):
                turned.append(version)
            continue
        known = store.read("manifest", version).join(mine.select("path"), "path", "left_semi")
        moved, gone = N.changed(N.manifest(raw), known), known.join(mine.where("content is null").select("path"), "path", "left_semi")
        if not (moved.isEmpty() and gone.isEmpty()):
            apply_changes(store, version, raw.join(moved.select("path"), "path", "left_semi"), gone)
            turned.append(version)
    return turned


def refresh_extension(store: IndexStore, version: str, extension: str, listing: DataFrame) -> bool:
    """All documents of one source, as they are now; those of other sources stay as they are."""
    mine, old = listing.select("path", "content", F.lit(extension).alias("extension")), _held(store, version)
    return refresh_version(store, version, mine if old is None else old.where(~F.col("extension").eqNullSafe(F.lit(extension))).unionByName(mine))


def refresh_extensions(store: IndexStore, version: str, sources: dict[str, Callable[[], DataFrame]]) -> dict[str, bool | str]:
    """Each source in turn: whether it changed, or why it failed; a failure doesn't stop the others."""
    out: dict[str, bool | str] = {}
    for extension, load in sources.items():
        try:
            out[extension] = refresh_extension(store, version, extension, load())
        except Exception as e:  # reported, and the next source is refreshed
            out[extension] = str(e)
    return out


def refresh_stream(spark: SparkSession, source: str, store: IndexStore, checkpoint: str, once: bool = True, seen: Callable[[list[str]], None] | None = None):
    """A Structured Streaming query over Parquet files of RAW rows; once: what there is, then stop."""

    def merge(batch: DataFrame, _: int) -> None:
        turned = refresh_batch(store, batch)
        if seen:
            seen(turned)

    stream = spark.readStream.schema(RAW).parquet(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="6 hours")).start()


def warm_up(store: IndexStore, load: Callable[[str], DataFrame], versions: list[str], status) -> None:
    """Versions that aren't there yet are loaded; one that fails doesn't stop the others."""
    have = set(store.versions("chunks"))
    status.total = len(versions)
    for v in versions:
        error = None
        if v not in have:
            try:
                refresh_batch(store, load(v))
            except Exception as e:  # one version's failure is reported, and the next is loaded
                error = str(e)
        status.finish(v, error)
