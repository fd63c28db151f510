"""Composite entry points over one version's tables, with validation, and the static descriptions of the service."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter2 import STOP
from ..operators import catalog as C
from ..operators import documents as D
from ..operators import related as R
from ..operators import search as S
from ..operators.subjects import SUBJECTS
from . import validate as V


@dataclass
class Status:
    """Progress of loading: which versions are there, and whether all are."""

    total: int = 0
    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def finish(self, version: str, error: str | None = None) -> None:
        with self._lock:
            if error is None:
                self.done.append(version)
            else:
                self.failed[version] = error

    def report(self) -> tuple[int, dict]:
        ready = self.total == len(self.done) + len(self.failed)
        body = {"ready": ready, "total": self.total, "completed": len(self.done), "failed": sorted(self.failed)}
        return (200 if ready else 503), {k: v for k, v in body.items() if v is not None}


class VersionCache:
    """The tables of the versions used lately, persisted; the one unused longest goes first."""

    def __init__(self, most: int):
        self.most, self._held, self._lock = most, OrderedDict(), threading.Lock()

    def get(self, version: str, build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        with self._lock:
            if version not in self._held:
                self._held[version] = tuple(df.persist() for df in build())
            self._held.move_to_end(version)
            while len(self._held) > self.most:
                self._drop(next(iter(self._held)))
            return self._held[version]

    def _drop(self, version: str) -> None:
        for df in self._held.pop(version, ()):
            df.unpersist()

    def invalidate(self, version: str | None = None) -> None:
        """To be called when a version is written; without one, all go."""
        with self._lock:
            for v in [version] if version else list(self._held):
                self._drop(v)


#: What each entry point takes: name, whether it is required, what it may be.
VERSION = ("version", False, "a loaded version; main by default")
LIMIT, OFFSET = ("limit", False, f"1 to {V.MAX_LIMIT}, {S.DEFAULT_LIMIT} by default"), ("offset", False, "0 or more, 0 by default")
FIELDS, EXTENSION, SUBJECT = ("fields", False, "names of result fields, separated by commas"), ("extension", False, "an extension's name"), ("subject", False, "one of the subjects")
ENDPOINTS = [
    ("root", "Where to begin: links to the other entry points.", []),
    ("meta", "This description: entry points, their parameters, filters, paging.", []),
    ("syntax", "How queries are read and ranked.", []),
    ("catalog", "Subjects, extensions and versions with their numbers of pages.", [VERSION]),
    ("search", "Chunks that hold all words of a query, best first; chunks with like spelling if there are none.", [("q", True, f"1 to {V.MAX_QUERY} characters"), VERSION, EXTENSION, LIMIT, OFFSET, FIELDS]),
    ("documents", "Documents by keywords, whole or in brief.", [("keywords", True, "words other than stop words"), VERSION, SUBJECT, EXTENSION, ("brief", False, "true by default"), LIMIT, OFFSET, FIELDS]),
    ("document", "One document with its sections and code blocks.", [("path", True, "a relative path"), VERSION, FIELDS]),
    ("batch", "Several documents by path, with an error for each that isn't there.", [("paths", True, f"at most {V.MAX_BATCH}"), VERSION, ("brief", False, "false by default"), FIELDS]),
    ("related", "Pages that share most topics and extensions with one.", [("path", True, "a relative path"), VERSION, SUBJECT, EXTENSION, ("limit", False, f"1 to {R.MAX_LIMIT}, {R.DEFAULT_LIMIT} by default"), FIELDS]),
    ("status", "How far loading has come.", []),
]


def total_count_header(info: dict) -> dict[str, str]:
    """The header that carries the total of a page of results."""
    return {"X-Total-Count": str(info["totalCount"])}


class Service:
    """Queries over the raw documents, chunks and postings of all versions. cached: so many versions are persisted;
    analyzer: that under which the postings were made; trigrams: a version's stored trigram index, for the fuzzy search."""

    def __init__(self, raw: DataFrame, chunks: DataFrame, posts: DataFrame, status: Status | None = None, cached: int = 0, analyzer: S.Analyzer = S.RULE, trigrams: Callable[[str], DataFrame] | None = None):
        self.raw, self.chunks, self.posts, self.status, self.analyzer = raw, chunks, posts, status or Status(), analyzer
        self.cache, self.trigrams = VersionCache(cached) if cached else None, trigrams

    def _of(self, version: str | None) -> tuple[str, DataFrame, DataFrame, DataFrame]:
        """The version's tables; an unknown version is an error, but main, which may still be empty."""
        v = V.version(version)
        if v != V.version(None):
            V.version(v, self.versions())
        build = lambda: tuple(df.where(F.col("version") == v) for df in (self.raw, self.chunks, self.posts))
        return (v, *(self.cache.get(v, build) if self.cache else build()))

    def versions(self) -> list[str]:
        return sorted(r[0] for r in self.chunks.select("version").distinct().collect())

    def search(self, q: str, version: str | None = None, extension: str | None = None, limit: int | None = None, offset: int | None = None, fields: str | None = None) -> tuple[DataFrame, dict]:
        q, n, o, e = V.query(q), V.limit(limit), V.offset(offset), V.filter_value(extension, "extension")
        v, _, chunks, posts = self._of(version)
        page, total = S.search(chunks, posts, q, e, n, o, analyzer=self.analyzer, trigrams=self.trigrams(v) if self.trigrams else None)
        return D.select_fields(page, fields), S.envelope(page, total, n, o, max(0, min(n, total - o)))

    def document(self, path: str, version: str | None = None, fields: str | None = None) -> DataFrame:
        v, raw, chunks, _ = self._of(version)
        return D.select_fields(D.by_path(raw, chunks, v, V.path(path)), fields)

    def documents(self, keywords: str, version: str | None = None, subject: str | None = None, extension: str | None = None, brief: bool = True, limit: int | None = None, offset: int | None = None, fields: str | None = None) -> tuple[DataFrame, dict]:
        s, e = V.subject(subject, [x[0] for x in SUBJECTS]), V.filter_value(extension, "extension")
        _, raw, chunks, posts = self._of(version)
        page, info = D.by_keywords(raw, chunks, posts, keywords, s, e, brief, V.limit(limit), V.offset(offset))
        return D.select_fields(page, fields), info

    def batch(self, paths: list[str], version: str | None = None, brief: bool = False, fields: str | None = None) -> tuple[DataFrame, dict]:
        v, raw, chunks, _ = self._of(version)
        page, info = D.batch(raw, chunks, v, paths, brief)
        return D.select_fields(page, fields, ("pos", "path", "error")), info

    def related(self, path: str, version: str | None = None, limit: int | None = None, exact: bool = True, subject: str | None = None, extension: str | None = None, fields: str | None = None) -> DataFrame:
        s, e = V.subject(subject, [x[0] for x in SUBJECTS]), V.filter_value(extension, "extension")
        n = V.limit(limit, R.DEFAULT_LIMIT, R.MAX_LIMIT)
        _, _, chunks, _ = self._of(version)
        page, pages = V.path(path).removesuffix(".adoc"), R.page_tags(chunks)
        if pages.where(F.col("page") == page).isEmpty():
            raise V.NotFound(f"Document not found: {path}")
        return D.select_fields(R.related(pages, page, n, exact, s, e), fields)

    def catalog(self, version: str | None = None) -> dict:
        return C.catalog(self._of(version)[2], self.versions())

    def syntax(self) -> dict:
        english = self.analyzer is S.ENGLISH
        return {
            "tokenization": {
                "description": "A query is cut into words; each is brought to its stem, and a chunk must hold every stem.",
                "separators": "white space and signs" if english else "white space",
                "minimumLength": 1 if english else 3,
                "caseSensitive": False,
            },
            "stemming": {"algorithm": "Porter2" if english else "suffix rules", "suffixes": [] if english else T.SUFFIXES, "examples": [{"word": w, "stem": (self.analyzer.query(w) or [w])[0]} for w in ("configuration", "running", "security", "quickly")]},
            "stopWords": {"handling": "left out of queries; in texts they take a place" if english else "left out of keywords", "words": sorted(STOP if english else T.STOP_WORDS)},
            "scoring": {
                "matchTypes": [{"type": "ranked", "description": "all stems occur; several rank by how near they stand"}, {"type": "fuzzy", "description": "like spelling, if nothing is ranked on the first page", "threshold": S.THRESHOLD}],
                "oneWord": "a sum over its places, less for each further one",
                "severalWords": "1 - the product of 1 - w over all pairs of places, w falling with their distance",
            },
            "fuzzyMatching": {"when": "no ranked hit at offset 0", "measure": "shared trigrams over all trigrams", "threshold": S.THRESHOLD},
            "supported": [
                {"feature": "several words", "description": "all must occur", "example": "security token"},
                {"feature": "stemming", "description": "forms of a word are one", "example": "configure"},
                {"feature": "fuzzy fallback", "description": "spelling mistakes, if nothing else matches", "example": "securty"},
                {"feature": "extension filter", "description": "chunks of one extension", "example": "q=config&extension=core"},
                {"feature": "paging", "description": "limit and offset", "example": "q=config&limit=10&offset=20"},
            ],
            "unsupported": [
                {"pattern": "quoted phrases", "instead": "the phrase's words"},
                {"pattern": "AND, OR, NOT", "instead": "words alone: all must occur"},
                {"pattern": "* and ? wildcards", "instead": "a word: its other forms match as well"},
                {"pattern": "field:value", "instead": "the subject and extension parameters"},
                {"pattern": "+required -excluded", "instead": "words alone, and filters"},
                {"pattern": "~ for like spelling", "instead": "nothing: it is tried if no chunk matches"},
            ],
            "filters": [{"name": n, "description": d} for n, _, d in (VERSION, SUBJECT, EXTENSION, LIMIT, OFFSET)],
            "parameters": {"q": f"1 to {V.MAX_QUERY} characters", "limit": f"1 to {V.MAX_LIMIT}", "offset": "0 or more"},
            "examples": ["security token", "rest endpoint", "configure datasource"],
            "tips": ["Two or three specific words do best.", "Fewer words match more.", "Filters narrow a result without changing its order."],
        }

    def meta(self) -> dict:
        return {
            "endpoints": [{"name": n, "description": d, "parameters": [{"name": p, "required": r, "description": x} for p, r, x in parameters]} for n, d, parameters in ENDPOINTS],
            "searchSyntax": {k: self.syntax()[k] for k in ("supported", "unsupported")},
            "filters": {"versions": self.versions(), "subjects": [{"name": n, "displayName": d, "description": x} for n, d, x in SUBJECTS]},
            "versions": self.versions(),
            "subjects": [s[0] for s in SUBJECTS],
            "pagination": {"defaultLimit": S.DEFAULT_LIMIT, "maxLimit": S.MAX_LIMIT, "defaultOffset": 0, "maxBatch": V.MAX_BATCH, "totalHeader": "X-Total-Count"},
        }

    def root(self) -> dict:
        return {"message": "Documentation search", "links": ["search", "documents", "catalog", "meta", "status"]}
