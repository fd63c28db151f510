"""The inverted index: postings of a chunk table, and its snapshots on disk."""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parser as P
from ..functions import text as T


_stem = functools.lru_cache(maxsize=1 << 18)(T.stem_word)


def rule(texts: list[str]) -> P.Lexemes:
    """The lexemes of texts under the rule stemmer: only distinct words are stemmed."""
    words = [T.tokens(t) for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    coded = pa.array([w for some in words for w in some], pa.string()).dictionary_encode()
    names: dict[str, int] = {}
    by_code = np.array([names.setdefault(_stem(w), len(names)) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    lex = by_code[coded.indices.to_numpy()] if len(by_code) else np.zeros(0, dtype=np.int64)
    return list(names), np.repeat(np.arange(len(texts)), size), lex, np.arange(len(lex)) - np.repeat(np.cumsum(size) - size, size) + 1


def postings(df: DataFrame, keys: list[str], content: str = "content", only: list[str] | None = None, analyze: Callable[[list[str]], P.Lexemes] = rule) -> DataFrame:
    """keys, lexeme, tf, positions: each row of df makes its own, nothing is shuffled. only: postings of these lexemes, of
    chunks whose text holds every one of them: what a query needs where nothing is stored."""
    if only is not None and analyze is rule:  # the rule stemmer takes off suffixes: a lexeme is a part of its words
        words = T.plain_words(F.col(content))
        df = df.where(reduce(lambda x, y: x & y, [F.contains(words, F.lit(w)) for w in only], F.lit(True)))
    return P.postings(df, keys, content, only, analyze)


def term_counts(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, lexeme, tf (all occurrences)."""
    return P.term_counts(df, keys, content, rule)


def document_frequency(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, lexeme, df (chunks that hold it), cf (all its occurrences). keys tell chunks apart."""
    return term_counts(df, [*by, *keys]).groupBy(*by, "lexeme").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def rank_one(tf: Column) -> Column:
    """The rank of one lexeme at the lowest weight over its tf positions."""
    return F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda a, j: a + F.lit(0.1) / (j * j).cast("double")) / 1.64493406685


def pair_weight(d: Column) -> Column:
    """Of two positions at distance d of two lexemes at the lowest weight."""
    near = F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
    return F.sqrt(0.1 * 0.1 * near)


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: another one after any rewrite."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


class IndexStore:
    """Versioned tables in a folder. A version's tables are files of one snapshot, which a pointer file names: readers go
    from one whole snapshot to the next, whatever fails in between. The pointer also holds the stamp of what a table was made
    of, under the table's name and an @.

    A table is one folder, or, where changes are added to it (update), segments that are never written again: rows, and keys
    that are gone from all earlier rows. Readers leave out what is gone; compaction merges segments of like size, so that
    a row is written again as often as the logarithm of the table's size says, and drops deletions that nothing needs."""

    POINTER = "_current"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _snapshot(self, version: str) -> dict:
        """Table to folder, or to key and segments, of the current snapshot."""
        fs, pointer = self._fs(f"{self.root}/{version}/{self.POINTER}")
        if not fs.exists(pointer):
            return {}
        stream = fs.open(pointer)
        data = json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        stream.close()
        return data

    @staticmethod
    def _folders(tables: dict) -> set[str]:
        return {f for v in tables.values() for f in ([x["folder"] for x in v["parts"]] if isinstance(v, dict) else [v])}

    def _point(self, version: str, tables: dict) -> None:
        """Turn readers to the tables: the pointer is renamed over the former one in one step."""
        _, fresh = self._fs(f"{self.root}/{version}/_fresh-{uuid.uuid4().hex}")
        fs, pointer = self._fs(f"{self.root}/{version}/{self.POINTER}")
        stream = fs.create(fresh, True)
        stream.write(json.dumps(tables).encode())
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, options)

    def _write(self, version: str, folder: str, df: DataFrame, sort: list[str] | None) -> None:
        if not sort:
            df.write.parquet(f"{self.root}/{version}/{folder}")
            return
        # ranges are found on a sample: what makes the rows runs once
        unsorted = f"{self.root}/{version}/_unsorted-{uuid.uuid4().hex}"
        try:
            df.write.parquet(unsorted)
            out = self.spark.read.schema(df.schema).parquet(unsorted).repartitionByRange(*sort).sortWithinPartitions(*sort)
            out.write.parquet(f"{self.root}/{version}/{folder}")
        finally:
            fs, path = self._fs(unsorted)
            fs.delete(path, True)

    def replace(self, version: str, tables: dict[str, DataFrame], sort_by: dict[str, list[str]] | None = None, kept: int = 1, stamps: dict[str, str] | None = None) -> None:
        """These tables of a version, all at once; tables that aren't named stay. Former folders but the last ``kept``
        snapshots' go. sort_by: rows are dealt by ranges of these columns and sorted, so that readers skip files."""
        before = self._snapshot(version)
        after = {k: v for k, v in before.items() if k.rstrip("@") not in tables or not k.endswith("@")} | {f"{k}@": v for k, v in (stamps or {}).items()}
        try:
            for name, df in tables.items():
                after[name] = f"{name}-{uuid.uuid4().hex}"
                self._write(version, after[name], df.drop("version"), (sort_by or {}).get(name))
            self._point(version, after)
        except Exception:
            for name in after.keys() & tables.keys():  # what was written of a snapshot that never came
                if after[name] != before.get(name):
                    fs, path = self._fs(f"{self.root}/{version}/{after[name]}")
                    fs.delete(path, True)
            raise
        if kept == 1:
            self._clean(version, self._folders(before) | self._folders(after))

    def _clean(self, version: str, used: set[str]) -> None:
        """Folders that neither the current snapshot nor the one before it names: readers of the latter may be at work."""
        fs, folder = self._fs(f"{self.root}/{version}")
        for s in fs.listStatus(folder):
            if s.isDirectory() and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def append(self, table: str, version: str, df: DataFrame) -> None:
        """Rows added to a table: a new snapshot that holds the former rows as well."""
        old = self.read(table, version)
        self.replace(version, {table: df if old is None else old.drop("version").unionByName(df.drop("version"))})

    def read(self, table: str, version: str) -> DataFrame | None:
        held = self._snapshot(version).get(table)
        if held is None:
            return None
        df = self._live(version, held["key"], held["parts"]).drop("_seq") if isinstance(held, dict) else self.spark.read.parquet(f"{self.root}/{version}/{held}")
        return df.withColumn("version", F.lit(version))

    def _part(self, version: str, name: str, kind: str, df: DataFrame, seq: int, sort: list[str] | None) -> dict:
        folder = f"{name}-{kind}-{uuid.uuid4().hex}"
        out = df.drop("version").withColumn("_seq", F.lit(seq)) if "_seq" not in df.columns else df.drop("version")
        try:
            self._write(version, folder, out, sort if kind == "rows" else None)
        except Exception:
            fs, path = self._fs(f"{self.root}/{version}/{folder}")
            fs.delete(path, True)
            raise
        fs, path = self._fs(f"{self.root}/{version}/{folder}")
        return {"folder": folder, "kind": kind, "seq": seq, "bytes": fs.getContentSummary(path).getLength()}

    def _parts(self, version: str, parts: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{version}/{x['folder']}" for x in parts])

    def _live(self, version: str, key: list[str], parts: list[dict], of: list[dict] | None = None) -> DataFrame:
        """The rows (of these segments) whose key isn't gone in a later one, with _seq."""
        rows, gone = [x for x in of or parts if x["kind"] == "rows"], [x for x in parts if x["kind"] == "gone"]
        df = self._parts(version, rows)
        gone = [x for x in gone if x["seq"] > min(r["seq"] for r in rows)]
        if not gone:
            return df
        last = self._parts(version, gone).groupBy(*key).agg(F.max("_seq").alias("_gone"))
        return df.join(last, key, "left").where("_gone is null or _seq >= _gone").select(df.columns)

    def update(self, version: str, changes: dict[str, tuple[list[str], DataFrame, DataFrame | None]], sort_by: dict[str, list[str]] | None = None) -> None:
        """Segments added to tables, all at once: table to (key, new rows, keys of which all earlier rows go)."""
        before, made = self._snapshot(version), []
        after = {k: v for k, v in before.items() if k.rstrip("@") not in changes or not k.endswith("@")}
        seq = 1 + max((x["seq"] for v in before.values() if isinstance(v, dict) for x in v["parts"]), default=0)
        try:
            for name, (key, rows, gone) in changes.items():
                held, sort = before.get(name), (sort_by or {}).get(name)
                if isinstance(held, str):  # a table of one folder becomes the first segment
                    old = self.spark.read.parquet(f"{self.root}/{version}/{held}")
                    parts = [self._part(version, name, "rows", old, 0, sort)]
                    made.append(parts[0]["folder"])
                else:
                    parts = list(held["parts"]) if held else []
                for kind, df in (("gone", gone if parts else None), ("rows", rows)):
                    if df is not None and not (parts and df.isEmpty()):
                        parts.append(self._part(version, name, kind, df.select(*key).distinct() if kind == "gone" else df, seq, sort))
                        made.append(parts[-1]["folder"])
                after[name] = {"key": key, "parts": parts, "sort": sort}
            self._point(version, after)
        except Exception:
            for folder in made:  # what was written of a snapshot that never came
                fs, path = self._fs(f"{self.root}/{version}/{folder}")
                fs.delete(path, True)
            raise
        self._clean(version, self._folders(before) | self._folders(after))

    def compact(self, version: str, fan: int = 4) -> int:
        """Merges ``fan`` or more segments of a table whose sizes are within a factor of fan, as long as there are such ones;
        every merge is a snapshot of its own. The number of merges."""
        merges, names = 0, [k for k, v in self._snapshot(version).items() if isinstance(v, dict)]
        for name in names:
            while True:
                tables = self._snapshot(version)
                held, seq = tables[name], 1 + max(x["seq"] for v in tables.values() if isinstance(v, dict) for x in v["parts"])
                parts = held["parts"]
                tiers: dict[tuple, list[dict]] = {}
                for x in parts:
                    tiers.setdefault((x["kind"], 0 if x["kind"] == "gone" else (max(1, x["bytes"] >> 14).bit_length() - 1) // (fan.bit_length() - 1)), []).append(x)
                some = next((t for k, t in sorted(tiers.items()) if len(t) >= fan), None)
                if some is None:
                    break
                rest = [x for x in parts if x not in some]
                if some[0]["kind"] == "gone":
                    last = max(x["seq"] for x in some)
                    rest.append(self._part(version, name, "gone", self._parts(version, some).groupBy(*held["key"]).agg(F.max("_seq").alias("_seq")), last, None))
                else:
                    # what is gone has been left out, so that deletions until now don't bear on the merged segment
                    rest.append(self._part(version, name, "rows", self._live(version, held["key"], parts, some).drop("_seq"), seq, held["sort"]))
                first = min(x["seq"] for x in rest if x["kind"] == "rows")
                rest = [x for x in rest if x["kind"] == "rows" or x["seq"] > first]
                self._point(version, {**tables, name: {**held, "parts": rest}})
                self._clean(version, self._folders(tables) | {x["folder"] for x in rest})
                merges += 1
        return merges

    def read_through(self, table: str, version: str, build: Callable[[], DataFrame], sort_by: list[str] | None = None, made_of: str | None = None) -> DataFrame:
        """The stored table, or, where there is none, what build gives, stored first. made_of: the stamp of what it is made of;
        a stored table of another stamp is built anew."""
        now = self._snapshot(version)
        if table not in now or (made_of is not None and now.get(f"{table}@") != made_of):
            self.replace(version, {table: build()}, {table: sort_by} if sort_by else None, stamps={table: made_of} if made_of else None)
        return self.read(table, version)

    def versions(self, table: str) -> list[str]:
        fs, root = self._fs(self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []
        return [v for v in names if table in self._snapshot(v)]

    def delete(self, table: str, version: str | None = None) -> None:
        """A table of a version, or of all: the pointer turns first, the files go after it."""
        for v in [version] if version else self.versions(table):
            tables = self._snapshot(v)
            tables.pop(f"{table}@", None)
            if (held := tables.pop(table, None)) is not None:
                self._point(v, tables)
                for folder in self._folders({table: held}):
                    fs, path = self._fs(f"{self.root}/{v}/{folder}")
                    fs.delete(path, True)

    def drop_all(self) -> None:
        fs, path = self._fs(self.root)
        fs.delete(path, True)
