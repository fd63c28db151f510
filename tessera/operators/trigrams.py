"""A trigram index: texts that are like a query, from the lists of the query's trigrams, without a look at any text.

A text is its set of trigrams. Rows are dealt into shards by a hash of their document; in a shard, rows whose sets have
like sizes (within a factor of the square root of two) are a class, and have places in it in the order of their documents.
The index holds, for each trigram, shard and class, the places of the rows that have it, as differences of seven bits a
byte, and under the empty trigram the documents and sizes of the class itself. It is stored sorted by trigram.

A query of q trigrams and a row of m share s of them; their similarity is s / (q + m - s). Above a threshold t, m lies
between t * q and q / t, so that other classes aren't read; and s exceeds t * (q + m) / (1 + t), so that of n lists a row must
be in one of the n - s + 1 shortest: those are united with counts, and a longer one is opened only while some row can
still reach its number with all that are left.

Edge cases: null texts and texts without letters and digits have no trigrams, aren't stored and match nothing, as do such
queries; rows of null documents aren't stored; rows with equal documents are rows of their own; texts of any length are
taken whole, a piece at a time; an empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import spread, workers_find_package
from .blocks import _packed_parts, packed, unpacked

SIGNS = " 0123456789abcdefghijklmnopqrstuvwxyz"
BASE, ALL = len(SIGNS), len(SIGNS) ** 3
CODE = np.zeros(256, dtype=np.uint16)
CODE[[ord(s) for s in SIGNS]] = np.arange(BASE)
#: The least size of each class.
FLOOR = np.unique(np.ceil(2.0 ** (np.arange(0, 2 * ALL.bit_length() + 1) / 2) - 1e-9).astype(np.int64))
#: Rows of a shard, and trigrams of all its rows at most.
SHARD_ROWS, SHARD_TRIGRAMS, PIECE = 1 << 16, 1 << 25, 1 << 20
INDEX = "trigram string, shard int, class int, n int, places binary, sizes binary"


def classes(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOOR, sizes, "right") - 1


def code_set(text: np.ndarray) -> np.ndarray:
    """The trigrams of a lower-cased text's UTF-8 bytes, ascending: the codes of three signs, spaces at both ends of words."""
    seen = np.zeros(ALL, dtype=bool)
    for at in range(0, len(text) + 1, PIECE):
        # two signs before the piece, and a space after the text's last one
        c = np.zeros(min(PIECE, len(text) + 1 - at) + 2, dtype=np.uint16)
        some = CODE[text[max(0, at - 2) : at + PIECE]]
        first = 2 - min(2, at)
        c[first : first + len(some)] = some
        before, cur = c[1:-1], c[2:]
        codes = (np.where(before > 0, c[:-2], 0) * np.uint16(BASE) + before) * np.uint16(BASE) + cur
        seen[codes[(before | cur) > 0]] = True
    return np.flatnonzero(seen).astype(np.uint16)


def name(code: int) -> str:
    return SIGNS[code // BASE // BASE] + SIGNS[code // BASE % BASE] + SIGNS[code % BASE]


def build_trigrams(df: DataFrame, doc: str = "chunk_id", content: str = "content", shards: int | None = None) -> DataFrame:
    """The index of df's texts. Rows go to their shards as sets of two bytes a trigram; a shard is a task's work."""
    workers_find_package(df.sparkSession)
    src = df.select(F.col(doc).cast("long").alias("doc"), F.lower(F.col(content)).alias("text")).where("doc is not null and text is not null")
    if shards is None:
        rows, most = src.agg(F.count("*"), F.sum(F.least(F.octet_length("text") + 1, F.lit(ALL)).cast("long"))).first()
        shards = max(1, -(-rows // SHARD_ROWS), -(-(most or 0) // SHARD_TRIGRAMS))
    dealt = spread(src).withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [code_set(np.frombuffer(t.as_buffer(), dtype=np.uint8)) for t in batch.column(1)]
            out = pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["shard", "doc", "size", "codes"])
            yield out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    def lists(table: pa.Table) -> pa.Table:
        shard, doc_of, size = table["shard"][0].as_py(), table["doc"].to_numpy(), table["size"].to_numpy().astype(np.int64)
        codes, kind, parts = table["codes"].to_pylist(), classes(size), []
        for c in np.unique(kind).tolist():
            rows = np.flatnonzero(kind == c)
            rows = rows[np.argsort(doc_of[rows], kind="stable")]
            flat = np.frombuffer(b"".join([codes[i] for i in rows.tolist()]), dtype=np.uint16)
            place = np.repeat(np.arange(len(rows), dtype=np.int32), size[rows])
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order].astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            steps = np.diff(place, prepend=0)
            steps[start] = place[start]
            # documents may be negative: the first is kept as it is, as eight bytes
            docs = doc_of[rows]
            head = docs[:1].astype("<i8").tobytes() + packed(np.diff(docs))
            n = np.concatenate(([len(rows)], np.diff(np.append(start, len(flat)))))
            names = ["", *[name(x) for x in flat[start].astype(int).tolist()]]
            places = pa.concat_arrays([pa.array([head], pa.binary()), _packed_parts(steps, start)])
            own = pa.array([packed(size[rows]), *[None] * len(start)], pa.binary())
            parts.append(pa.table([pa.array(names, pa.string()), pa.array([shard] * len(n), pa.int32()), pa.array([c] * len(n), pa.int32()), pa.array(n, pa.int32()), places, own], names=[f.split()[0] for f in INDEX.split(", ")]))
        return pa.concat_tables(parts)

    rows = dealt.select("doc", "text", "shard").mapInArrow(sets, "shard int, doc long, size int, codes binary")
    return rows.groupBy("shard").applyInArrow(lists, INDEX)


def class_hits(lists: list[tuple[int, bytes]], sizes: np.ndarray, asked: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) above the threshold in a class whose sizes are at least ``least``, and how many lists were opened."""
    need = np.maximum(1, np.floor(threshold * (asked + sizes) / (1 + threshold) - 1e-9).astype(np.int64) + 1)
    fewest = max(1, int(np.floor(threshold * (asked + least) / (1 + threshold) - 1e-9)) + 1)
    lists, held, opened = sorted(lists, key=lambda x: x[0]), np.zeros(len(sizes), dtype=np.int64), 0
    if len(lists) < fewest:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0
    must = len(lists) - fewest + 1
    for i, (_, data) in enumerate(lists):
        if i >= must and not (rows := rows[held[rows] + len(lists) - i >= need[rows]]).size:
            break
        held[np.cumsum(unpacked(data))] += 1
        opened += 1
        if i == must - 1:
            rows = np.flatnonzero(held)
    scores = held[rows] / (asked + sizes[rows] - held[rows])
    return rows[scores > threshold], scores[scores > threshold], opened


def similar(index: DataFrame, query: str, threshold: float = 0.1, doc: str = "chunk_id") -> DataFrame:
    """doc, score of every row whose text's trigrams are more than ``threshold`` (0 or more) like the query's. Of the stored index,
    the lists of the query's trigrams are read in classes of sizes that can match; a shard's lists are a task's work."""
    if threshold < 0:
        raise ValueError("a threshold of trigram similarity is 0 or more")
    workers_find_package(index.sparkSession)
    asked = sorted(T.trigram_set(query))
    low, high = (int(classes(np.array([min(ALL, max(1, x))]))[0]) for x in (int(threshold * len(asked)), int(len(asked) / threshold) + 1 if threshold else ALL))
    some = index.where(F.col("trigram").isin(["", *asked]) & F.col("class").between(low, high) if asked else F.lit(False))

    def run(table: pa.Table) -> pa.Table:
        held: dict[int, list[tuple]] = {}
        for t, c, n, places, sizes in zip(*[table[x].to_pylist() for x in ("trigram", "class", "n", "places", "sizes")], strict=True):
            held.setdefault(c, []).append((t, n, places, sizes))
        docs, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for c, rows in held.items():
            lists = [(n, places) for t, n, places, _ in rows if t]
            if not lists:
                continue
            head, own = next((places, sizes) for t, _, places, sizes in rows if not t)
            at, found, _ = class_hits(lists, unpacked(own), len(asked), threshold, int(FLOOR[c]))
            if len(at):
                docs.append((np.frombuffer(head[:8], dtype="<i8")[0] + np.concatenate(([0], np.cumsum(unpacked(head[8:])))))[at])
                scores.append(found)
        return pa.table([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(scores), pa.float64())], names=[doc, "score"])

    return some.select("trigram", "shard", "class", "n", "places", "sizes").groupBy("shard").applyInArrow(run, f"`{doc}` long, score double")
