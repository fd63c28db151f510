"""Postings in compressed blocks with skip entries, top-k search that leaves out what can't reach it, and joins of many
queries with stored postings.

Documents are dealt into shards by a hash. The postings of a lexeme in a shard are in the order of their documents, and cut
into blocks of ``BLOCK``: differences of documents, numbers of positions, and differences of positions, each as bytes of
seven bits. A block's row says from which document to which it goes and its largest number of positions. Blocks are stored
sorted by lexeme, so that a query reads its lexemes alone; of those, a shard's blocks are one task's work.

A document that holds a lexeme n times and another one m times can't have a higher rank than if all positions were side by
side. That bounds a block by its largest numbers, and a document by its own. In each shard the blocks of the rarest lexeme
are taken in descending order of their bounds, the other lists are entered by their skip entries where a block's documents
lie, positions are read where the bound reaches the k-th score, and the search ends where no block's does.

Edge cases: a lexeme that no document holds matches nothing, nor does a query without lexemes; ties go to the smaller
document; documents are longs, and rows of null documents aren't stored; an empty table makes no blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import workers_find_package

BLOCK, SHARD_DOCS, POSITIONS = 128, 1 << 16, 16384
BLOCKS = "lexeme string, shard int, first long, last long, n int, most int, docs binary, counts binary, positions binary"
NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


def _bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many of them each value takes)."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), dtype=np.int64)
    rest = v >> np.uint64(7)
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(width)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width, width)
    out = (np.repeat(v, width) >> (place * 7).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    return out | (place < np.repeat(width, width) - 1).astype(np.uint8) << 7, width


def packed(values: np.ndarray) -> bytes:
    """Integers from 0 as bytes of seven bits each, the lowest first; the last byte of each is under 128."""
    return _bytes(values)[0].tobytes()


def _packed_parts(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """packed() of the values from each start to the next."""
    data, width = _bytes(values)
    at = np.concatenate(([0], np.cumsum(width)))[np.append(start, len(values))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    start = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, start)


def _weights() -> np.ndarray:
    """log(1 - w) by distance."""
    d = np.arange(POSITIONS, dtype=np.float64)
    near = np.where(d > 100, 1e-30, 1.0 / (1.005 + 0.05 * np.exp(np.minimum(d, 101) / 1.5 - 2.0)))
    out = np.log1p(-np.sqrt(0.01 * near))
    out[0] = 0.0
    return out


LOG = _weights()
#: Of one position to so many others: two can be at each distance.
_LEAST = np.concatenate(([0.0], np.cumsum(LOG[1 + np.arange(512) // 2])))


def bound(counts: np.ndarray) -> np.ndarray:
    """The most that documents can score whose numbers of positions, one row a lexeme, are at most these."""
    if len(counts) == 1:
        return one_rank(counts[0])
    total = np.zeros(counts.shape[1])
    for i in range(len(counts)):
        for j in range(i):
            a, b = (np.minimum(counts[x], 512) for x in (i, j))
            total += np.maximum(a * _LEAST[b], b * _LEAST[a])
    return -np.expm1(total)


def one_rank(n: np.ndarray) -> np.ndarray:
    squares = np.concatenate(([0.0], np.cumsum(0.1 / np.arange(1, 257, dtype=np.float64) ** 2)))
    return squares[np.minimum(n, 256)] / 1.64493406685


def score(positions: list[np.ndarray]) -> float:
    if len(positions) == 1:
        return float(one_rank(np.array([len(positions[0])]))[0])
    total = 0.0
    for i in range(len(positions)):
        for j in range(i):
            total += LOG[np.abs(positions[i][:, None] - positions[j][None, :])].sum()
    return float(-np.expm1(total))


def build_blocks(posts: DataFrame, doc: str = "chunk_id", shard_docs: int = SHARD_DOCS, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """posts (doc, lexeme, positions) as blocks, sorted by lexeme and shard. A lexeme of all documents is as many tasks' work
    as the ranges of its shards are."""
    workers_find_package(posts.sparkSession)
    shards = shards or max(1, -(-(posts.agg(F.approx_count_distinct(doc)).first()[0] or 0) // shard_docs))
    src = posts.select(F.col(doc).cast("long").alias("doc"), "lexeme", "positions").where("doc is not null")
    keys = ["lexeme", "shard"]
    dealt = src.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")).repartitionByRange(*keys).sortWithinPartitions(*keys, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch's end is a block's end as well
            rows = batch.num_rows
            if not rows:
                continue
            docs, shard = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            words = batch.column(1).dictionary_encode().indices.to_numpy()
            at = batch.column(2).offsets.to_numpy().astype(np.int64)
            flat = batch.column(2).values.to_numpy()[at[0] : at[-1]].astype(np.int64)
            at = at - at[0]
            counts = np.diff(at)
            new = np.concatenate(([True], (words[1:] != words[:-1]) | (shard[1:] != shard[:-1])))
            key_start = np.flatnonzero(new)
            place = np.arange(rows) - np.repeat(key_start, np.diff(np.append(key_start, rows)))
            start = np.flatnonzero(place % block == 0)
            stop = np.append(start[1:], rows)
            steps = np.diff(docs, prepend=0)
            steps[start] = 0
            places = np.diff(flat, prepend=0)
            places[at[:-1][counts > 0]] = flat[at[:-1][counts > 0]]
            head = [batch.column(1).take(pa.array(start)), pa.array(shard[start], pa.int32()), pa.array(docs[start]), pa.array(docs[stop - 1]), pa.array(stop - start, pa.int32()), pa.array(np.maximum.reduceat(counts, start), pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, _packed_parts(steps, start), _packed_parts(counts, start), _packed_parts(places, at[start])], NAMES)

    return dealt.select("doc", "lexeme", "positions", "shard").mapInArrow(run, BLOCKS)


@dataclass
class Postings:
    """The blocks of one lexeme in one shard, in order, opened where they are asked for."""

    first: np.ndarray
    last: np.ndarray
    most: np.ndarray
    n: np.ndarray
    docs: list[bytes]
    counts: list[bytes]
    positions: list[bytes]
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    placed: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple]) -> Postings:
        """rows: (first, last, n, most, docs, counts, positions)."""
        rows = sorted(rows, key=lambda r: r[0])
        cols = list(zip(*rows, strict=True))
        return Postings(np.array(cols[0]), np.array(cols[1]), np.array(cols[3]), np.array(cols[2]), *cols[4:7])

    def open(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, numbers of positions) of a block."""
        if i not in self.opened:
            self.opened[i] = self.first[i] + np.cumsum(unpacked(self.docs[i])), unpacked(self.counts[i])
        return self.opened[i]

    def places(self, i: int, j: int) -> np.ndarray:
        """The positions of a block's j-th document."""
        if i not in self.placed:
            n = self.open(i)[1]
            flat = np.cumsum(unpacked(self.positions[i]))
            start = np.cumsum(n) - n
            before = np.concatenate(([0], flat))[start]  # steps go on from document to document in the sum
            self.placed[i] = flat - np.repeat(before, n), np.append(start, len(flat))
        flat, start = self.placed[i]
        return flat[start[j] : start[j + 1]]

    def among(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending documents: (which are here, their block, their place in it); only blocks that can hold one are opened."""
        at = np.searchsorted(self.last, wanted)
        at[at < len(self.first)] = np.where(self.first[at[at < len(self.first)]] <= wanted[at < len(self.first)], at[at < len(self.first)], len(self.first))
        hit, block, place = [], [], []
        for i in np.unique(at[at < len(self.first)]).tolist():
            docs, some = self.open(i)[0], np.flatnonzero(at == i)
            j = np.minimum(np.searchsorted(docs, wanted[some]), len(docs) - 1)
            good = docs[j] == wanted[some]
            hit.append(some[good])
            block.append(np.full(int(good.sum()), i))
            place.append(j[good])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(hit), np.concatenate(block), np.concatenate(place)) if hit else (none, none, none)


@dataclass
class Read:
    """How much of a shard a search has opened."""

    blocks: int = 0
    opened: int = 0
    placed: int = 0


def shard_top(lists: list[Postings], k: int, decimals: int = 12) -> tuple[list[tuple[int, float]], Read]:
    """((document, score) of the k best that are in all lists, what was read)."""
    lists = sorted(lists, key=lambda p: int(p.n.sum()))
    rarest, others = lists[0], lists[1:]
    most = [rarest.most]
    for p in others:
        # the largest number in the blocks that overlap each block of the rarest list
        lo, hi = np.searchsorted(p.last, rarest.first), np.searchsorted(p.first, rarest.last, "right")
        most.append(np.array([p.most[a:b].max(initial=0) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
    bounds = np.where(np.min(most, axis=0) > 0, bound(np.array(most)), -1.0)
    half = 0.5 * 10.0**-decimals  # what rounding adds
    best: list[tuple[float, int]] = []  # the worst first: (score, -document)

    def reaches(x: float) -> bool:
        return x >= 0 and (len(best) < k or x + half + 1e-12 >= best[0][0])

    for i in np.argsort(-bounds, kind="stable").tolist():
        if not reaches(bounds[i]):
            break
        docs, counts = rarest.open(i)
        kept, numbers, where = np.arange(len(docs)), [counts], [(np.full(len(docs), i), np.arange(len(docs)))]
        for p in others:
            hit, block, place = p.among(docs[kept])
            kept, numbers = kept[hit], [x[hit] for x in numbers]
            where = [(b[hit], j[hit]) for b, j in where] + [(block, place)]
            numbers.append(np.array([p.open(b)[1][j] for b, j in zip(block.tolist(), place.tolist(), strict=True)], dtype=np.int64))
        if not len(kept):
            continue
        own = bound(np.array(numbers))
        for c in np.argsort(-own, kind="stable").tolist():
            if not reaches(own[c]):
                break
            x = own[c] if len(lists) == 1 else score([p.places(int(b[c]), int(j[c])) for p, (b, j) in zip(lists, where, strict=True)])
            entry = (round(float(x), decimals), -int(docs[kept[c]]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    read = Read(sum(len(p.first) for p in lists), sum(len(p.opened) for p in lists), sum(len(p.placed) for p in lists))
    return [(-d, s) for s, d in sorted(best, reverse=True)], read


def shard_matches(lists: list[Postings]) -> np.ndarray:
    """The documents that are in all lists: from the rarest, entering the others by their skip entries."""
    lists = sorted(lists, key=lambda p: int(p.n.sum()))
    docs = np.concatenate([lists[0].open(i)[0] for i in range(len(lists[0].first))])
    for p in lists[1:]:
        docs = docs[p.among(docs)[0]]
    return docs


def _held(pdf: pd.DataFrame) -> dict[str, Postings]:
    rows: dict[str, list[tuple]] = {}
    for lexeme, *row in zip(*[pdf[c] for c in ("lexeme", "first", "last", "n", "most", "docs", "counts", "positions")], strict=True):
        rows.setdefault(lexeme, []).append(tuple(row))
    return {x: Postings.of(r) for x, r in rows.items()}


def top_hits(blocks: DataFrame, lexemes: list[str], k: int, doc: str = "chunk_id", decimals: int = 12) -> DataFrame:
    """doc, score: the k best of the documents that hold every lexeme, best first. A shard's blocks of these lexemes are a
    task's work; k rows come from each."""
    workers_find_package(blocks.sparkSession)
    wanted = list(dict.fromkeys(lexemes))
    some = blocks.where(F.col("lexeme").isin(wanted) if wanted else F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = _held(pdf)
        found = shard_top(list(held.values()), k, decimals)[0] if len(held) == len(wanted) else []
        return pd.DataFrame({doc: pd.Series([d for d, _ in found], dtype="int64"), "score": pd.Series([s for _, s in found], dtype="float64")})

    return some.groupBy("shard").applyInPandas(run, f"`{doc}` long, score double").orderBy(F.desc("score"), doc).limit(k)


def many_hits(queries: DataFrame, blocks: DataFrame, query_keys: list[str], doc: str = "chunk_id") -> DataFrame:
    """query_keys, doc for the documents that hold every lexeme of a query, for many queries at once.

    queries: query_keys, lexemes. Only the blocks of asked lexemes move, compressed, to their shards' tasks; queries meet
    them there, each from its rarest lexeme.
    """
    workers_find_package(blocks.sparkSession)
    asked = queries.select(*query_keys, F.array_distinct("lexemes").alias("lexemes")).where(F.size("lexemes") > 0)
    words = asked.select(F.explode("lexemes").alias("lexeme")).distinct()
    needed = blocks.join(words, "lexeme", "left_semi")
    names = [f"_q{i}" for i in range(len(query_keys))]
    # a shard's task gets every query, in rows of up to some thousand: there is one shard for SHARD_DOCS documents
    key = F.struct(*[F.col(q).alias(n) for q, n in zip(query_keys, names, strict=True)]).alias("q")
    n_shards, rows = (blocks.agg(F.max("shard")).first()[0] or 0) + 1, asked.select(key, "lexemes")
    sent = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select("shard", F.array(F.struct("q", "lexemes")).alias("asked"))
    key_types = sent.schema["asked"].dataType.elementType["q"].dataType
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, key_types.fields, strict=True)) + ", doc long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = _held(left)
        rows = [(q, lexemes) for some in right["asked"] for q, lexemes in ((x["q"], x["lexemes"]) for x in some) if all(x in held for x in lexemes)]
        found = [shard_matches([held[x] for x in lexemes]) for _, lexemes in rows]
        at = np.repeat(np.arange(len(rows)), [len(f) for f in found]) if rows else np.zeros(0, dtype=np.int64)
        out = {n: [rows[i][0][n] for i in at.tolist()] for n in names}
        return pd.DataFrame(out | {"doc": np.concatenate(found) if found else np.zeros(0, dtype=np.int64)})

    hits = needed.groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(run, schema)
    return hits.select(*[F.col(n).alias(q) for n, q in zip(names, query_keys, strict=True)], F.col("doc").alias(doc))


def postings_of(blocks: DataFrame, doc: str = "chunk_id") -> DataFrame:
    """The postings that blocks were made of: doc, lexeme, tf, positions."""
    workers_find_package(blocks.sparkSession)

    def whole(column: pa.Array) -> np.ndarray:
        at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        return unpacked(memoryview(column.buffers()[2] or b"")[at[0] : at[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            steps, counts, places = (whole(batch.column(i)) for i in (3, 4, 5))
            total, start = np.cumsum(steps), np.cumsum(n) - n
            docs = total - np.repeat(total[start] - first, n)
            flat, at = np.cumsum(places), np.cumsum(counts) - counts
            flat = flat - np.repeat(flat[at] - places[at], counts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            words = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(docs), words, pa.array(counts.astype(np.int32)), lists], [doc, "lexeme", "tf", "positions"])

    return blocks.select("lexeme", "first", "n", "docs", "counts", "positions").mapInArrow(run, f"`{doc}` long, lexeme string, tf int, positions array<int>")
