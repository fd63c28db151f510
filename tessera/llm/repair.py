"""Token-id files under Re-Pair grammar compression, a shard at a time, with random access by document.

In each round the pairs of adjacent symbols that occur most are replaced by nonterminals, all over the shard. Rounds go
on as long as they save at least ``gain`` of the symbols, so that a shard of copies has as many as its copies ask for;
with a gain of 0 they go on until no pair occurs often enough to pay for its rule. A round replaces many pairs at once
(each of a count of at least a share of the top pair's), which keeps a round a handful of array passes. No rule crosses a document's end, so
a document is a range of symbols; each nonterminal's expansion length is stored, so that a range of ids is found
without expanding what is before it.

A shard is a record of a Parquet table, in order of (pid, shard), with the ids before it in its partition: Spark's committer makes it whole or absent, on any
store. Its ``data`` is, little-endian: the magic ``RPG1``; counts of documents, terminals, rules and symbols (u64
each); each document's id (i64) and whether it is null (u8); each document's number of ids and of symbols (u64); the
terminals (u32, ascending); the rules' left and right symbols (u32) and expansion lengths (u32); the symbols (u16 or
u32, as the alphabet needs). Symbols below the number of terminals are terminals, the others rules in order.

Edge cases: a null or empty text is the end id alone; null doc_ids are kept and come first; rows of equal doc_id are
documents of their own, in order of their text's hash and text; an empty table gives no shards and no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, load, table_path, thrifty
from .segments import spread
from .tokens import chunks, encoder

MAGIC = b"RPG1"
SHARD_IDS = 1 << 20
GAIN, LEAST, SHARE = 1 / 100, 8, 64
HASH_BITS = 19


def _round(s: np.ndarray, last: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One round: the shorter sequence, whether each symbol ends a document, and the new rules as pairs."""
    pair = (s[:-1] << 32) | s[1:]
    ends = np.flatnonzero(last)
    pair[ends[:-1]] = -1  # an end stays a symbol of its own
    pair[ends[ends > 0] - 1] = -1
    order = np.sort(pair)
    edge = np.flatnonzero(order[1:] != order[:-1])
    count = np.diff(np.concatenate(([-1], edge, [len(order) - 1])))
    distinct = order[np.concatenate((edge, [len(order) - 1]))] if len(order) else order
    if len(distinct) and distinct[0] == -1:
        distinct, count = distinct[1:], count[1:]
    if not len(count) or count.max() < least:
        return None
    chosen = count >= max(least, int(count.max()) // SHARE)
    distinct, count = distinct[chosen], count[chosen]
    # a table by hash tells which positions hold a chosen pair
    slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    rank = np.argsort(count, kind="stable")  # of pairs that share a slot, the most frequent stays
    distinct, count = distinct[rank], count[rank]
    slot[_slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = slot[_slot(pair)]
    hit = (at >= 0) & (distinct[at] == pair)
    # of overlapping pairs the more frequent one is replaced; of what still overlaps, every other one from the left
    weight = np.where(hit, at, -1)
    wins = hit.copy()
    wins[1:] &= weight[1:] >= weight[:-1]
    wins[:-1] &= weight[:-1] >= weight[1:]
    where = np.flatnonzero(wins)
    if not len(where):
        return None
    first = np.concatenate(([True], np.diff(where) != 1))
    start = np.maximum.accumulate(np.where(first, where, 0))
    where = where[(where - start) % 2 == 0]
    keep = np.bincount(at[where], minlength=len(distinct)) >= 3  # fewer don't pay for a rule
    where = where[keep[at[where]]]
    if not len(where):
        return None
    number = np.cumsum(keep) - 1
    s = s.copy()
    s[where] = symbols + number[at[where]]
    stay = np.ones(len(s), dtype=bool)
    stay[where + 1] = False
    return s[stay], last[stay], distinct[keep]


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def compress(doc_ids: list[int | None], encoded: list[bytes], gain: float = GAIN, least: int = LEAST) -> bytes:
    """A shard of documents, each given as its little-endian 32-bit ids (at least one)."""
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    n_ids = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    present[ids] = True
    terminals = np.flatnonzero(present)
    dense = np.zeros(len(present), dtype=np.int64)
    dense[terminals] = np.arange(len(terminals))
    s = dense[ids]
    last = np.zeros(len(s), dtype=bool)
    last[np.cumsum(n_ids) - 1] = True
    left, right, length = [], [], [np.ones(len(terminals), dtype=np.int64)]
    symbols = len(terminals)
    before, least_saved = 0, 0.0
    while abs(before - len(s)) >= least_saved and (done := _round(s, last, symbols, least)) is not None:
        before, least_saved = len(s), gain * len(s)
        s, last, rules = done
        known = np.concatenate(length)
        left.append(rules >> 32)
        right.append(rules & 0xFFFFFFFF)
        length = [known, known[left[-1]] + known[right[-1]]]
        symbols += len(rules)
    n_symbols = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    rules_left, rules_right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    lengths = np.concatenate(length)[len(terminals) :]
    head = MAGIC + struct.pack("<4Q", len(doc_ids), len(terminals), len(rules_left), len(s))
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = [named, null, n_ids.astype("<u8"), n_symbols.astype("<u8"), terminals.astype("<u4"), rules_left.astype("<u4"), rules_right.astype("<u4"), lengths.astype("<u4"), s.astype("<u2" if symbols <= 1 << 16 else "<u4")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's data, with access to whole documents or any range of a document's ids."""

    def __init__(self, data: bytes):
        assert data[:4] == MAGIC, "not a shard"
        docs, terminals, rules, symbols = struct.unpack_from("<4Q", data, 4)
        at = 36

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        named, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(named, null, strict=True)]
        self.n_ids, self.n_symbols = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.terminals = take("<u4", terminals)
        self.left, self.right, lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.length = np.concatenate([np.ones(terminals, dtype=np.int64), lengths.astype(np.int64)])
        self.symbols = take("<u2" if terminals + rules <= 1 << 16 else "<u4", symbols)
        self.first = np.concatenate(([0], np.cumsum(self.n_symbols)))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions in one array, and where each starts. A rule's parts come before it."""
        if self._table is None:
            n = len(self.terminals)
            start = np.concatenate(([0], np.cumsum(self.length)))
            flat = np.zeros(start[-1], dtype="<u4")
            flat[:n] = self.terminals
            done = n
            while done < len(self.length):  # as many rules at once as have both parts expanded
                parts = np.maximum(self.left[done - n :], self.right[done - n :])
                late = np.flatnonzero(parts >= done)
                stop = done + (int(late[0]) if len(late) else len(parts))
                for side, shift in ((self.left, None), (self.right, self.left)):
                    part = side[done - n : stop - n].astype(np.int64)
                    to = start[done:stop] + (self.length[shift[done - n : stop - n]] if shift is not None else 0)
                    flat[spread(to, self.length[part])] = flat[spread(start[part], self.length[part])]
                done = stop
            self._table = flat, start
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, start = self._expansions()
        return flat[spread(start[symbols], self.length[symbols])]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[i] : self.first[i + 1]])

    def ids(self, i: int, a: int, b: int) -> np.ndarray:
        """Ids a to b of document i, from the expansion lengths alone up to a."""
        symbols = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.length[symbols])
        x, y = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        before = int(ends[x - 1]) if x else 0
        return self.expand(symbols[x:y])[a - before : b - before]

    def whole(self) -> np.ndarray:
        return self.expand(self.symbols)


SHARDS = "pid int, shard int, before long, n_ids long, data binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, shard_ids: int = SHARD_IDS, gain: float = GAIN) -> None:
    """The ids of all documents, each with the end id, in ascending doc_id order, as shards at path; gain: what a round must save."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, pid = encoder(vocabulary, byte_level=True).encode_many, np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        ids, data, size, number, done = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([size], pa.int64()), pa.array([compress(ids, data, gain)], pa.binary())], ["pid", "shard", "before", "n_ids", "data"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for doc, x in zip(names[a:b], encode(texts[a:b]), strict=True):
                    ids.append(doc)
                    data.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= shard_ids:
                        yield shard()
                        ids, data, size, number, done = [], [], 0, number + 1, done + size
        if ids:
            yield shard()

    src = id_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(thrifty(run), SHARDS).write.option("compression", "zstd").parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the shards at path."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("pid").agg(F.sum("n_ids").alias("n")).orderBy("pid").collect()  # one row a partition
    base, rows = 0, []
    for r in totals:
        rows.append((r.pid, base))
        base += r.n
    bases = F.broadcast(spark.createDataFrame(rows, "pid int, base long"))
    placed = shards.join(bases, "pid").withColumn("at", F.col("base") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                ids, ends = memoryview(shard.whole().tobytes()), np.cumsum(shard.n_ids)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for n, e in zip(shard.n_ids.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(at + ends - shard.n_ids), pa.array(shard.n_ids), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("at", "data").mapInArrow(thrifty(run), READ)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-files")
    write_token_files(load(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
