"""Order MinHash fingerprints: locality-sensitive for edit distance, not only for the bag of k-mers.

Every k-mer of code points is numbered by its occurrence, so that repeats count. Under each of ``m`` keyed orders the
``ell`` minimal numbered k-mers are selected, put back in the order in which they stand in the text, and hashed as a
tuple; the tuples' hashes are the fingerprint. The likeness of two fingerprints is the share of equal components.

Edge cases: null and empty texts have one and the same fingerprint (likeness 1 to each other, in general 0 to others);
a text shorter than k is one k-mer; texts that are equal have equal fingerprints; documents of equal or null doc_id are
put in order by their text's hash, then the text, nulls first; a table of one row has itself as the next document; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, load, thrifty, written

K, M, ELL = 8, 32, 2
U = np.uint64
P1, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
POSITION_BITS = 24


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX1)
    x = (x ^ (x >> U(27))) * U(MIX2)
    return x ^ (x >> U(31))


class OrderMinHash:
    def __init__(self, k: int = K, m: int = M, ell: int = ELL, seed: int = 1):
        self.k, self.m, self.ell = k, m, ell
        keys = _mixed(np.arange(seed, seed + 2 * m, dtype=U) * U(P1))
        self.flip, self.times = keys[:m, None], keys[m:, None] | U(1)

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the occurrence-numbered k-mers, and their positions."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U)
        n = max(1, len(c) - self.k + 1)
        width = min(self.k, len(c))
        # sums over windows of doubled width, put together for the binary digits of the width
        power, span, part = P1, 1, c
        h, at, weight = np.full(n, width, dtype=U), 0, 1
        while True:
            if width & span:
                h = h + part[at : at + n] * U(weight)
                at, weight = at + span, weight * pow(P1, span, 1 << 64) & MASK
            if span * 2 > width:
                break
            part = part[:-span] + part[span:] * U(power)
            power, span = power * power & MASK, span * 2
        h = _mixed(h)
        if n >= 1 << POSITION_BITS:
            order = np.argsort(h >> U(POSITION_BITS), kind="stable")
            value, position = (h >> U(POSITION_BITS))[order], order.astype(np.int64)
        else:
            key = np.sort((h & U(MASK ^ ((1 << POSITION_BITS) - 1))) | np.arange(n, dtype=U))
            value, position = key >> U(POSITION_BITS), (key & U((1 << POSITION_BITS) - 1)).astype(np.int64)
        same = np.flatnonzero(value[1:] == value[:-1]) + 1
        value = value * U(P1)
        if len(same):
            first = np.arange(n)
            first[same] = 0
            first = np.maximum.accumulate(first)
            value[same] += (same - first[same]).astype(U) * U(MIX2)
        return _mixed(value), position

    def signature(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(self.m, dtype=np.uint32)
        g, position = self.numbered(text)
        ell = min(self.ell, len(g))
        picked = np.empty((self.m, ell), dtype=np.int64)
        if len(g) <= 8192:
            x = (g ^ self.flip) * self.times
            rows = np.arange(self.m)
            for i in range(ell):
                picked[:, i] = x.argmin(axis=1)
                x[rows, picked[:, i]] = U(MASK)
        else:
            for j in range(self.m):
                x = (g ^ self.flip[j]) * self.times[j]
                for i in range(ell):
                    picked[j, i] = at = x.argmin()
                    x[at] = U(MASK)
        order = np.argsort(position[picked], axis=1)
        tuples = g[np.take_along_axis(picked, order, axis=1)]
        h = np.full(self.m, ell, dtype=U)
        for i in range(ell):
            h = _mixed(h * U(P1) + tuples[:, i])
        return (h >> U(32)).astype(np.uint32)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """The last quarter of the text replaced by the start of the document after it."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: kind 0: a result; 1: the first text of a partition; 2: the last, whose next document is in another partition.
INNER = RESULT + ", kind int, pid int, text string"


def _result(omh: OrderMinHash, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = omh.signature(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own), to_hex(other), likeness(own, other), likeness(own, following)


def fingerprints(docs: DataFrame, k: int = K, m: int = M, ell: int = ELL) -> DataFrame:
    """A fingerprint of each document, of its edited text, and their likenesses (see RESULT).

    Texts are dealt once, by ranges of doc_id; a partition's last document meets the next partition's first one in a
    join of one row a partition.
    """
    names = [f.split()[0] for f in INNER.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh, pid, before, empty = OrderMinHash(k, m, ell), TaskContext.get().partitionId(), None, (None,) * 6
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                own = omh.signature(text)
                if before is None:
                    rows.append((doc, *empty, 1, pid, text))
                else:
                    rows.append((before[0], *_result(omh, before[1], before[2], text, own), 0, pid, None))
                before = doc, text, own
                if len(rows) >= 2000:
                    yield packed(rows)
                    rows = []
        if before is not None:
            rows.append((before[0], *empty, 2, pid, before[1]))
        if rows:
            yield packed(rows)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh = OrderMinHash(k, m, ell)
        for batch in batches:
            for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (doc, *_result(omh, text, omh.signature(text), after, omh.signature(after)))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=False)], names[:7])

    src = id_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    done = written(dealt.mapInArrow(thrifty(run), INNER), "order-minhash")
    firsts = done.where("kind = 1").select("pid", F.col("text").alias("after"))
    pids = sorted(r[0] for r in firsts.select("pid").collect())  # one number a partition
    turn = done.sparkSession.createDataFrame(list(zip(pids, [*pids[1:], *pids[:1]], strict=True)), "pid int, next int")
    pairs = done.where("kind = 2").select("pid", "doc_id", "text").join(turn, "pid").join(firsts.withColumnRenamed("pid", "next"), "next")
    return done.where("kind = 0").select(*names[:7]).unionByName(pairs.select("doc_id", "text", "after").mapInArrow(last, RESULT))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
