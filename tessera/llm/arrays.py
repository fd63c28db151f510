"""Sums of integer arrays of one length over all partitions, and filters of ids sized by their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import thrifty
from .shingles import U, mixed

BLOCKS = 64
SCHEMA = "block int, salt int, data binary"


def _packed(part: np.ndarray) -> bytes:
    """Compressed, the bytes of like weight together: integers of few digits are mostly zeros."""
    data = np.ascontiguousarray(part.view(np.uint8).reshape(len(part), -1).T)
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, width: int = 8) -> np.ndarray:
    """size bytes of integers of so many bytes each."""
    flat = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).ravel()


def array_sum(df: DataFrame, length: int, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray:
    """The sum of what fill makes of each partition; length is a multiple of 64.

    Blocks are summed in two rounds, so that no task gathers all partitions' arrays. What the driver gets is the sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fill(batches)
        if total is not None:
            data = [_packed(part) for part in total.astype("<i8").reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId() // 64] * BLOCKS, pa.int32()), pa.array(data, pa.binary())], ["block", "salt", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(length // BLOCKS, dtype=np.int64)
        for d in pdf["data"]:
            total += _unpacked(d, 8 * len(total)).view("<i8")
        return pdf.iloc[:1].assign(data=[_packed(total.astype("<i8"))])

    out = np.zeros((BLOCKS, length // BLOCKS), dtype=np.int64)
    for row in df.mapInArrow(thrifty(run), SCHEMA).groupBy("block", "salt").applyInPandas(add, SCHEMA).groupBy("block").applyInPandas(add, SCHEMA).collect():
        out[row.block] = _unpacked(row.data, 8 * out.shape[1]).view("<i8")
    return out.ravel()


def _or_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at these places of a packed array."""
    at = np.unique(at)
    byte = at >> 3
    first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    if len(at):
        packed[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)


class IdFilter:
    """A Bloom filter of 16 places for each id, two of them set: one id in about 70 that it wasn't given passes as well."""

    MOST = 1 << 29  # 64 MB

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, 8 * len(packed)

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> np.ndarray:
        h = mixed(ids.astype(U) * U(0x9E3779B97F4A7C15))
        return (np.concatenate([h & U(0xFFFFFFFF), h >> U(32)]) & U(bits - 1)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids, self.bits)
        hit = (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit[: len(ids)] & hit[len(ids) :]


def id_filter(ids: DataFrame) -> IdFilter | None:
    """A filter sized by the number of ids in a written table's one column; None if it would be over the filter's bound."""
    n = ids.count()
    bits = 1 << max(16, (16 * n - 1).bit_length())
    if bits > IdFilter.MOST:
        return None
    block = bits // BLOCKS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, some = np.zeros(bits // 8, dtype=np.uint8), False
        for batch in batches:
            values, some = batch.column(0).drop_null().to_numpy(), True
            _or_bits(packed, IdFilter.places(values, bits))
        if some:
            data = [_packed(part) for part in packed.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId() // 64] * BLOCKS, pa.int32()), pa.array(data, pa.binary())], ["block", "salt", "data"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.uint8)
        for d in pdf["data"]:
            total |= _unpacked(d, block, 1)
        return pdf.iloc[:1].assign(data=[_packed(total)])

    out = np.zeros((BLOCKS, block), dtype=np.uint8)
    for row in ids.mapInArrow(thrifty(fill), SCHEMA).groupBy("block", "salt").applyInPandas(unite, SCHEMA).groupBy("block").applyInPandas(unite, SCHEMA).collect():
        out[row.block] = _unpacked(row.data, block, 1)
    return IdFilter(out.ravel())
