"""Packing of tokenized documents into sequences of bounded length by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows of the capacity, each a sequence of its own without padding, and a rest
that is cut into pieces of at most ``piece`` ids. Rests are dealt by a hash into groups of about ``windows`` windows,
so that a group is small whatever the input; in each group the differencing method merges partial partitions, the
fullest windows of one with the emptiest of the other, until one partition into k windows is left. k starts at the
least possible count and rises whenever a window exceeds the capacity.

Edge cases: a null or empty text is one piece that holds the end id alone; a null doc_id is kept as null; repeated
rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, load, thrifty, written
from .tokens import chunks, encoder

CAPACITY, MOST_ITEMS = 4096, 16384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of positions in sizes, with near-equal sums.

    A partial partition is k sums in descending order, less their least, with the contents of each window as a node
    of a binary tree; windows without contents aren't held, so all partitions together hold no more than the pieces. The
    two partitions of the largest spread are merged again and again, windows of the one in descending order with those of
    the other in ascending order.
    """
    n = len(sizes)
    if k == 1:
        return [list(range(n))]
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    nodes = n
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), len(heap), sizes[i : i + 1].astype(np.int64), np.array([i])))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        both = len(a) + len(b) - k  # windows of contents in both
        if both <= 0:
            sums, tree = np.concatenate([a, b[::-1]]), np.concatenate([ta, tb[::-1]])
        else:
            sums, tree = np.zeros(k, dtype=np.int64), np.empty(k, dtype=np.int64)
            sums[: len(a)], tree[: len(a)] = a, ta
            sums[k - len(b) :] += b[::-1]
            tree[len(a) :] = tb[::-1][both:]
            shared = np.arange(len(a) - both, len(a))
            new = np.arange(nodes, nodes + both)
            left[new], right[new], tree[shared] = tree[shared], tb[::-1][:both], new
            nodes += both
        order = np.argsort(-sums, kind="stable")
        sums, tree = sums[order], tree[order]
        if len(sums) == k:
            sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, tree))
        turn += 1
    out = []
    for root in heap[0][3]:
        items, stack = [], [int(root)]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def lumps(sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Positions of pieces: each alone, or, where they are many for their sizes, small ones one after the other in lumps of
    up to a 16th of the capacity, so that a group has a bounded number of items however short its texts are."""
    if len(sizes) <= MOST_ITEMS:
        return [np.array([i]) for i in range(len(sizes))]
    small = sizes <= capacity // 32
    some = np.flatnonzero(small)
    lump = (np.cumsum(sizes[some]) - 1) // (capacity // 32)  # of up to capacity // 32 and one small piece
    return [np.array([i]) for i in np.flatnonzero(~small)] + np.split(some, np.flatnonzero(lump[1:] != lump[:-1]) + 1)


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest windows that differencing fills within the capacity, from the least possible count upwards."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    items = lumps(sizes, capacity)
    totals = np.array([int(sizes[x].sum()) for x in items])
    while True:
        windows = differencing(totals, k)
        if max(int(totals[w].sum()) for w in windows) <= capacity:
            return [np.concatenate([items[i] for i in w]).tolist() for w in windows if w]
        k += 1


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, piece: int = 256) -> DataFrame:
    """Each document's ids, the end id among them, cut at fixed places: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, byte_level=False).encode_many, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                rows: list[tuple] = []
                for doc, data in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    data += end
                    total = len(data) // 4
                    whole = total - total % capacity
                    for start, stop, step in ((0, whole, capacity), (whole, total, piece)):
                        for s in range(start, stop, step):
                            e = min(s + step, stop)
                            rows.append((doc, s, e - s, zlib.crc32(data[4 * s : 4 * e]), total))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs).mapInArrow(thrifty(run), PIECES)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, piece: int = 256, windows: int = 256) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = written(token_pieces(docs, vocabulary, end_id, capacity, piece), "pieces")
    rest = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(rest / (capacity * windows)))

    def in_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        whole, part = np.flatnonzero(size == capacity), np.flatnonzero(size < capacity)
        sequence[whole] = np.arange(len(whole))
        if len(part):
            for j, window in enumerate(pack_sizes(size[part], capacity)):
                at = part[window]
                sequence[at] = len(whole) + j
                offset[at] = np.cumsum(size[at]) - size[at]
        pdf["sequence_id"], pdf["offset"] = (int(key[0]) << 32) + sequence, offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # rows that repeat one document are dealt like any others: the place of a written row tells them apart
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(in_group, PACKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
