"""Exact Jaccard self-join of documents on word shingles, as a grouped prefix join, and the classes that links make.

1. A sketch of two rows of counters, as many as the number of shingles asks for, counts every shingle of every document.
   Its counts, as powers of two, and the shingle's hash put all shingles in one order, rare ones first.
2. Two sets of Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each in this order (the prefix).
   Documents of equal sets become one node; nodes of identical prefix and size become one group.
3. Groups that share a prefix shingle meet in its bucket. First every group meets the bucket's pivot alone, the group
   with the fewest rarer shingles; group pairs that pass the size and position filters are expanded to their members
   and verified on the whole sets, and links make components.
4. Then group pairs of a bucket that still hold different components are expanded and verified, but for pairs that
   were; in a large bucket the members' texts meet, and only links between components leave it. So no pair of different
   texts within the threshold is lost, and a bucket of copies costs its size, not its square: pairs that are already
   connected aren't emitted.
5. No text travels for a pair that can't link: each set has a parity bitmap, a bit or two for each shingle, and the bits
   in which two bitmaps differ are a lower bound of the shingles in which the sets do.

A frequent shingle's bucket is dealt into sub-buckets by its sketched count, each with a pivot, and the pivots meet.

Edge cases: null, empty and wordless texts have no shingles, link with nothing and are their own component; texts of
fewer words than ``size`` are one shingle; null doc_ids are kept and don't count for the smallest id (a component of
null ids alone has a null id); rows of the same doc_id are documents of their own; an empty table gives no rows; other
columns are ignored. Sets and groups are named by 64-bit hashes and checked by second ones: if one name had two checks,
the join would start again under another seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import array_sum, id_filter
from .common import hot_keys, id_text, load, salted_join, thrifty, whole_keys, written
from .components import components
from .shingles import SEED, Shingler, U, mixed

#: The sketch: two rows of at least so many counters, more by the number of shingles.
COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 25
#: Buckets of more groups than this are verified where they meet.
LARGE = 48
#: A token of more rows than this, by its sketched count, is dealt into sub-buckets of about so many.
SUB_BUCKET = 1 << 12


def enough(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t n): the least intersection of a set of n with any set within the threshold."""
    return -(-(n * percent) // 100)


def overlap_needed(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection: 100 c >= percent (n1 + n2 - c)."""
    return -(-(percent * (n1 + n2)) // (100 + percent))


class Sketch:
    """1024 log2 of counts, the less of two rows, each indexed by other bits of the hash."""

    def __init__(self, counts: np.ndarray, total: int):
        self.level = np.round(1024 * np.log2(np.maximum(1, counts))).astype(np.uint16)
        self.width = len(self.level) // 2
        #: what a sub-bucket holds: well above what a counter gets from shingles that share it by chance
        self.capacity = max(SUB_BUCKET, 4 * total // self.width)

    def levels(self, s: np.ndarray) -> np.ndarray:
        one, two = sketch_places(s, self.width)
        return np.minimum(self.level[one], self.level[two])

    def doubled(self, levels: np.ndarray) -> np.ndarray:
        """The log of the number of sub-buckets that a token's groups are dealt to."""
        return np.maximum(0, (levels >> 10).astype(np.int64) - self.capacity.bit_length() + 2).astype(np.uint8)


def sketch_places(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    bits = width.bit_length() - 1
    return (s >> U(64 - bits)).astype(np.int64), ((s & U(width - 1)) + U(width)).astype(np.int64)


def sketch(src: DataFrame, size: int, seed: int) -> Sketch:
    """Counts of each document's distinct shingles; the width follows the number of bytes, about six to a word."""
    n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_COUNTERS, max(COUNTERS, 1 << (n_bytes // 6 // SUB_BUCKET).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        shingler, total, pending, n = Shingler(size, seed), None, [], 0

        def settle() -> None:
            every = np.concatenate(pending)
            total[-64] += len(every)
            one, two = sketch_places(every, width)
            total[:width] += np.bincount(one, minlength=width)
            total[width:-64] += np.bincount(two - width, minlength=width)

        for batch in batches:
            total = np.zeros(2 * width + 64, dtype=np.int64) if total is None else total
            for s in shingler.sets(batch.column(0)):
                pending.append(s)
                n += len(s)
                if n > 500_000:
                    settle()
                    pending, n = [], 0
        if pending:
            settle()
        return total

    total = array_sum(src.select("text"), 2 * width + 64, count)
    return Sketch(total[:-64], int(total[-64]))


SIGNATURE = "doc_id long, th long, n long, sid long, check long, gid long, group_check long, prefix binary, dealt binary, bits binary"


def signatures(src: DataFrame, known: Sketch, size: int, percent: int, seed: int) -> DataFrame:
    """doc_id, th (hash of the text), n, sid (hash of the set) and its check, gid (hash of prefix and size) and its check,
    prefix (hashes in order), dealt (logs of their sub-buckets), bits (the set's parity bitmap)."""
    shared = src.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.binary()) for c in SIGNATURE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(size, seed), shared.value
        for batch in batches:
            n, rows = [], [[] for _ in range(7)]
            for s in shingler.sets(batch.column(1)):
                n.append(len(s))
                if not len(s):
                    for column in rows:
                        column.append(None)
                    continue
                levels = known.levels(s)
                first = np.argsort(levels, kind="stable")[: len(s) - int(enough(np.int64(len(s)), percent)) + 1]
                tokens = s[first]
                values = (_folded(mixed(s), len(s)), _check(s), _folded(mixed(tokens), len(s)), _check(tokens), tokens.tobytes(), known.doubled(levels[first]).tobytes(), bitmap(s))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([batch.column(0), batch.column(2), n, *rows], schema, strict=True)], schema=schema)

    return src.withColumn("th", F.xxhash64("text")).mapInArrow(thrifty(run), SIGNATURE)


def _check(s: np.ndarray) -> int:
    """A second order-free hash of a set, independent of the first."""
    return int(np.array([np.add.reduce(mixed(s ^ U(0xA0761D6478BD642F)))], dtype=U).astype(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each place of a set's shingles, by the hash's lower bits: whether an odd number of them falls there."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded_map(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: their halves one on the other."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_link(n1: np.ndarray, bits1: list[bytes], n2: np.ndarray, bits2: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets differ in few enough bits: a pair within the threshold always does."""
    most = n1 + n2 - 2 * overlap_needed(n1, n2, percent)
    width1, width2 = (np.array([len(x) // 8 for x in bits], dtype=np.int64) for bits in (bits1, bits2))
    out = np.zeros(len(n1), dtype=bool)
    for key in np.unique(width1 << 32 | width2).tolist():
        at = np.flatnonzero((width1 == key >> 32) & (width2 == key & 0xFFFFFFFF))
        words = min(key >> 32, key & 0xFFFFFFFF)
        x, y = (_folded_map(np.frombuffer(b"".join([bits[i] for i in at.tolist()]), dtype="<u8").reshape(len(at), -1), words) for bits in (bits1, bits2))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[at]
    return out


def _folded(h: np.ndarray, n: int) -> int:
    """An order-free hash of a set, as a signed 64-bit integer."""
    total = int(np.add.reduce(h)) + n * 0x2545F4914F6CDD1D & ((1 << 64) - 1)
    return int(mixed(np.array([total], dtype=U)).astype(np.int64)[0])


def token_rows(sig: DataFrame) -> DataFrame:
    """A row for each token of a group's prefix, in three longs: key (the token, or token and sub-bucket), gid, meta.

    A task emits a group once, however many copies it reads; buckets make the rows of different tasks distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                fresh = [g is not None and g not in seen and not seen.add(g) for g in part.column(0).to_pylist()]
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                gid, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                prefix, dealt = part.column(2).to_pylist(), part.column(3).to_pylist()
                size = np.array([len(x) for x in dealt])
                doubled = np.frombuffer(b"".join(dealt), dtype=np.uint8).astype(np.int64)
                g = np.repeat(gid, size)
                pos = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
                meta = np.repeat(n, size) << 35 | pos << 7 | doubled
                key = np.frombuffer(b"".join(prefix), dtype=np.int64) ^ _turn(_sub(g, doubled))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(g), pa.array(meta)], ["key", "gid", "meta"])

    return sig.select("gid", "n", "prefix", "dealt").mapInArrow(thrifty(run), "key long, gid long, meta long")


def _sub(gid: np.ndarray, doubled: np.ndarray) -> np.ndarray:
    """The sub-bucket of a group among 2^doubled."""
    return mixed(gid.astype(U)).astype(np.int64) & (np.left_shift(1, doubled) - 1)


def _turn(sub: np.ndarray) -> np.ndarray:
    return (sub.astype(U) * U(0x9E3779B97F4A7C15)).astype(np.int64)


def passes(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filters: what is left of the sets from the shared token on must suffice.

    Tokens before position p may be common too, p1 and p2 at most: this bound holds whether or not the token is the
    first in common.
    """
    n1, n2, p1, p2 = (x.astype(np.int64) for x in (n1, n2, p1, p2))
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (most >= overlap_needed(n1, n2, percent))


def with_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Star edges and the rows of buckets that hold three groups or more (the one pair of a bucket of two is an edge).

    kind 0: an edge (gid, other); 1: a row of its bucket (tok, sub, gid, n, pos), which later steps need; 2: a pivot of
    a sub-bucket, which must meet the token's other pivots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, ["key"]):
            key, gid, meta = (t.column(c).to_numpy() for c in ("key", "gid", "meta"))
            n, pos, dealt = meta >> 35, meta >> 7 & (1 << 28) - 1, meta & 127
            sub = _sub(gid, dealt)
            tok = key ^ _turn(sub)
            order = np.lexsort((gid, pos, sub, tok))
            order = order[np.concatenate(([True], (np.diff(tok[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(gid[order]) != 0)))]
            tok, sub, gid, n, pos, dealt = (x[order] for x in (tok, sub, gid, n, pos, dealt))
            new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (sub[1:] != sub[:-1])))
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(tok)))
            pivot = np.repeat(start, length)
            edge = np.flatnonzero(~new & passes(n, pos, n[pivot], pos[pivot], percent))
            # each pair once here; the whole input's pairs are made distinct later
            pair = np.unique(np.stack([np.minimum(gid[edge], gid[pivot[edge]]), np.maximum(gid[edge], gid[pivot[edge]])]), axis=1)
            kept = np.flatnonzero((np.repeat(length, length) > 2) | (dealt > 0))
            lead = np.flatnonzero(new & (dealt > 0))
            for kind, at in ((1, kept), (2, lead)):
                yield _rows(kind, tok[at], sub[at], gid[at], n[at], pos[at], np.zeros(len(at), dtype=np.int64))
            zero = np.zeros(pair.shape[1], dtype=np.int64)
            yield _rows(0, zero, zero, pair[0], zero, zero, pair[1])

    return rows.mapInArrow(thrifty(run), "kind int, tok long, sub int, gid long, n int, pos int, other long")


def _rows(kind: int, tok, sub, gid, n, pos, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(tok), kind, dtype=np.int32)), pa.array(tok.astype(np.int64)), pa.array(sub.astype(np.int32)), pa.array(gid), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(other)], ["kind", "tok", "sub", "gid", "n", "pos", "other"])


def bucket_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Group pairs (g1, g2) of each bucket (tok, low, high) that pass the filters and aren't all of one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, ["tok", "low", "high"]):
            tok, low, high, sub, gid, n, pos, least, most = (t.column(c).to_numpy() for c in ("tok", "low", "high", "sub", "gid", "n", "pos", "cmin", "cmax"))
            order = np.lexsort((n, high, low, tok))
            tok, low, high, sub, gid, n, pos, least, most = (x[order] for x in (tok, low, high, sub, gid, n, pos, least, most))
            new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            last = np.append(np.flatnonzero(new)[1:], len(tok))[np.cumsum(new) - 1]  # the end of each row's bucket
            at = np.arange(len(tok))
            seen = np.zeros((2, 0), dtype=np.int64)
            step = 1
            while len(at := at[at + step < last[at]]):
                other = at + step
                # ascending n: once a row is too small for one, it is for all that follow
                near = 100 * n[at].astype(np.int64) >= percent * n[other].astype(np.int64)
                at, other = at[near], other[near]
                good = (sub[at] != sub[other]) | (low[at] == high[at])
                good &= (least[at] != least[other]) | (least[at] != most[at]) | (least[other] != most[other])
                good &= passes(n[at], pos[at], n[other], pos[other], percent)
                x, y = gid[at[good]], gid[other[good]]
                seen = np.concatenate([seen, np.stack([np.minimum(x, y), np.maximum(x, y)])], axis=1)
                if seen.shape[1] > 500_000:
                    seen = np.unique(seen, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1])], ["g1", "g2"])
                    seen = seen[:, :0]
                step += 1
            seen = np.unique(seen, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1])], ["g1", "g2"])

    return rows.mapInArrow(thrifty(run), "g1 long, g2 long")


def texts_of(src: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """(sid, zipped) for each sid in wanted, and a few more: the text, compressed, of one document that has the set.

    The documents are found by a filter of ids, or, of more than it may hold, by a join. A repeated row may come once from
    each task.
    """
    one = written(classes.join(wanted, "sid", "left_semi").select(F.col("rep").alias("doc_id")), "wanted")
    known = id_filter(one)
    if known is None:
        src = src.where("doc_id is null").unionByName(src.join(one, "doc_id", "left_semi"))
    allowed = src.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, seen = Shingler(size, seed), allowed.value, set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if known is not None:
                texts = texts.filter(pa.array(ids.is_null().to_numpy(zero_copy_only=False) | known.has(ids.fill_null(0).to_numpy())))
            sid, zipped = [], []
            for text, s in zip(texts, shingler.sets(texts), strict=True):
                key = _folded(mixed(s), len(s)) if len(s) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    sid.append(key)
                    zipped.append(zlib.compress(text.as_buffer(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(zipped, pa.binary())], ["sid", "zipped"])

    return src.mapInArrow(thrifty(run), "sid long, zipped binary")


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sids, a < b, that sizes and bitmaps let link; written."""
    ends_ = classes.select("sid", "n", "bits")
    one = salted_join(pairs, ends_.toDF("a", "n1", "bits1"), "a", hot_keys(pairs, "a"), ["b"])
    both = salted_join(one, ends_.toDF("b", "n2", "bits2"), "b", hot_keys(pairs, "b"), ["a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n1, bits1, n2, bits2 = batch.columns
            n1, n2 = n1.to_numpy(), n2.to_numpy()
            good = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
            good &= may_link(n1, bits1.to_pylist(), n2, bits2.to_pylist(), percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    return written(both.select("a", "b", "n1", "bits1", "n2", "bits2").mapInArrow(thrifty(run), "a long, b long"), "promising")


def large_promising(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (tok, low, high, sub, sid) of large buckets that some row of another component there may link with, by sizes and bitmaps.

    rows: tok, low, high, sub, sid, comp, n, bits; sorted by bucket. Each row is held against its bucket's, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, ["tok", "low", "high"]):
            tok, low, high, comp, n = (t.column(c).to_numpy() for c in ("tok", "low", "high", "comp", "n"))
            edge = np.flatnonzero((np.diff(tok) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            good = np.zeros(len(tok), dtype=bool)
            bits = t.column("bits").to_pylist()
            for bucket in np.split(np.arange(len(tok)), edge):
                good[bucket] = _has_partner(n[bucket], comp[bucket], [bits[i] for i in bucket.tolist()], percent)
            yield from t.select(["tok", "low", "high", "sub", "sid", "comp"]).filter(pa.array(good)).to_batches()

    return rows.select("tok", "low", "high", "sub", "sid", "comp", "n", "bits").mapInArrow(thrifty(run), "tok long, low int, high int, sub int, sid long, comp long")


def _has_partner(n: np.ndarray, comp: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which rows of a bucket may link with a row of another component."""
    good = np.zeros(len(n), dtype=bool)
    if (comp == comp[0]).all():
        return good
    width = np.array([len(x) // 8 for x in bits])
    maps = {w: (at := np.flatnonzero(width == w), np.frombuffer(b"".join([bits[i] for i in at.tolist()]), dtype="<u8").reshape(len(at), -1)) for w in np.unique(width).tolist()}
    for w, (at, rows) in maps.items():
        for other_w in (w, w // 2):  # sizes within the threshold have maps of one width, or of neighbouring ones
            if other_w not in maps:
                continue
            other, theirs = maps[other_w]
            mine = _folded_map(rows, other_w)
            for i, row in zip(at.tolist(), mine, strict=True):
                near = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
                if not len(near) or (good[i] and good[near].all()):
                    continue
                far = np.bitwise_count(theirs[np.searchsorted(other, near)] ^ row).sum(axis=1, dtype=np.int64)
                hit = near[far <= n[near] + n[i] - 2 * overlap_needed(n[near], n[i], percent)]
                if len(hit):
                    good[i] = True
                    good[hit] = True
    return good


def large_links(rows: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """Links (a, b) between components in large buckets (tok, low, high), verified on the whole sets in the bucket.

    rows: tok, low, high, sub, sid, comp, zipped. A document that keeps too few shingles that others of the bucket have
    can't link; the rest meet by postings, but for pairs that are already connected. At most one link for each pair of
    components comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, seed)
        for t in whole_keys(batches, ["tok", "low", "high"], least=2000):
            tok, low, high, sub, sid = (t.column(c).to_numpy() for c in ("tok", "low", "high", "sub", "sid"))
            order = np.lexsort((sid, sub, high, low, tok))
            order = order[np.concatenate(([True], (np.diff(tok[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(sid[order]) != 0)))]
            change = (np.diff(tok[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            for bucket in np.split(order, np.flatnonzero(change) + 1):
                comp = t.column("comp").take(pa.array(bucket)).to_numpy()
                if (comp == comp[0]).all():
                    continue
                links = _bucket_links(shingler, t.column("zipped").take(pa.array(bucket)), comp, percent)
                if links:
                    a, b = (sid[bucket[[x[i] for x in links]]] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(thrifty(run), "a long, b long")


def _bucket_links(shingler: Shingler, zipped: pa.Array, comp: np.ndarray, percent: int, at_once: int = 6_000_000) -> list[tuple[int, int]]:
    """Positions of linked documents, by blocks of documents of so many shingles together."""
    block, blocks, held = [], [], 0
    for i, z in enumerate(zipped):
        s = next(shingler.sets(pa.array([zlib.decompress(z.as_buffer()).decode()], pa.large_string())))
        block.append((i, s))
        held += len(s)
        if held > at_once:  # rare: the sets of a block's documents are made anew for each pair of blocks
            blocks.append([i for i, _ in block])
            block, held = [], 0
    if not blocks:
        return _met([i for i, _ in block], [s for _, s in block], comp, percent)
    blocks.append([i for i, _ in block])
    out = []
    for x in range(len(blocks)):
        for y in range(x, len(blocks)):
            at = blocks[x] + (blocks[y] if y > x else [])
            texts = [zlib.decompress(zipped[i].as_buffer()).decode() for i in at]
            out += _met(at, list(shingler.sets(pa.array(texts, pa.large_string()))), comp, percent)
    return out


def _met(at: list[int], sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    n = np.array([len(s) for s in sets], dtype=np.int64)
    doc, items = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    _, token, times = np.unique(items, return_inverse=True, return_counts=True)
    alive = n > 0
    while True:  # shingles of one document alone count for no link; documents with too many of them go
        good = alive[doc] & (times[token] > 1)
        few = np.bincount(doc[good], minlength=len(n)) < enough(n, percent)
        if not (alive & few).any():
            break
        alive &= ~few
        times = np.bincount(token[alive[doc]], minlength=len(times))
    doc, token = doc[good], token[good]
    order = np.argsort(token, kind="stable")
    posting, start = doc[order], np.searchsorted(token[order], np.arange(len(times) + 1))
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    root = comp[at].copy()
    names, size = np.unique(root[alive], return_counts=True)
    if len(names) < 2:
        return []
    out = []
    most = names[size.argmax()]
    for x in np.flatnonzero(alive & (root != most)).tolist():
        other = alive & (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not other.any():
            continue
        common = np.zeros(len(n), dtype=np.int64)
        for w in token[bounds[x] : bounds[x + 1]].tolist():
            common[posting[start[w] : start[w + 1]]] += 1
        for y in np.flatnonzero(other & (common >= overlap_needed(n, n[x], percent))).tolist():
            if root[y] != root[x]:
                out.append((at[x], at[y]))
                root[root == root[y]] = root[x]
    return out


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))


def verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of sids whose whole sets are within the threshold. Compressed texts travel: sets are thrice as long."""
    one = salted_join(pairs, texts.toDF("a", "x"), "a", hot_keys(pairs, "a"), ["b"])
    both = salted_join(one, texts.toDF("b", "y"), "b", hot_keys(pairs, "b"), ["a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                a, b, left, right = batch.slice(at, 200).columns
                zipped = dict(zip([*a.to_pylist(), *b.to_pylist()], [*left, *right], strict=True))
                sets = dict(zip(zipped, shingler.sets(pa.array([zlib.decompress(z.as_buffer()).decode() for z in zipped.values()], pa.large_string())), strict=True))
                keep = []
                for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                    z = np.sort(np.concatenate([sets[x], sets[y]]))
                    common = int(np.count_nonzero(z[1:] == z[:-1]))
                    keep.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return written(both.select("a", "b", "x", "y").mapInArrow(thrifty(run), "a long, b long").distinct(), "links")


def by_bucket(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys, each partition in the keys' order: what is done with a bucket streams over it."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def named_sets(src: DataFrame, size: int, percent: int, seeds: range = range(SEED, SEED + 8)) -> tuple[DataFrame, DataFrame, int]:
    """(signatures of all rows, distinct sets: sid, rep, gid, n, bits, copies; the seed of the hashes)."""
    for seed in seeds:
        sig = written(signatures(src, sketch(src, size, seed), size, percent, seed), "signatures")
        sets = sig.where("n > 0").groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.min("gid").alias("gid"), F.max("gid").alias("gid2"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.count("*").alias("copies"),
            F.min("check").alias("low"), F.max("check").alias("high"), F.min("group_check").alias("of_group"),
        )
        sets = written(sets, "classes")
        groups = sets.groupBy("gid").agg(F.min("of_group").alias("a"), F.max("of_group").alias("b"))
        if sets.where("low <> high or gid <> gid2").isEmpty() and groups.where("a <> b").isEmpty():
            return sig, sets.select("sid", "rep", "gid", "n", "bits", "copies"), seed
    raise RuntimeError("sets share names under every seed")


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, comp (a key of the component; null without shingles), component_id, for each row of docs."""
    src = id_text(docs)
    sig, classes, seed = named_sets(src, size, percent)
    some = sig.where("n > 0")
    lead = classes.groupBy("gid").agg(F.min("sid").alias("lead"))

    met = written(with_pivots(by_bucket(token_rows(some), "key"), percent), "buckets")
    top_meta = F.shiftleft(F.col("n").cast("long"), 35) + F.shiftleft(F.col("pos").cast("long"), 7)
    tops = met.where("kind = 2").select(F.col("tok").alias("key"), "gid", top_meta.alias("meta"))
    more = with_pivots(by_bucket(tops, "key"), percent).where("kind = 0")
    star = written(met.where("kind = 0").select("gid", "other").union(more.select("gid", "other")).distinct(), "star")
    g1, g2 = (lead.select(F.col("gid").alias(g), F.col("lead").alias(s)) for g, s in (("gid", "a"), ("other", "b")))
    within = classes.join(lead, "gid").where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    tested = salted_join(salted_join(star, g1, "gid", hot_keys(star, "gid"), ["other"]), g2, "other", hot_keys(star, "other"), ["gid"]).select("a", "b").union(within)
    tested = written(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
    first = promising(tested, classes, percent)
    links = verified(written(texts_of(src, classes, ends(first).distinct(), size, seed), "texts"), first, size, percent, seed)

    comp = components(links)
    placed = written(classes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", "gid", "n", "bits", F.coalesce("comp", "sid").alias("comp")), "placed")
    of_group = placed.groupBy("gid").agg(F.min("comp").alias("cmin"), F.max("comp").alias("cmax"))
    rows = written(met.where("kind = 1").select("tok", "sub", "gid", "n", "pos").join(of_group, "gid"), "bucket-rows")
    counted = rows.groupBy("tok").agg(F.min("cmin").alias("lo"), F.max("cmax").alias("hi"), F.max("sub").alias("subs"), F.count("*").alias("n_rows"))
    counted = written(counted.where("lo <> hi").select("tok", "subs", (F.col("n_rows") > LARGE).alias("large")), "bucket-sizes")

    def blocks(large: bool) -> DataFrame:
        out = rows.join(counted.where(F.col("large") == large), "tok").withColumn("with", F.explode(F.sequence(F.lit(0), "subs")))
        return out.select("tok", F.least("sub", "with").alias("low"), F.greatest("sub", "with").alias("high"), "sub", "gid", "n", "pos", "cmin", "cmax")

    # star pairs again: their groups' other members haven't met
    pairs = bucket_pairs(by_bucket(blocks(False), "tok", "low", "high"), percent).union(star).distinct()
    m1, m2 = (placed.select(F.col("gid").alias(g), F.col("sid").alias(s), F.col("comp").alias(c)) for g, s, c in (("g1", "a", "ca"), ("g2", "b", "cb")))
    inside = placed.join(of_group.where("cmin <> cmax").select("gid"), "gid", "left_semi")
    i1, i2 = (inside.select("gid", F.col("sid").alias(s), F.col("comp").alias(c)) for s, c in (("a", "ca"), ("b", "cb")))
    rest = pairs.join(m1, "g1").join(m2, "g2").where("ca <> cb").select("a", "b").union(i1.join(i2, "gid").where("ca <> cb and a < b").select("a", "b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    rest = promising(written(rest, "rest"), classes, percent)
    meeting = blocks(True).select("tok", "low", "high", "sub", "gid").join(placed.select("gid", "sid", "comp", "n", "bits"), "gid")
    meeting = written(large_promising(by_bucket(meeting, "tok", "low", "high"), percent), "meeting")
    wanted = ends(rest).union(meeting.select("sid")).distinct()
    if not wanted.isEmpty():
        texts = written(texts_of(src, classes, wanted, size, seed), "texts")
        dealt = by_bucket(meeting.join(texts, "sid").select("tok", "low", "high", "sub", "sid", "comp", "zipped"), "tok", "low", "high")
        late = written(verified(texts, rest, size, percent, seed).union(large_links(dealt, size, percent, seed)), "late")
        if not late.isEmpty():
            comp = components(links.union(late))
    whole = written(classes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", "copies", F.coalesce("comp", "sid").alias("comp")), "whole")
    named = salted_join(whole, whole.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp", hot_keys(whole, "comp"), ["sid"]).select("sid", "comp", "component_id")
    hot = hot_keys(whole, "sid", count="copies")
    own = some.select("doc_id", "th", F.col("n").alias("n_shingles"), "sid")
    out = salted_join(own, named, "sid", hot, [F.spark_partition_id()]).drop("sid")
    alone = sig.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, for each row of docs."""
    return jaccard_classes(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def set_links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, n_shingles, sid for each row of docs; links: a < b, every pair of distinct sets within the threshold).

    The buckets are those of the components, but no pair is left out for being connected: what is verified follows the
    number of candidate pairs, so a group of differing near copies costs its square, as its links do.
    """
    src = id_text(docs)
    sig, classes, seed = named_sets(src, size, percent)
    met = written(with_pivots(by_bucket(token_rows(sig.where("n > 0")), "key"), percent), "buckets")
    # the pair of a bucket of two is an edge only; the row of every other bucket is there, and so are its pairs
    edges = met.where("kind = 0").select(F.col("gid").alias("g1"), F.col("other").alias("g2"))
    # ends that differ: no pair counts as connected
    rows = met.where("kind = 1").select("tok", "sub", "gid", "n", "pos", F.lit(0).cast("long").alias("cmin"), F.lit(1).cast("long").alias("cmax"))
    rows = written(rows, "bucket-rows")
    subs = rows.groupBy("tok").agg(F.max("sub").alias("subs"))
    dealt = rows.join(subs, "tok").withColumn("with", F.explode(F.sequence(F.lit(0), "subs")))
    dealt = dealt.select("tok", F.least("sub", "with").alias("low"), F.greatest("sub", "with").alias("high"), "sub", "gid", "n", "pos", "cmin", "cmax")
    pairs = bucket_pairs(by_bucket(dealt, "tok", "low", "high"), percent).union(edges).distinct()
    x, y = (classes.select(F.col("gid").alias(g), F.col("sid").alias(s)) for g, s in (("g1", "a"), ("g2", "b")))
    across = pairs.where("g1 <> g2").join(x, "g1").join(y, "g2").select("a", "b")
    i, j = (classes.select("gid", F.col("sid").alias(s)) for s in ("a", "b"))
    inside = i.join(j, "gid").where("a < b").select("a", "b")
    rest = across.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = promising(written(rest, "rest"), classes, percent)
    texts = written(texts_of(src, classes, ends(rest).distinct(), size, seed).dropDuplicates(["sid"]), "texts")
    return sig.select("doc_id", F.col("n").alias("n_shingles"), "sid"), verified(texts, rest, size, percent, seed)


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """a, b: every pair of distinct shingle sets within the threshold, each by the least doc_id of its rows, and copies_a and
    copies_b, the numbers of rows that have the sets."""
    rows, links = set_links(docs, size, percent)
    of = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    x, y = (of.select(F.col("sid").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("copies").alias(f"copies_{s}")) for s in ("a", "b"))
    return links.join(x, "a").join(y, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "copies_a", "copies_b")


def link_counts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links, for each row of docs: the other rows whose sets are equal or within the threshold."""
    rows, links = set_links(docs, size, percent)
    of = rows.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    both = links.union(links.select("b", "a")).toDF("sid", "other")
    linked = both.join(of.toDF("other", "others"), "other").groupBy("sid").agg(F.sum("others").alias("others"))
    each = of.join(linked, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    hot = hot_keys(of, "sid", count="copies")
    out = salted_join(rows.where("sid is not null"), each, "sid", hot, [F.spark_partition_id()]).select("doc_id", "n_shingles", "n_links")
    return out.unionByName(rows.where("sid is null").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns kept, with one document of each component: the least doc_id, nulls last; ties by the text's hash.

    Documents without shingles are all kept. Rows are told apart by id and text hash. A filter of those that go, and of
    repeated rows, is held against docs; only rows that pass it are joined, and only their texts travel.
    """
    rows = jaccard_classes(docs, size, percent).where("comp is not null").groupBy("comp", "doc_id", "th").count()
    rows = written(rows, "classes-of-rows")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("best"))
    marked = salted_join(rows, best, "comp", hot_keys(rows, "comp"), ["doc_id", "th"])
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    ident, key = ["_none", "_id", "_th"], F.xxhash64("doc_id", "th")
    marked = marked.withColumn("_stays", stays).where("not _stays or count > 1").select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_th"), "_stays", "count", key.alias("_key"))
    marked = written(marked, "going")
    known = id_filter(marked.select("_key"))
    allowed = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def named(keys: pd.Series) -> pd.Series:
        return pd.Series(np.ones(len(keys), dtype=bool) if allowed.value is None else allowed.value.has(keys.to_numpy()))

    # under names of their own: whatever the documents' columns are called
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    plain = plain.withColumn("_passes", named(key))
    some = plain.where("_passes").select("_row", F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_th"))
    hot = hot_keys(marked, *ident, count="count")
    met = salted_join(some, marked.select(*ident, "_stays"), ident, hot, [F.spark_partition_id()], "left").where("_stays is null or _stays")
    once = met.where("_stays").groupBy(*ident).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = [plain.where("not _passes").select("_row.*"), met.where("_stays is null").select("_row.*"), once.select("_row.*")]
    return reduce(DataFrame.unionAll, kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


#: op9's rows in SQL: all pairs that share a shingle, and everything that can be reached over links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reached.other) AS component_id FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
