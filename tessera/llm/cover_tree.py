"""Exact top-k search by inner product: cover trees over queries and data, searched together.

Vectors are quantized to integers, and equal ones are one point with its k + 1 least ids, made one in each task before
anything is shuffled. Points are dealt to cells by their nearest pivot (pivots come from a bounded sample: ``SAMPLE`` rows
of the least hashes), and a cell of more than ``SHARD_ROWS`` points into shards; queries are dealt in the same way into
groups. Every shard and every group is a cover tree in flat arrays: a node's children are points of it that lie more than
its radius over ``BASE`` apart, each with what is nearest to it, and a node knows the distance to its farthest point.

A pair of a query node and a data node holds no score above ``cq.cr + |cq| Rr + |cr| Rq + Rq Rr`` (centres c, covering
radii R). Pairs under the worst k-th score of the query node are pruned, first between whole groups and shards, by their
roots alone, then within the pairs of trees that are left. Each group first meets the shard that promises most, whose hits
give the k-th scores; then all shards that may still hold more. Nothing else is skipped: results are exact, whatever the
sample was. Roots meet in blocks of ``BLOCK`` shards, so that no table of all shards is sent to every task.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part, nor do
vectors whose squared norm isn't finite as a double; an empty vector has the score 0 with other empty ones; a query meets
vectors of its own dimension only; ties go to the smaller id; rows that repeat an id are one candidate with its best score,
and a query with its best ones; scores are exact integers however large the components, and what is beyond a long is
returned as the nearest long; fewer than k candidates give them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, load, thrifty, written

LEAF, BASE, SHARD_ROWS, GROUP_ROWS, CELL_BYTES, SAMPLE, SAMPLE_BYTES, BLOCK = 16, 1.3, 4096, 512, 8 << 20, 8192, 16 << 20, 256
LONG = (1 << 63) - 1
#: Of the size of the products: what rounding can add to a bound.
SLACK = 1e-9


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v: rows that take part, as array<double> of components times the scale, rounded down."""
    v = F.col(vector_col).cast("array<double>")
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    src = src.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # rint of what is below: floor gives a long, which large components leave
    x = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return src.select("vec_id", x.alias("v")).where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < float("inf"))


def _pack(v: np.ndarray) -> tuple[bytes, bool]:
    """Two bytes a component where they fit: the same vector has the same bytes everywhere."""
    wide = bool(len(v)) and bool((np.abs(v) > 32767).any())
    return (v + 0.0).astype("<f8" if wide else "<i2").tobytes(), wide


def _matrix(data: list[bytes], wide: list[bool], dim: int) -> np.ndarray:
    out = np.zeros((len(data), dim))
    for i, (d, w) in enumerate(zip(data, wide, strict=True)):
        out[i] = np.frombuffer(d, dtype="<f8" if w else "<i2")
    return out


def points(src: DataFrame, keep: int | None) -> DataFrame:
    """(dim, wide, data, ids, h): each task's distinct vectors with their ``keep`` least ids, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bool, bytes], set[int]] = {}

        def rows() -> pa.RecordBatch:
            dims, wides, datas = zip(*known, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(wides), pa.array(datas, pa.binary()), pa.array([sorted(x)[:keep] for x in known.values()], pa.list_(pa.int64()))], ["dim", "wide", "data", "ids"])
            known.clear()
            return out

        for batch in batches:
            v, at = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                data, wide = _pack(v[a:b])
                ids = known.setdefault((b - a, wide, data), set())
                ids.add(i)
                if keep and len(ids) > 4 * keep + 64:
                    known[b - a, wide, data] = set(sorted(ids)[:keep])
            if len(known) > 50_000:
                yield rows()
        if known:
            yield rows()

    return src.mapInArrow(thrifty(run), "dim int, wide boolean, data binary, ids array<long>").withColumn("h", F.xxhash64("dim", "wide", "data"))


def pivots(table: DataFrame, shard_rows: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Per dimension, centres of cells of about shard_rows points, from the rows of the least hashes."""
    counts = {r.dim: r.n for r in table.groupBy("dim").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n")).limit(256).collect()}
    out: dict[int, np.ndarray] = {}
    for dim, n in list(counts.items())[:16]:  # rarer dimensions are one cell each, split by hash
        cells = min(-(-n // shard_rows), CELL_BYTES // (8 * max(1, dim)), sample // 4)
        if cells < 2:
            continue
        most = max(cells, min(sample, SAMPLE_BYTES // (8 * dim)))
        rows = table.where(F.col("dim") == dim).select("wide", "data", "h").orderBy("h", "data").limit(most).collect()
        x = _matrix([bytes(r.data) for r in rows], [r.wide for r in rows], dim)
        x = np.unique(x, axis=0)
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(np.int64)].copy()
        for _ in range(6):
            own = nearest_pivot(x, centres)
            for j in np.unique(own):
                centres[j] = x[own == j].mean(axis=0)
        out[dim] = centres
    return out


def nearest_pivot(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres * centres).sum(axis=1) - x @ centres.T).argmin(axis=1)


def in_cells(table: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """table with the cell of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(0).to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
            for dim, c in centres.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    part = batch.take(pa.array(at))
                    cell[at] = nearest_pivot(_matrix(part.column(2).to_pylist(), part.column(1).to_pylist(), dim), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["dim", "wide", "data", "ids", "h", "cell"])

    return table.select("dim", "wide", "data", "ids", "h").mapInArrow(thrifty(run), "dim int, wide boolean, data binary, ids array<long>, h long, cell int")


class CoverTree:
    """Flat arrays: x (points in an order in which a node's are together), start, stop, centre, radius, first child, kids."""

    FIELDS = ("x", "start", "stop", "centre", "radius", "first", "kids", "norm")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @staticmethod
    def build(x: np.ndarray, leaf: int = LEAF, base: float = BASE) -> tuple[CoverTree, np.ndarray]:
        """(the tree, the order of its points)."""
        order = np.arange(len(x))
        far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
        centre, start, stop, radius, first, kids = [int(far.argmin())], [0], [len(x)], [0.0], [-1], [0]
        i = 0
        while i < len(centre):
            a, b = start[i], stop[i]
            own_points = x[order[a:b]]
            best = np.sqrt(((own_points - x[centre[i]]) ** 2).sum(axis=1))
            radius[i] = float(best.max())
            if b - a > leaf and radius[i] > 0:
                heads, own = [centre[i]], np.zeros(b - a, dtype=np.int64)
                while best.max() > radius[i] / base:  # the farthest point is the next child
                    u = int(best.argmax())
                    d = np.sqrt(((own_points - own_points[u]) ** 2).sum(axis=1))
                    nearer = d < best
                    best[nearer], own[nearer] = d[nearer], len(heads)
                    heads.append(int(order[a + u]))
                sizes = np.bincount(own, minlength=len(heads))
                order[a:b] = order[a:b][np.argsort(own, kind="stable")]
                first[i], kids[i] = len(centre), len(heads)
                ends = a + np.cumsum(sizes)
                centre += heads
                start += (ends - sizes).tolist()
                stop += ends.tolist()
                radius += [0.0] * len(heads)
                first += [-1] * len(heads)
                kids += [0] * len(heads)
            i += 1
        at = np.empty(len(x), dtype=np.int64)
        at[order] = np.arange(len(x))
        x = x[order]
        centre_at = at[np.array(centre)]
        arrays = {"x": x, "start": np.array(start), "stop": np.array(stop), "centre": centre_at, "radius": np.array(radius), "first": np.array(first), "kids": np.array(kids)}
        return CoverTree(**arrays, norm=np.sqrt((x[centre_at] ** 2).sum(axis=1))), order

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes; leaves stay."""
        kids = self.kids[nodes]
        inner = np.flatnonzero(kids)
        total = kids[inner]
        out = np.repeat(self.first[nodes[inner]] - (np.cumsum(total) - total), total) + np.arange(total.sum())
        return np.concatenate([nodes[kids == 0], out])


class Best:
    """The k best (score, id) of each query so far, an id once."""

    def __init__(self, names: list[int], k: int, kth: np.ndarray):
        self.names, self.k, self.kth, self.found = names, k, kth.astype(float).copy(), [{} for _ in names]

    def add(self, i: int, scores: list[int], ids: list[list[int]]) -> None:
        own, name = self.found[i], self.names[i]
        for s, some in zip(scores, ids, strict=True):
            for j in some:
                if j != name and (j not in own or own[j] < s):
                    own[j] = s
        if len(own) > self.k:
            kept = sorted(own.items(), key=lambda e: (-e[1], e[0]))[: self.k]
            self.found[i] = own = dict(kept)
        if len(own) == self.k:
            self.kth[i] = max(self.kth[i], float(min(own.values())))


def dual_search(q: CoverTree, names: list[int], r: CoverTree, ids: list[list[int]], k: int, kth: np.ndarray, at_once: int = 256) -> tuple[Best, int]:
    """(the best of r's points for each of q's, the number of scores that were taken). kth: known lower bounds."""
    best, scored = Best(names, k, kth), 0
    q_size, r_size = np.sqrt((q.x**2).sum(axis=1)), np.sqrt((r.x**2).sum(axis=1))
    largest = r_size.max(initial=0.0)
    exact = float(q_size.max(initial=0.0)) * float(largest) < 2.0**53
    slack = SLACK * q_size * largest

    def base_case(a: int, b: int, cols: np.ndarray) -> None:
        nonlocal scored
        score = np.clip(q.x[a:b] @ r.x[cols].T, -(2.0**63), 2.0**63)
        scored += score.size
        open_ = score + slack[a:b, None] >= best.kth[a:b, None]
        for i in np.flatnonzero(open_.any(axis=1)).tolist():
            at, row = np.flatnonzero(open_[i]), score[i]
            if len(at) > k + 1:  # each point has an id of its own; one may be the query's
                at = at[row[at] + 2 * slack[a + i] >= np.partition(row[at], -(k + 1))[-(k + 1)]]
            if exact:
                values = [int(s) for s in row[at].tolist()]
            else:
                own = [int(v) for v in q.x[a + i].tolist()]
                values = [max(-LONG - 1, min(LONG, sum(u * int(v) for u, v in zip(own, r.x[c].tolist(), strict=True)))) for c in cols[at].tolist()]
            best.add(a + i, values, [ids[c] for c in cols[at].tolist()])

    def reach(a: int, b: int, refs: np.ndarray) -> np.ndarray:
        """By how much each query of a leaf may pass its k-th score in each node: a query alone has no radius."""
        return q.x[a:b] @ r.x[r.centre[refs]].T + q_size[a:b, None] * r.radius[refs] + slack[a:b, None] - best.kth[a:b, None]

    stack = [(0, np.zeros(1, dtype=np.int64))]
    while stack:
        node, refs = stack.pop()
        a, b = int(q.start[node]), int(q.stop[node])
        if q.kids[node]:
            bound = r.x[r.centre[refs]] @ q.x[q.centre[node]] + q.norm[node] * r.radius[refs] + (r.norm[refs] + r.radius[refs]) * q.radius[node]
            refs = refs[bound + slack[a:b].max() >= best.kth[a:b].min()]
            if len(refs):
                below = r.below(refs)
                stack += [(int(q.first[node]) + i, below) for i in range(int(q.kids[node]))]
            continue
        gain = reach(a, b, refs).max(axis=0)
        refs, gain = refs[gain >= 0], gain[gain >= 0]
        if r.kids[refs].any():
            # the nodes that promise most come first: their hits prune the others' children
            order = np.argsort(gain, kind="stable")
            stack += [(node, r.below(some)) for some in np.array_split(refs[order], min(8, len(refs)))]
            continue
        order = np.argsort(-gain, kind="stable")
        refs = refs[order]
        size, i, most = r.stop[refs] - r.start[refs], 0, at_once // 4
        while i < len(refs):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:]), most, "right")))
            some = refs[i:j]
            some = some[reach(a, b, some).max(axis=0) >= 0]
            if len(some):
                n = r.stop[some] - r.start[some]
                base_case(a, b, np.repeat(r.start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            i, most = j, at_once
    return best, scored


def _dump(tree: CoverTree, ids: list[list[int]]) -> bytes:
    out = io.BytesIO()
    arrays = {n: getattr(tree, n) for n in CoverTree.FIELDS}
    if not (np.abs(tree.x) > 32767).any():
        arrays["x"] = tree.x.astype("<i2")
    np.savez_compressed(out, ids=np.array([i for x in ids for i in x], dtype=np.int64), count=np.array([len(x) for x in ids]), **arrays)
    return out.getvalue()


def _held(data: bytes) -> tuple[CoverTree, list[list[int]]]:
    with np.load(io.BytesIO(data)) as z:
        arrays = dict(z)
    arrays["x"] = arrays["x"].astype(np.float64)
    ids, ends = arrays["ids"].tolist(), np.cumsum(arrays["count"]).tolist()
    return CoverTree(**{n: arrays[n] for n in CoverTree.FIELDS}), [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


TREES = "dim int, name long, n int, data binary, centre array<double>, radius double"


def trees(table: DataFrame, rows: int, keep: int | None, one_id: bool = False) -> DataFrame:
    """A cover tree for about ``rows`` points of a cell: dim, name, n, data, centre, radius; written in the shared folder.
    one_id: a point for each id, as queries are."""
    if one_id:
        table = table.select("dim", "wide", "data", F.explode("ids").alias("id"), "cell").distinct()
        table = table.select("dim", "wide", "data", F.array("id").alias("ids"), F.xxhash64("id", "data").alias("h"), "cell")
    table = written(table, "points")
    sizes = table.groupBy("dim", "cell").agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("h") / rows)).cast("int").alias("shards"))
    sizes = written(sizes, "cells")
    tasks = 2 * (sizes.agg(F.sum("shards")).first()[0] or 1)
    # a cell's number of shards comes by a join on few cells; cells that hold many rows are salted by the shard itself
    dealt = table.join(F.broadcast(sizes) if sizes.count() <= SAMPLE else sizes, ["dim", "cell"]).withColumn("shard", F.pmod("h", "shards").cast("int")).repartition(tasks, "dim", "cell", "shard")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell, shard = (int(x) for x in key)
        known: dict[tuple[bytes, int | None], tuple[bool, set[int]]] = {}
        for data, wide, ids in zip(pdf["data"], pdf["wide"], pdf["ids"], strict=True):
            known.setdefault((data, int(ids[0]) if one_id else None), (bool(wide), set()))[1].update(int(i) for i in ids)
        names = sorted(known, key=lambda e: (e[0], e[1] or 0))
        x = _matrix([d for d, _ in names], [known[e][0] for e in names], dim)
        tree, order = CoverTree.build(x)
        ids = [sorted(known[names[i]][1])[:keep] for i in order.tolist()]
        return pd.DataFrame({"dim": [dim], "name": [cell << 32 | shard], "n": [len(names)], "data": [_dump(tree, ids)], "centre": [tree.x[tree.centre[0]]], "radius": [tree.radius[0]]})

    return written(dealt.groupBy("dim", "cell", "shard").applyInPandas(build, TREES), "cover-trees")


def _blocks(index: DataFrame, n_shards: int) -> DataFrame:
    """dim, block, shards: the roots of up to about BLOCK shards in a row."""
    root = F.struct("name", "centre", "radius")
    return index.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(-(-n_shards // BLOCK))).cast("int")).groupBy("dim", "block").agg(F.collect_list(root).alias("shards"))


PAIRS = "dim int, grp long, name long, promise double"


def root_pairs(groups: DataFrame, blocks: DataFrame, n_blocks: int, copies: int, best_alone: bool) -> DataFrame:
    """Pairs of a group (dim, name, centre, radius, kth, met) and a shard, from their roots: the shard that promises most
    of each block, or all that can reach the group's worst k-th score but the one that it has met."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    asked = groups.select("dim", "name", "centre", "radius", "kth", "met", each).withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(copies)).cast("int")).withColumn("kind", F.lit(1)).withColumn("shards", F.lit(None).cast("array<struct<name:long,centre:array<double>,radius:double>>"))
    held = blocks.select("dim", "block", "shards", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).alias("kind"))
    rows = asked.unionByName(held, allowMissingColumns=True).select("dim", "block", "salt", "kind", "name", "centre", "radius", "kth", "met", "shards")
    keys = ["dim", "block", "salt"]
    dealt = rows.repartition(2 * n_blocks * copies, *keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shards = None, None
        for batch in batches:
            out: list[tuple] = []
            for dim, block, salt, kind, name, centre, radius, kth, met, row in zip(*[batch.column(i).to_pylist() for i in range(10)], strict=True):
                if kind == 0:
                    own = dim, block, salt
                    names, centres, radii = np.array([s["name"] for s in row]), np.array([s["centre"] for s in row]).reshape(len(row), dim), np.array([s["radius"] for s in row])
                    shards = names, centres, radii, np.sqrt((centres**2).sum(axis=1))
                elif own == (dim, block, salt):
                    names, centres, radii, norms = shards
                    c = np.array(centre, dtype=float)
                    size = np.sqrt((c**2).sum())
                    if best_alone:
                        promise = centres @ c
                        at = promise.argmax()
                        out.append((dim, name, int(names[at]), float(promise[at])))
                    else:
                        bound = (centres @ c + size * radii + (norms + radii) * radius) + SLACK * (size + radius) * (norms + radii)
                        out += [(dim, name, int(names[j]), float(bound[j])) for j in np.flatnonzero((bound >= kth) & (names != met)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.float64()], strict=True)], ["dim", "grp", "name", "promise"])

    return dealt.mapInArrow(thrifty(run), PAIRS)


HITS = "dim int, grp long, place int, query_id long, vec_id long, score long"


def met(pairs: DataFrame, groups: DataFrame, index: DataFrame, n_shards: int, k: int) -> DataFrame:
    """The k best of each pair's queries: groups (dim, name, data, known) stream through shards (dim, name, data)."""
    copies = max(1, -(-2 * index.sparkSession.sparkContext.defaultParallelism // max(1, n_shards)))  # follows the cores, not the rows
    g = groups.select("dim", F.col("name").alias("grp"), "data", "known")
    salt = F.pmod(F.xxhash64("grp"), F.lit(copies)).cast("int").alias("salt")
    asked = pairs.join(g, ["dim", "grp"]).select("dim", "name", salt, F.lit(1).alias("kind"), "grp", "data", "known")
    wanted = index.join(pairs.select("dim", "name").distinct(), ["dim", "name"], "left_semi")
    held = wanted.select("dim", "name", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).alias("kind"), "data")
    keys = ["dim", "name", "salt"]
    rows = asked.unionByName(held, allowMissingColumns=True).select(*keys, "kind", "grp", "data", "known").repartition(2 * max(1, n_shards) * copies, *keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, name, salt_, kind, grp, data, known = (batch.column(j)[i].as_py() for j in range(7))
                if kind == 0:
                    own, shard = (dim, name, salt_), _held(data)
                    continue
                if own != (dim, name, salt_):
                    raise ValueError("a group came without its shard")
                tree, ids = _held(data)
                names, kth = [x[0] for x in ids], np.full(len(ids), -np.inf)
                for e in known or []:
                    if e["kth"] is not None and e["kth"] > -LONG - 1:
                        kth[e["place"]] = e["kth"]
                best, _ = dual_search(tree, names, *shard, k, kth)
                rows_ = [(dim, grp, place, names[place], j, s) for place, found in enumerate(best.found) for j, s in found.items()]
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_, strict=True), [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)], [f.split()[0] for f in HITS.split(", ")])

    return rows.mapInArrow(thrifty(run), HITS)


def top_k(df: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``."""
    lean(df.sparkSession)
    src = vectors(df, id_col, vector_col, scale)
    data = written(points(src, k + 1), "vectors")
    centres = pivots(data, shard_rows, sample)
    index = trees(in_cells(data, centres), shard_rows, k + 1)
    groups = trees(in_cells(points(src.where(F.col("vec_id") % every == 0), None), centres), group_rows, None, one_id=True)
    n_shards = max(1, index.count())
    n_blocks, copies = -(-n_shards // BLOCK), max(1, 2 * df.sparkSession.sparkContext.defaultParallelism)
    blocks = _blocks(index, n_shards)
    fresh = groups.withColumns({"kth": F.lit(float("-inf")), "met": F.lit(None).cast("long"), "known": F.lit(None).cast("array<struct<place:int,kth:long>>")})
    promised = root_pairs(fresh, blocks, n_blocks, copies, best_alone=True)
    first = written(promised.groupBy("dim", "grp").agg(F.max_by("name", F.struct("promise", "name")).alias("name")), "first-pairs")
    hits = written(met(first, fresh, index, n_shards, k), "first-hits")
    kth = hits.groupBy("dim", "grp", "place").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = kth.groupBy("dim", F.col("grp").alias("name")).agg(F.collect_list(F.struct("place", "kth")).alias("known"), F.min(F.coalesce("kth", F.lit(-LONG - 1))).alias("worst"), F.count("*").alias("places"))
    again = groups.join(known, ["dim", "name"], "left").join(first.select("dim", F.col("grp").alias("name"), F.col("name").alias("met")), ["dim", "name"], "left")
    worst = F.when((F.col("places") == F.col("n")) & (F.col("worst") > -LONG - 1), F.col("worst").cast("double")).otherwise(float("-inf"))
    again = written(again.select("dim", "name", "data", "centre", "radius", "known", "met", worst.alias("kth")), "groups")
    left = written(root_pairs(again, blocks, n_blocks, copies, best_alone=False), "pairs")
    hits = hits.unionByName(met(left, again, index, n_shards, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
