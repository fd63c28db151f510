"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one node that keeps its k + 1 least ids, which is all that a result of k rows can hold; a task makes
them one before anything is shuffled. Nodes are dealt into shards of about ``shard_rows`` by a hash of the vector. A
shard's graph is built in blocks: a block of new nodes searches the graph so far, all at once in array operations, and
is linked by the diversity rule in both directions. Layers are flat arrays of neighbours; nodes are in descending order
of their level, so layer l is the first rows. Vectors of differing norms get one more coordinate that makes the norms
equal, under which the largest inner product is the nearest node. Queries go to every shard and stream through it, a
block at a time; a shard is held by one task, or by a few where there are fewer shards than cores. Hits are scored in
double precision on the original vectors, and shard results are merged.

Shards don't grow with the table, as recall at a given search width falls with a shard's size: their number grows, and
with it what a query costs. They are bounded in bytes, too. Vectors whose norms differ by more than a factor of some 16 are
in different shards (``NORM_CLASS`` binary digits a class), so that a large one doesn't flatten the others' differences;
vectors are scaled by their largest component before they are squared, and each query by its own.

Edge cases: vectors that are null, empty, all zero or that hold null or non-finite components, and rows without an id,
take no part; a query meets vectors of its own dimension only; ties go to the smaller id; rows that repeat an id and a vector
are one candidate; those that repeat an id with another vector are candidates of their own, but as queries share one result,
without any row of that id; scores beyond the doubles are infinite; fewer than k candidates give them all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import workers_find_package
from .common import load, thrifty, written

M, WIDE, EF_BUILD, EF_SEARCH = 16, 32, 80, 320
SHARD_ROWS, SHARD_BYTES, QUERY_BLOCK, TOP_NORMS, NORM_CLASS = 8192, 64 << 20, 512, 32, 4


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, at_once: int = 4, again: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all rows of q: (ids, scores), the best ef found, -1 where there are fewer.

    Each step expands every query's best ``at_once`` open nodes together. again marks entries that repeat another.
    """
    b, n = len(q), len(links)
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True  # the place of missing neighbours
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), n, dtype=np.int64)
    score = np.full((b, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((b, ef), dtype=bool)
    w = min(entry.shape[1], ef)
    ids[:, :w] = entry[:, :w]
    seen[rows, entry[:, :w]] = True
    score[:, :w] = np.einsum("bwd,bd->bw", x[entry[:, :w]], q)
    open_[:, :w] = True
    if again is not None:
        score[:, :w][again[:, :w]], open_[:, :w][again[:, :w]] = -np.inf, False
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score, open_ = (np.take_along_axis(v, order, axis=1) for v in (ids, score, open_))
    active = np.arange(b)
    while len(active):
        o = open_[active]
        rank = np.where(o & (np.cumsum(o, axis=1) <= at_once), np.arange(ef), ef)
        place = np.sort(rank, axis=1)[:, :at_once]
        some = place[:, 0] < ef
        active, place = active[some], place[some]
        if not len(active):
            break
        node = np.where(place < ef, ids[active[:, None], np.minimum(place, ef - 1)], n)
        r, c = np.nonzero(place < ef)
        open_[active[r], place[r, c]] = False
        near = np.where(node[:, :, None] < n, links[np.minimum(node, n - 1)], n).reshape(len(active), -1)
        near = np.where((near < 0) | seen[active[:, None], near], n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near.sort(axis=1)
        near = near[:, : max(1, int((near < n).sum(axis=1).max()))]
        seen[active[:, None], near] = True
        s = np.einsum("bwd,bd->bw", x[np.minimum(near, n - 1)], q[active])
        s[near >= n] = -np.inf
        all_ids, all_score = np.concatenate([ids[active], near], axis=1), np.concatenate([score[active], s], axis=1)
        all_open = np.concatenate([open_[active], near < n], axis=1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :ef]
        ids[active], score[active], open_[active] = (np.take_along_axis(v, order, axis=1) for v in (all_ids, all_score, all_open))
    return np.where(np.isfinite(score), ids, -1), score


def diverse(x: np.ndarray, base: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """The diversity rule for rows of candidates in descending score: a candidate is linked unless it is nearer to one
    already linked than to the base; what is left fills up. -1 pads."""
    b, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.einsum("bcd,bed->bce", v, v, optimize=True)
    kept = np.zeros((b, c), dtype=bool)
    for j in range(c):
        near = np.where(kept[:, :j], between[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
        kept[:, j] = (ids[:, j] >= 0) & (near < score[:, j]) & (kept[:, :j].sum(axis=1) < most)
    first = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(ids >= 0, ids, -1), first, axis=1)


class Graph:
    """The index of one shard: x (float32, equal norms), layers (flat neighbour arrays, layer 0 first)."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @staticmethod
    def build(x: np.ndarray, m: int = M, wide: int = WIDE, ef: int = EF_BUILD) -> Graph:
        """x: rows in an order that a hash gave; levels fall off by m, as in the usual random draw."""
        n = len(x)
        counts = [n]
        while counts[-1] > 2 * m:
            counts.append(max(1, counts[-1] // m))
        graph = Graph(x, [])
        for level in range(len(counts) - 1, -1, -1):
            graph.layers.insert(0, graph._layer(counts[level], wide if level == 0 else m, ef, level))
        graph._reach_all()
        return graph

    def _reach_all(self, least: int = 4) -> None:
        """Outliers are nobody's near neighbours: a node that few link to is linked from its own neighbours."""
        links = self.layers[0]
        low = np.flatnonzero(np.bincount(links[links >= 0], minlength=len(links)) < least)
        new = set(low.tolist())
        for u in low.tolist():
            for w in links[u][links[u] >= 0][:least].tolist():
                row = links[w]
                place = next((j for j in range(len(row) - 1, 0, -1) if int(row[j]) not in new), None)
                if place is not None and u not in row:
                    row[place] = u

    def _layer(self, n: int, most: int, ef: int, level: int) -> np.ndarray:
        x = self.x[:n]
        links = np.full((n, most), -1, dtype=np.int64)
        done = min(n, 256)
        s = x[:done] @ x[:done].T
        np.fill_diagonal(s, -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, : min(ef, max(1, done - 1))]
        if done > 1:
            links[:done, :] = self._padded(diverse(x, x[:done], order, np.take_along_axis(s, order, axis=1), most), most)
        while done < n:
            b = min(done, 512, n - done)
            new = np.arange(done, done + b)
            entry = self.descend(x[new], 3) if self.layers else np.zeros((b, 1), dtype=np.int64)
            ids, score = search_layer(self.x, links[:done], x[new], np.where((entry >= 0) & (entry < done), entry, 0), ef)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            peers = np.argsort(-own, axis=1, kind="stable")[:, : min(most, b - 1)] if b > 1 else np.zeros((b, 0), dtype=np.int64)
            ids = np.concatenate([ids, new[peers]], axis=1)
            score = np.concatenate([score, np.take_along_axis(own, peers, axis=1)], axis=1)
            order = np.argsort(-np.where(ids >= 0, score, -np.inf), axis=1, kind="stable")[:, : 3 * most]
            chosen = diverse(x, x[new], np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1), most)
            links[new] = self._padded(chosen, most)
            done += b
            self._back(x, links, new, chosen, most)
        return links

    @staticmethod
    def _padded(ids: np.ndarray, most: int) -> np.ndarray:
        return np.concatenate([ids, np.full((len(ids), most - ids.shape[1]), -1, dtype=np.int64)], axis=1) if ids.shape[1] < most else ids

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray, most: int) -> None:
        """Links from the chosen nodes to the new ones; a full list is chosen anew by the same rule."""
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        good = target >= 0
        source, target = source[good], target[good]
        score = np.einsum("ed,ed->e", x[source], x[target])
        order = np.lexsort((source, -score, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        source, target, place = (v[place < most] for v in (source, target, place))
        nodes, row = np.unique(target, return_inverse=True)
        for a in range(0, len(nodes), 1024):
            part = slice(a, a + 1024)
            some = nodes[part]
            mine = (row >= a) & (row < a + 1024)
            extra = np.full((len(some), most), -1, dtype=np.int64)
            extra[row[mine] - a, place[mine]] = source[mine]
            ids = np.sort(np.concatenate([links[some], extra], axis=1), axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            score = np.where(ids >= 0, np.einsum("bcd,bd->bc", x[np.maximum(ids, 0)], x[some]), -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")
            ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
            width = max(1, int((ids >= 0).sum(axis=1).max()))
            links[some] = Graph._padded(diverse(x, x[some], ids[:, :width], score[:, :width], most), most)

    def descend(self, q: np.ndarray, ef: int, down_to: int = 0) -> np.ndarray:
        """The best ef nodes of the lowest built layer but down_to ones, from the top layer's first node downwards."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for links in reversed(self.layers[down_to:]):
            ids, _ = search_layer(self.x, links, q, entry, max(ef, 4))
            entry = np.where(ids >= 0, ids, ids[:, :1])[:, :ef]
        return entry

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Starts from where the upper layers lead, and from the vectors of the largest norms: the last coordinate, which
        makes norms equal, is smallest for them, and large inner products are often theirs."""
        entry = self.descend(q, 3, down_to=1) if len(self.layers) > 1 else np.zeros((len(q), 1), dtype=np.int64)
        top = np.argsort(self.x[:, -1], kind="stable")[:TOP_NORMS]
        entry = np.concatenate([np.repeat(top[None, :], len(q), axis=0), entry], axis=1)
        entry = np.sort(entry, axis=1)
        again = np.concatenate([np.zeros((len(q), 1), dtype=bool), entry[:, 1:] == entry[:, :-1]], axis=1)
        return search_layer(self.x, self.layers[0], q, entry, ef, again=again)[0]


def augmented(v: np.ndarray) -> np.ndarray:
    """float32 rows of equal norm: one more coordinate takes up what a norm lacks to the largest."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max()  # no square leaves the doubles
    square = (v * v).sum(axis=1)
    scale = np.sqrt(square.max())
    return np.concatenate([v / scale, np.sqrt(np.maximum(0, 1 - square / scale**2))[:, None]], axis=1).astype(np.float32)


def norm_class(v: np.ndarray) -> int:
    """Of a vector that isn't zero; the borders lie at a quarter and at four, not where norms usually are."""
    largest = float(np.abs(v).max())
    return int((np.log2(largest) + 0.5 * np.log2(((v / largest) ** 2).sum()) + NORM_CLASS / 2) // NORM_CLASS)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    workers_find_package(df.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where(~odd & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distinct_vectors(src: DataFrame, k: int) -> DataFrame:
    """(dim, cls, data, ids, h): each task's distinct vectors with their k + 1 least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set[int]] = {}

        def rows() -> pa.RecordBatch:
            classes = [norm_class(np.frombuffer(x, dtype="<f8")) for x in known]
            out = pa.RecordBatch.from_arrays([pa.array([len(x) // 8 for x in known], pa.int32()), pa.array(classes, pa.int32()), pa.array(list(known), pa.binary()), pa.array([sorted(x)[: k + 1] for x in known.values()], pa.list_(pa.int64()))], ["dim", "cls", "data", "ids"])
            known.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (np.asarray(v.values.to_numpy(zero_copy_only=False), dtype="<f8") + 0.0).tobytes()  # -0 is 0
                ids = known.setdefault(data, set())
                ids.add(i)
                if len(ids) > 4 * k + 64:
                    known[data] = set(sorted(ids)[: k + 1])
            if len(known) > 50_000:
                yield rows()
        if known:
            yield rows()

    return src.mapInArrow(thrifty(run), "dim int, cls int, data binary, ids array<long>").withColumn("h", F.xxhash64("data"))


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_index(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(dim, cls, shard, shards, data): each shard's flat arrays, written in the shared folder. A shard has about shard_rows
    nodes, by default SHARD_ROWS, and fewer where they would be more than SHARD_BYTES."""
    nodes = written(distinct_vectors(valid_vectors(df, id_col, vector_col), k), "vectors")
    rows = F.greatest(F.lit(1), F.least(F.lit(shard_rows or SHARD_ROWS), F.floor(F.lit(SHARD_BYTES) / (12 * F.col("dim") + 400))))
    sizes = nodes.groupBy("dim", "cls").agg(F.approx_count_distinct("h").alias("n"))
    sizes = written(sizes.select("dim", "cls", F.greatest(F.lit(1), F.ceil(F.col("n") / rows)).cast("int").alias("shards")), "shards")
    # a stated number of partitions: what a shard takes isn't seen in its bytes, by which small partitions would be merged
    tasks = 2 * (sizes.agg(F.sum("shards")).first()[0] or 1)
    dealt = nodes.join(sizes, ["dim", "cls"]).withColumn("shard", F.pmod(F.col("h"), F.col("shards")).cast("int")).repartition(tasks, "dim", "cls", "shard")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cls, shard, shards = (int(x) for x in key)
        ids: dict[bytes, set[int]] = {}
        for data, part in zip(pdf.sort_values(["h", "data"])["data"], pdf.sort_values(["h", "data"])["ids"], strict=True):
            ids.setdefault(data, set()).update(part)
        v = np.frombuffer(b"".join(ids), dtype="<f8").reshape(-1, dim)
        least = [sorted(x)[: k + 1] for x in ids.values()]
        graph = Graph.build(augmented(v))
        layers = {f"layer{i}": x.astype(np.int32) for i, x in enumerate(graph.layers)}
        data = _dump(v=v, x=graph.x, ids=np.concatenate([np.array(x, dtype=np.int64) for x in least]), count=np.array([len(x) for x in least]), **layers)
        return pd.DataFrame({"dim": [dim], "cls": [cls], "shard": [shard], "shards": [shards], "data": [data]})

    return written(dealt.groupBy("dim", "cls", "shard", "shards").applyInPandas(build, "dim int, cls int, shard int, shards int, data binary"), "hnsw")


FOUND = "query_id long, vec_id long, score double"


class Held:
    """A shard in memory."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as z:
            arrays = dict(z)
        layers = [arrays[f"layer{i}"].astype(np.int64) for i in range(sum(x.startswith("layer") for x in arrays))]
        self.graph, self.v, self.ids, self.count = Graph(arrays["x"], layers), arrays["v"], arrays["ids"], arrays["count"]
        self.start = np.concatenate(([0], np.cumsum(self.count)))

    def nearest(self, names: np.ndarray, wanted: np.ndarray, k: int, ef: int) -> pa.RecordBatch:
        """The k best of each query, scored on the original vectors."""
        scaled = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        hits = self.graph.search(np.concatenate([scaled, np.zeros((len(wanted), 1))], axis=1).astype(np.float32), max(ef, 2 * k))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for name, query, hit in zip(names.tolist(), wanted, hits, strict=True):
            hit = hit[hit >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.v[hit] * query).sum(axis=1) + 0.0
            score = np.repeat(np.where(np.isnan(score), -np.inf, score), self.count[hit])
            ids = np.concatenate([np.zeros(0, dtype=np.int64), *[self.ids[self.start[h] : self.start[h + 1]] for h in hit]])
            ids, score = ids[ids != name], score[ids != name]
            best = np.lexsort((ids, -score))[:k]
            out.append((ids[best], score[best]))
        asked = np.repeat(names, [len(x) for x, _ in out])
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], ["query_id", "vec_id", "score"])


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards' hits. queries: vec_id, v."""
    sizes = index.groupBy("dim", "cls").agg(F.max("shards").alias("shards"))
    shards = index.count()
    copies = max(1, -(-2 * index.sparkSession.sparkContext.defaultParallelism // max(1, shards)))  # follows the cores, not the rows
    asked = queries.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(copies)).cast("int").alias("part"))
    asked = asked.join(sizes, "dim").select("dim", "cls", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "part", F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("binary").alias("data"))
    part = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part")
    held = index.select("dim", "cls", "shard", part, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "data")
    keys = ["dim", "cls", "shard", "part"]
    rows = held.unionByName(asked).repartition(2 * max(1, shards) * copies, *keys).sortWithinPartitions(*keys, "kind")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kind = batch.column(4).to_numpy()
            at = 0
            for stop in [*np.flatnonzero(kind == 0).tolist(), len(kind)]:  # a shard's own row comes before its queries
                for a in range(at, stop, block):
                    part = batch.slice(a, min(block, stop - a))
                    names = part.column(5).to_numpy()
                    yield shard.nearest(names, part.column(6).flatten().to_numpy().reshape(len(names), -1).astype(np.float64), k, ef)
                if stop < len(kind):
                    shard = Held(batch.column(7)[stop].as_py())
                at = stop + 1

    hits = rows.mapInArrow(thrifty(find), FOUND).distinct()  # a query that is there twice has its hits twice
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all other rows."""
    index = build_index(df, k)
    queries = valid_vectors(df, "vec_id", "embedding").where(F.col("vec_id") % every == 0)
    return search_index(index, queries, k)


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
