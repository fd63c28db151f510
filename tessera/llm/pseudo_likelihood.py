"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every word of a document is predicted from the words on both sides of it (``SIDE`` each way), itself masked. A document's
score is the sum of the conditional log-probabilities of all its words.

The items that the network tells apart are the ``KNOWN`` most frequent words of at least ``LEAST`` occurrences and, for
all other words, cells by their hashes. An item's probability is that of its class (a softmax over runs of the frequency
order of about equal shares) times those of the turns on its way down a binary tree over the class's items; both depend
on the context, every inner node has a vector of its own, and the tree's turns start from the exact corpus counts. A
word in a cell has its exact count's share of the cell. So probabilities are over words and sum to one. The counts of
all distinct words stay distributed: words in cells meet them in a join; what the driver and the workers hold is bounded.

Training: counts come from all documents, and every window of every document is trained on once. In each of ``ROUNDS``
rounds the partitions start from the same network, run mini-batches of Adam over the windows of the documents that
belong to the round (by their texts' hashes), and their networks are averaged: dense layers by the numbers of windows, a
word's or node's vector by how often each partition met it. Texts are streamed: a chunk's windows are made and shuffled
as they are trained on, and none are kept.

``held_log_prob`` leaves a document's own occurrences out of the counts of the words in cells; ``n_unknown`` is the number
of its words that no other document holds, in so far as they are in cells (a document that occurs twice has none).

Words are as in the shingle operators: runs of non-space after A-Z become a-z; a word is known by its 64-bit hash.
Edge cases: null, empty and wordless texts have no words and score 0; repeated rows score alike; null doc_ids are
kept; an empty table gives no rows, and the untrained network; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import array_sum
from .common import id_text, keep_freed, load, one_thread, thrifty, written
from .shingles import CHUNK, U, byte_chunks, word_hashes

KNOWN, LEAST, MOST_CELLS = 1 << 15, 32, 1 << 12
CLASSES, DIM, HIDDEN, TURN, SIDE = 64, 12, 32, 8, 2
ROUNDS, BATCH, RATE, SPARSE_RATE = 2, 2048, 0.004, 0.1
HELD = 128 * BATCH  # windows that are made at once
MOST_HELD = 1 << 20  # distinct words that a task holds while it counts
FIXED = 1 << 24  # parameters are summed as fixed-point integers


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, hashes of all words, where each text's words start and the last one's end) for ranges of texts."""
    for a, b, data, offsets in byte_chunks(texts, CHUNK):
        yield a, b, *word_hashes(data, offsets)


def windows(items: np.ndarray, bound: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """(len(at), 2 SIDE): the items around each position, pad beyond the text."""
    doc = np.searchsorted(bound, at, "right") - 1
    first, last = bound[doc], bound[doc + 1]
    out = np.empty((len(at), 2 * SIDE), dtype=np.int32)
    for c, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        place = at + d
        inside = (place >= first) & (place < last)
        out[:, c] = np.where(inside, items[np.clip(place, 0, len(items) - 1)], pad)
    return out


class Vocabulary:
    """The items: known words by hash, then cells; their classes, and the ways to them through the classes' trees.

    words, counts: known words and their counts, frequent ones first, so that their vectors lie close together;
    cell_counts, cell_words: all other words' counts and numbers, by cell.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, cell_counts: np.ndarray, cell_words: np.ndarray):
        order = np.argsort(words)
        self.keys, self.item, known = np.append(words[order], U((1 << 64) - 1)), np.append(order, 0), len(words)
        self.known, self.cells = known, len(cell_counts)
        self.size = known + self.cells
        #: a cell's share for a word of count c is (c + 1/2) over this; words that were never counted share one half
        self.cell_total = cell_counts + 0.5 * (cell_words + 1)
        self.mass = np.concatenate([counts.astype(np.float64), self.cell_total])
        bits = max(1, known.bit_length() + 1)
        self.shift = U(64 - bits)
        #: where the keys of each leading bits start: hashes are even, so the place is a step or two away
        self.first = np.searchsorted(self.keys[:known], np.arange(1 << bits, dtype=U) << self.shift).astype(np.int32)
        self._classes()
        self._trees()

    def _classes(self) -> None:
        """Runs of the frequency order with about equal shares."""
        self.order = np.argsort(-self.mass, kind="stable")
        total = np.cumsum(self.mass[self.order])
        self.label = np.empty(self.size, dtype=np.int32)
        run = np.minimum(CLASSES - 1, CLASSES * (total - self.mass[self.order]) / total[-1]).astype(np.int32)
        run = np.cumsum(np.concatenate(([0], run[1:] != run[:-1])))  # a word of several shares leaves none empty
        self.label[self.order], self.classes = run, int(run[-1]) + 1

    def _trees(self) -> None:
        """Halving each class's run: a node is the place where a run is cut; the way to an item is its nodes and turns."""
        label = self.label[self.order]
        total = np.concatenate(([0.0], np.cumsum(self.mass[self.order])))
        place = np.arange(self.size)
        low, high = np.searchsorted(label, label), np.searchsorted(label, label, "right")
        self.prior = np.zeros(self.size, dtype=np.float32)
        self.start, self.last = np.zeros((2, self.size), dtype=np.intp)  # the run that a node cuts
        nodes, turns, owners = [], [], []
        at = np.flatnonzero(high - low > 1)
        while len(at):
            middle = (low[at] + high[at]) >> 1
            self.prior[middle] = np.log((total[high[at]] - total[middle]) / (total[middle] - total[low[at]]))
            self.start[middle], self.last[middle] = low[at], high[at]
            right = place[at] >= middle
            nodes.append(middle), turns.append(right), owners.append(self.order[at])
            low[at[right]], high[at[~right]] = middle[right], middle[~right]
            at = at[high[at] - low[at] > 1]
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        by = np.argsort(owner, kind="stable")
        self.node = (np.concatenate(nodes) if nodes else owner)[by].astype(np.intp)
        self.turn = (np.concatenate(turns) if turns else owner)[by].astype(np.float32)
        self.depth = np.bincount(owner, minlength=self.size)
        self.way, self.deepest = np.cumsum(self.depth) - self.depth, int(self.depth.max())

    def cell_of(self, words: np.ndarray) -> np.ndarray:
        return (words >> U(64 - self.cells.bit_length() + 1)).astype(np.int64)

    def items(self, words: np.ndarray) -> np.ndarray:
        """The item of each word: its own, or its cell's."""
        at = self.first[words >> self.shift]
        going = np.flatnonzero(self.keys[at] < words)
        while len(going):
            at[going] += 1
            going = going[self.keys[at[going]] < words[going]]
        return np.where((self.keys[at] == words) & (at < self.known), self.item[at], self.known + self.cell_of(words)).astype(np.int32)


class Network:
    """Embeddings of the window, one hidden layer, scores of the classes, and a vector for each node of the trees;
    parameters are one flat float32 array."""

    def __init__(self, known: Vocabulary, flat: np.ndarray | None = None, seed: int = 5):
        size = known.size
        self.shapes = [(size + 1, DIM), (size, TURN), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN, known.classes), (known.classes,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        self.size, self.sparse = sum(sizes), sizes[0] + sizes[1]
        fresh = flat is None
        self.flat, self.parts, at = np.zeros(self.size, dtype=np.float32) if fresh else flat, [], 0
        for shape, n in zip(self.shapes, sizes, strict=True):
            self.parts.append(self.flat[at : at + n].reshape(shape))
            at += n
        if fresh:
            rng, (e, _, w, _, v, _) = np.random.default_rng(seed), self.parts
            e[:-1] = rng.normal(0, 0.3, (size, DIM))
            w[:] = rng.normal(0, (2 * SIDE * DIM) ** -0.5, w.shape)
            v[:] = rng.normal(0, HIDDEN**-0.5, v.shape)

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, _, w, b, _, _ = self.parts
        x = e.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = x @ w
        h += b
        return x, np.tanh(h, out=h)

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes, a row for each class and a column for each row of h, and the columns' sums."""
        z = self.parts[4].T @ h.T
        z += self.parts[5][:, None]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        return z, np.ones(len(z), dtype=np.float32) @ z

    def turns(self, h: np.ndarray, items: np.ndarray, known: Vocabulary) -> tuple[list[tuple[slice, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every node on the ways to the items, which come with the longest way first: (each level's nodes and their
        rows' part of h, which are the first rows; node, its vector, the score of a right turn, the turn)."""
        depth, way, part = known.depth.take(items), known.way.take(items), np.ascontiguousarray(h[:, :TURN])
        rows = (len(items) - np.cumsum(np.bincount(depth))[:-1]).tolist()  # of each level: those that go deeper
        at, levels, end = np.empty(sum(rows), dtype=np.intp), [], 0
        for d, n in enumerate(rows):
            levels.append((slice(end, end + n), part[:n]))
            np.add(way[:n], d, out=at[end : end + n])
            end += n
        node = known.node.take(at)
        vector = self.parts[1].take(node, axis=0)
        product = np.empty_like(vector)
        for level, t in levels:
            np.multiply(vector[level], t, out=product[level])
        z = product @ np.ones(TURN, dtype=np.float32)
        z += known.prior.take(node)
        return levels, node, vector, z, known.turn.take(at)

    def log_items(self, around: np.ndarray, items: np.ndarray, known: Vocabulary) -> np.ndarray:
        """The log-probability of each item in its window."""
        order = deepest_first(items, known)
        around, items = around.take(order, axis=0), items.take(order)
        _, h = self.hidden(around)
        z, total = self.classes(h)
        levels, _, _, score, turn = self.turns(h, items, known)
        score *= 1 - 2 * turn
        lost, turned = np.log(total.astype(np.float64)), np.log1p(np.exp(score))
        for level, t in levels:
            lost[: len(t)] += turned[level]
        out = np.empty(len(items))
        out[order] = np.log(z[known.label.take(items), np.arange(len(items))]) - lost
        return out

    def train(self, around: np.ndarray, items: np.ndarray, known: Vocabulary, state: Moments) -> None:
        """One pass over the windows in the given order: Adam, and Adagrad on the vectors that occur. state carries on a
        pass whose windows come in several calls."""
        e, u, w, _, v, _ = self.parts
        state.meet(around, items, known)
        for first in range(0, len(items), BATCH):
            some, y = around[first : first + BATCH], items[first : first + BATCH]
            order = deepest_first(y, known)
            some, y = some.take(order, axis=0).astype(np.intp), y.take(order)
            n = len(y)
            one = np.ones(n, dtype=np.float32)
            x, h = self.hidden(some)
            g, total = self.classes(h)
            g *= 1 / (total * np.float32(n))
            flat = g.reshape(-1)
            at = known.label.take(y) * np.intp(n) + np.arange(n)
            flat[at] = flat.take(at) - np.float32(1 / n)
            back = g.T @ v.T
            levels, node, vector, z, turn = self.turns(h, y, known)
            miss = np.repeat((1 / (1 + np.exp(-z)) - turn) * np.float32(1 / n), TURN).reshape(-1, TURN)
            vector *= miss
            below = np.zeros((n, TURN), dtype=np.float32)
            for level, t in levels:
                below[: len(t)] += vector[level]
                miss[level] *= t
            back[:, :TURN] += below
            last = [(g @ h).T.ravel(), g @ one]
            h *= h
            back *= np.subtract(1, h, out=h)
            state.adam(self.flat[self.sparse :], np.concatenate([(x.T @ back).ravel(), one @ back, *last]))
            state.step(0, e, some.ravel(), (back @ w.T).reshape(-1, DIM))
            state.step(1, u, node, miss)
            e[-1] = 0


def deepest_first(items: np.ndarray, known: Vocabulary) -> np.ndarray:
    """An order of the items in which the way to none is longer than the one before: at each level of the trees, the items
    that go on are the first ones."""
    return np.argsort((known.deepest - known.depth.take(items)).astype(np.uint8), kind="stable")


class Moments:
    """What a pass of the optimiser keeps between mini-batches."""

    def __init__(self, net: Network):
        self.t = 0
        self.first, self.second = np.zeros((2, net.size - net.sparse), dtype=np.float32)
        self.squares = [np.zeros(len(p), dtype=np.float32) for p in net.parts[:2]]
        self.met = [np.zeros(len(p), dtype=np.int64) for p in net.parts[:2]]
        self.mark = [np.zeros(len(p), dtype=bool) for p in net.parts[:2]]
        self.place = [np.zeros(len(p), dtype=np.intp) for p in net.parts[:2]]

    def meet(self, around: np.ndarray, items: np.ndarray, known: Vocabulary) -> None:
        """Counts how often each word's vector and each node is met."""
        self.met[0] += np.bincount(around.ravel(), minlength=len(self.met[0]))
        total = np.concatenate(([0], np.cumsum(np.bincount(items, minlength=known.size)[known.order])))
        self.met[1] += total[known.last] - total[known.start]

    def adam(self, dense: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.01 * (grad * grad - self.second)
        dense -= RATE * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.99**self.t)) + 1e-8)

    def step(self, k: int, table: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad on the rows of a table that occur. Numbers are summed two at a time, as complex ones."""
        mark, place, width = self.mark[k], self.place[k], table.shape[1]
        mark[at] = True
        rows = np.flatnonzero(mark)
        mark[rows] = False
        place[rows] = np.arange(len(rows))
        total = np.zeros((len(rows), width), dtype=np.float32)
        pairs = np.arange(len(rows) * width // 2).reshape(len(rows), width // 2).take(place.take(at), axis=0)
        np.add.at(total.reshape(-1).view(np.complex64), pairs.reshape(-1), grad.reshape(-1).view(np.complex64))
        square = self.squares[k].take(rows)
        square += (total * total) @ np.full(width, 1 / width, dtype=np.float32)
        self.squares[k][rows] = square
        total *= (SPARSE_RATE / (np.sqrt(square) + 1e-8))[:, None]
        put_rows(table, rows, table.take(rows, axis=0) - total)


def put_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values, each row as one item, which is several times faster for short rows."""
    whole = np.dtype((np.void, table.shape[1] * table.itemsize))
    table.view(whole)[:, 0][rows] = values.view(whole)[:, 0]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys)
    order = np.argsort(every)
    every, some = every[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.add.reduceat(some, first)


def word_counts(src: DataFrame) -> DataFrame:
    """word, n: the exact count of every distinct word; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["word", "n"])

        for batch in batches:
            for _, _, w, _ in words_of(batch.column(0)):
                if not len(w):
                    continue
                k, c = np.unique(w, return_counts=True)
                keys.append(k), counts.append(c.astype(np.int64))
                held += len(k)
                if held > MOST_HELD:
                    keys, counts = ([x] for x in summed(keys, counts))
                    held = len(keys[0])
                    if 2 * held > MOST_HELD:
                        yield rows()
                        keys, counts, held = [], [], 0
        if keys:
            keys, counts = ([x] for x in summed(keys, counts))
            yield rows()

    return written(src.select("text").mapInArrow(thrifty(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver gets KNOWN words and the sums of the cells."""
    top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    words, n = top.column("word").to_numpy().view(U), top.column("n").to_numpy()
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(6, ((counts.count() - len(words)) // 8).bit_length()))
    bits = cells.bit_length() - 1
    total, number = np.zeros(cells), np.zeros(cells)
    for r in counts.groupBy(F.shiftrightunsigned("word", 64 - bits).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[r.cell], number[r.cell] = r.n, r.words
    mine = (words >> U(64 - bits)).astype(np.int64)
    return Vocabulary(words, n, total - np.bincount(mine, n, minlength=cells), number - np.bincount(mine, minlength=cells))


def train(src: DataFrame, shared: Broadcast, rounds: int = ROUNDS) -> Network:
    """The averaged network after all rounds; shared: the vocabulary. The driver holds one network at a time."""
    size = shared.value.size
    net = Network(shared.value)
    length = -(-(net.size + 2 * size + 2) // 64) * 64
    for r in range(rounds):
        start = src.sparkSession.sparkContext.broadcast(net.flat)

        def fill(batches: Iterator[pa.RecordBatch], r: int = r, start: Broadcast = start) -> np.ndarray | None:
            one_thread(), keep_freed()
            known, n = shared.value, 0
            local = Network(known, start.value.copy())
            state, rng = Moments(local), np.random.default_rng(r)
            for batch in batches:
                for _, _, w, bound in words_of(batch.column(0)):
                    order, items = rng.permutation(len(w)), known.items(w)
                    for x in range(0, len(w), HELD):
                        at = order[x : x + HELD]
                        local.train(windows(items, bound, at, size), items[at], known, state)
                    n += len(w)
            if not n:
                return None
            # changes, each weighted by how often its parameter was met
            change = np.round(np.clip((local.flat - start.value).astype(np.float64), -1e2, 1e2) * FIXED)
            out = np.zeros(length, dtype=np.int64)
            weight = [np.repeat(np.minimum(m, 1 << 20), p.shape[1]) for m, p in zip(state.met, local.parts[:2], strict=True)]
            out[: local.sparse] = change[: local.sparse] / (1 << 10) * np.concatenate(weight)
            out[local.sparse : local.size] = change[local.sparse :] / (1 << 10) * n
            out[local.size : local.size + 2 * size + 1] = np.concatenate([np.minimum(m, 1 << 20) for m in state.met])
            out[local.size + 2 * size + 1] = n
            return out

        share = src.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r) if rounds > 1 else src
        total = array_sum(share.select("text"), length, fill).astype(np.float64)
        start.unpersist()
        n = total[net.size + 2 * size + 1]
        if n:
            met = total[net.size : net.size + 2 * size + 1]
            weight = np.concatenate([np.repeat(met[: size + 1], DIM), np.repeat(met[size + 1 :], TURN), np.full(net.size - net.sparse, n)])
            net = Network(shared.value, (net.flat + total[: net.size] * (1 << 10) / FIXED / np.maximum(1, weight)).astype(np.float32))
    return net


PARTS = "kind int, row long, doc_id long, n_tokens long, log_prob double, word long, times int"


def scored(src: DataFrame, net: Network, shared: Broadcast) -> DataFrame:
    """kind 0: a document's row, number of words and the log-probability of its items; kind 1: a word in a cell that the
    document of the row has, and how often. Written, so that row numbers are the same for all who read them."""
    size, start = shared.value.size, src.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread(), keep_freed()
        known, net = shared.value, Network(shared.value, start.value)
        less = np.concatenate([np.zeros(known.known), np.log(known.cell_total)])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, b, w, bound in words_of(batch.column(1)):
                items = known.items(w)
                logp = np.empty(len(w))
                for x in range(0, len(w), 8192):
                    at = np.arange(x, min(x + 8192, len(w)))
                    logp[at] = net.log_items(windows(items, bound, at, size), items[at], known)
                sums = np.concatenate(([0.0], np.cumsum(logp - less[items])))
                rows, n = row + np.arange(b - a), np.diff(bound)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, dtype=np.int32)), pa.array(rows), ids.slice(a, b - a), pa.array(n), pa.array(sums[bound[1:]] - sums[bound[:-1]]), none, none.cast(pa.int32())], NAMES)
                rare = np.flatnonzero(items >= known.known)
                doc = np.searchsorted(bound, rare, "right") - 1
                order = np.argsort(w[rare])
                order = order[np.argsort(doc[order].astype(np.uint16) if b - a < 1 << 16 else doc[order], kind="stable")]
                doc, word = doc[order], w[rare][order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(first, len(doc))).astype(np.int32)
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), dtype=np.int32)), pa.array(rows[doc[first]]), none, none, none.cast(pa.float64()), pa.array(word[first].view(np.int64)), pa.array(times)], NAMES)
                row += b - a

    return written(src.mapInArrow(thrifty(run), PARTS), "scored")


NAMES = [c.split()[0] for c in PARTS.split(", ")]


def score(docs: DataFrame, net: Network, shared: Broadcast, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over all words), mean_log_prob (null without words), held_log_prob, n_unknown."""
    parts = scored(id_text(docs), net, shared)
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    rare = parts.where("kind = 1").select("row", "word", "times").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(times * F.log(n + 0.5)).alias("own"),
        F.sum(times * F.log(F.greatest(n - times, F.lit(0)) + 0.5)).alias("held"),
        F.sum(F.when(n <= times, times).otherwise(0)).alias("n_unknown"),
    )
    out = parts.where("kind = 0").select("row", "doc_id", "n_tokens", "log_prob").join(rare, "row", "left").na.fill(0, ["own", "held", "n_unknown"])
    total = F.col("log_prob") + F.col("own")
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"), (F.col("log_prob") + F.col("held")).alias("held_log_prob"), F.col("n_unknown").cast("long").alias("n_unknown"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    src = id_text(docs)
    counts = word_counts(src)
    shared = src.sparkSession.sparkContext.broadcast(vocabulary(counts))
    return score(docs, train(src, shared), shared, counts)


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(load(spark, sf_dir, "documents"))
