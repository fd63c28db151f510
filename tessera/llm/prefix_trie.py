"""A trie of conversations' turns, built as partial tries that merge, and rolled up from its leaves.

Turns are reduced to two hashes and a word count where they are read; texts aren't shuffled. A conversation's turns are
put in order by a range sort over the whole table, so that one that is far longer than others is many tasks' work: a task
numbers its turns and sums their hashes as if it were the first, and what went before, two sums a task, is added
afterwards. A prefix is named by its length and the sum of its turns' hashes, each times a power of an odd number for its
place (twice 64 bits; a turn's hashes are 120 bits of SHA-256).

Tasks emit partial tries: tables of nodes with numbers of members, the smallest member, and the sorted list of members
that end there. Partial tries are merged by node, ``FAN`` at a time, until one is left; lists of over ``LIGHT`` ends are
put aside as rows of their own, so that no row grows with a group of copies. Sums over subtrees are taken upwards in
rounds of doubled reach, over nodes with two members or more alone: below any other node there is one path.

Edge cases: rows without a conv_id take no part; a null turn comes first; turns of one number are in order of the SHA-256
of role and text (equal rows are alike); null roles and texts are empty; a conversation that is left without turns is a
member of the root and ends there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, lean, load, partitions, salted_join, thrifty, written

U = np.uint64
#: Odd multipliers of the two sums.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
HEAD, GROUP, FAN, LIGHT, CHUNK = 4, 20, 16, 2048, 1 << 16
KEY = ["depth", "k1", "k2"]


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, t1, t2, words: what is needed of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    src = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("r"), text.alias("x")).where("conv_id is not null")
    digest = F.sha2(F.concat(F.char_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")), 256)
    hashes = [F.conv(F.substring(digest, a, 15), 16, 10).cast("long").alias(n) for n, a in (("t1", 1), ("t2", 16))]
    return src.select("conv_id", "turn", *hashes, F.regexp_count("x", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square, e = np.ones(len(exponent), dtype=U), base, exponent.copy()
    while e.any():
        out[e & 1 == 1] *= U(square)
        square, e = square * square & ((1 << 64) - 1), e >> 1
    return out


SCANNED = "kind int, pid int, conv_id long, pos long, k1 long, k2 long, t1 long, t2 long, words long, at_end int, first boolean"


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Rows of conv_id, t1, t2, words in order: pos (from 1), the prefix's sums k1, k2, those before it p1, p2, and whether
    it is the conversation's last row."""
    n = max(partitions(df.sparkSession), 1)
    # equal rows may be a third of all: their place in the input keeps them apart
    dealt = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, "conv_id", *order, "_place")
    dealt = dealt.sortWithinPartitions("conv_id", *order, "_place").select("conv_id", "t1", "t2", "words")
    names = [f.split()[0] for f in SCANNED.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        conv = rank = first = None
        sums, held, edge = np.zeros(2, dtype=U), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            c, t1, t2, words = (batch.column(i).to_numpy() for i in range(4))
            new = np.concatenate(([conv is None or c[0] != conv], c[1:] != c[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            pos = np.arange(len(c)) - start + 1
            if not new[0]:
                pos[c == conv] += rank  # in order: the conversation's rows are the batch's first
            if first is None:
                first = int(c[0])
            keys = []
            for lane, t in enumerate((t1, t2)):
                total = np.cumsum(t.astype(U) * _power(BASES[lane], pos))
                key = total - np.where(start > 0, total[np.maximum(start - 1, 0)], U(0))
                keys.append(np.where(start == 0, key + (U(0) if new[0] else sums[lane]), key))
            cols = [np.zeros(len(c), np.int32), np.full(len(c), pid, np.int32), c, pos, keys[0].view(np.int64), keys[1].view(np.int64), t1, t2, words, np.zeros(len(c), np.int32), c == first]
            if held is not None:
                cols = [np.concatenate([h, x]) for h, x in zip(held, cols, strict=True)]
            cols[9][:-1] = cols[2][1:] != cols[2][:-1]
            of_first = np.flatnonzero(cols[10])
            if len(of_first):
                edge = [x[of_first[-1]] for x in cols]
            held = [x[-1:].copy() for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in cols], names)
            conv, rank = int(c[-1]), int(pos[-1])
            sums = np.array([k[-1] for k in keys], dtype=U)
        if held is not None:
            held[9][:] = 2  # whether the conversation goes on is for the next task to say
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)
            for kind, row in ((1, edge), (2, [x[0] for x in held])):
                row = [kind, *row[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    types = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.bool_()]
    done = written(dealt.mapInArrow(thrifty(scan), SCANNED), "turns")
    # two rows a task: how far its first conversation went, and its last one
    ends: dict[int, dict[int, tuple]] = {}
    for r in done.where("kind > 0").select("pid", "kind", "conv_id", "pos", "k1", "k2").collect():
        ends.setdefault(r.pid, {})[r.kind] = (r.conv_id, r.pos, r.k1, r.k2)
    carry: dict[int, tuple[int, int, int, bool]] = {}
    open_conv, before = None, (0, 0, 0)
    order_of = sorted(ends)
    mask = (1 << 64) - 1
    for i, pid in enumerate(order_of):
        first, last = ends[pid][1], ends[pid][2]
        own = before if first[0] == open_conv else (0, 0, 0)
        goes_on = i + 1 < len(order_of) and ends[order_of[i + 1]][1][0] == last[0]
        carry[pid] = (*own, goes_on)
        if last[0] == first[0]:
            before = (own[0] + last[1], *[(own[j + 1] + pow(BASES[j], own[0], 1 << 64) * last[2 + j]) & mask for j in (0, 1)])
        else:
            before = (last[1], last[2] & mask, last[3] & mask)
        open_conv = last[0]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pid, conv, pos, k1, k2, t1, t2, words, at_end, is_first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(10))
            pos, out, was = pos.copy(), [], []
            known, index = np.unique(pid, return_inverse=True)
            offset = np.where(is_first, np.array([carry[p][0] for p in known.tolist()], dtype=np.int64)[index], 0)
            for lane, k in enumerate((k1, k2)):
                c = np.array([carry[p][1 + lane] for p in known.tolist()], dtype=U)[index]
                out.append(np.where(is_first, c + k.view(U) * _power(BASES[lane], offset), k.view(U)))
            pos += offset
            for lane, t in enumerate((t1, t2)):
                was.append(out[lane] - t.astype(U) * _power(BASES[lane], pos))
            goes_on = np.array([carry[p][3] for p in known.tolist()])[index]
            last = (at_end == 1) | ((at_end == 2) & ~goes_on)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, pos, *[x.view(np.int64) for x in (*out, *was)], t1, t2, words, last)], [f.split()[0] for f in ORDERED.split(", ")])

    rows = done.where("kind = 0").select("pid", "conv_id", "pos", "k1", "k2", "t1", "t2", "words", "at_end", "first")
    return rows.mapInArrow(thrifty(finish), ORDERED)


ORDERED = "conv_id long, pos long, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, words long, last boolean"


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rebuilt conversations' turns in order, the ids of all conversations)."""
    turns = turns_of(df)
    own = written(in_order(turns, F.asc_nulls_first("turn"), F.col("t1"), F.col("t2")).select("conv_id", "pos", "t1", "t2", "words"), "ordered")
    ids = written(own.select("conv_id").distinct(), "conversations")
    heads = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD)).withColumnRenamed("conv_id", "base")
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))  # GROUP ids a base at most
    heads = heads.join(asked, "base").where(F.col("pos") <= head_length(F.col("conv_id"))).select("conv_id", "pos", "t1", "t2", "words")
    rest = own.where(F.col("pos") > head_length(F.col("conv_id")))
    return written(in_order(rest.unionByName(heads).withColumnRenamed("pos", "was"), F.col("was")), "rebuilt"), ids


NODES = "part int, depth long, k1 long, k2 long, p1 long, p2 long, words long, n long, conv_id long, ends array<long>"


def partial_tries(rows: DataFrame, ids: DataFrame, light: int) -> DataFrame:
    """Each task's own trie, a part of up to some 100,000 turns at a time; the root has its row for every conversation."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def trie(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            depth, k1, k2, conv, last = (t.column(c).to_numpy() for c in ("pos", "k1", "k2", "conv_id", "last"))
            order = np.lexsort((conv, k2, k1, depth))
            depth, k1, k2, conv, last = (x[order] for x in (depth, k1, k2, conv, last))
            new = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            size = np.diff(np.append(new, len(conv)))
            # members are in order within a node, so the first is the smallest; ends are cut into lists of the bound
            n_ends = np.add.reduceat(last.astype(np.int64), new)
            at = np.concatenate(([0], np.cumsum(n_ends)))
            ends = conv[last]
            whole = [t.column(c).to_numpy()[order][new] for c in ("p1", "p2", "words")]
            cols = [pa.array(np.full(len(new), part, np.int32)), *map(pa.array, (depth[new], k1[new], k2[new], *whole, size, conv[new]))]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ends))
            yield pa.RecordBatch.from_arrays([*cols, lists], names)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 100_000:
                yield from trie(held)
                held, count = [], 0
        if count:
            yield from trie(held)

    names = [f.split()[0] for f in NODES.split(", ")]
    nodes = rows.select("pos", "k1", "k2", "p1", "p2", "words", "conv_id", "last").mapInArrow(thrifty(combine), NODES)
    # the root: a path of length 0 of every conversation, ended by those without turns
    alone = ids.join(rows.where("pos = 1").select("conv_id", F.lit(True).alias("some")), "conv_id", "left")
    zero = F.lit(0).cast("long")
    root = alone.select(F.spark_partition_id().alias("part"), zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words")], F.lit(1).cast("long").alias("n"), "conv_id", "some")
    block = F.floor(F.col("conv_id") / light).alias("block")  # bounds a list of the root's ends
    root = root.groupBy("part", *KEY, "p1", "p2", "words", block).agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.when(F.col("some").isNull(), F.col("conv_id")))).alias("ends")).drop("block")
    return nodes.unionByName(root)


def merged(parts: DataFrame, fan: int = FAN, light: int = LIGHT) -> tuple[DataFrame, list[DataFrame]]:
    """(one row a node, tables of the ends that were put aside as rows of KEY and ends)."""
    table, aside = written(parts, "trie-parts"), []
    count = (table.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = count <= fan
        count = -(-count // fan)
        heavy = table.where(F.size("ends") > light).select(*KEY, "ends")
        aside.append(heavy)
        kept = table.withColumn("ends", F.when(F.size("ends") > light, F.array().cast("array<long>")).otherwise(F.col("ends")))
        keys = [*KEY, "p1", "p2", "words"]
        table = written(
            kept.groupBy((F.col("part") / fan).cast("int").alias("part"), *keys).agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.array_sort(F.flatten(F.collect_list(F.when(F.size("ends") > 0, F.col("ends"))))).alias("ends")), "trie"
        )
        if last:
            return table, aside


def rolled_up(nodes: DataFrame) -> DataFrame:
    """The nodes with n_children, n_leaves, saved_tokens and parent_conv_id."""
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = written(below.agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone")), "children")
    rows = nodes.count()
    hot = [r[0] for r in children.where(F.col("n_children") > F.lit(max(200, rows / 1000))).select(F.xxhash64(*KEY)).collect()]  # at most a thousand
    own = nodes.join(children, KEY, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("alone", F.lit(0).cast("long")).alias("alone"))
    own = written(own, "trie-children")

    shared = own.where("n > 1").select(*KEY, *[F.when(F.col("depth") > 0, F.col(p)).alias(a) for p, a in (("p1", "a1"), ("p2", "a2"))], (F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    shared = written(shared, "trie-sums")
    reach, deepest = 1, shared.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        # a node's sums cover what is less than reach below it; those at reach add theirs
        up = shared.where(F.col("depth") >= reach).select((F.col("depth") - reach).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2"), "leaves", "saved")
        more = written(up.groupBy(*KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("below")), "trie-up")
        total = shared.join(more, KEY, "left").select(*KEY, "a1", "a2", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c) for c in ("leaves", "saved")])
        # the ancestor's ancestor, for those that have one at twice the reach
        far = total.where(F.col("depth") >= 2 * reach).withColumns({"up": F.col("depth") - reach})
        upper = shared.where(F.col("depth") >= reach).select(F.col("depth").alias("up"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        busy = hot_keys(more, *KEY, count="below")
        far = salted_join(far, upper, ["up", "a1", "a2"], busy, ["k1", "k2"]).select(*KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), "leaves", "saved")
        null = F.lit(None).cast("long")
        near = total.where(F.col("depth") < 2 * reach).withColumns({"a1": null, "a2": null})
        shared = written(far.unionByName(near), "trie-sums")
        reach *= 2
    full = own.join(shared.select(*KEY, "leaves", "saved"), KEY, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    at_root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    # the hash that salted_join takes of the child's side is that of the parent's place
    inner = full.where("depth > 0").withColumn("up", F.col("depth") - 1)
    linked = salted_join(inner, parents.select((F.col("depth") - 1).alias("up"), "p1", "p2", "parent_conv_id"), ["up", "p1", "p2"], hot, ["k1", "k2"]).drop("up")
    done = linked.unionByName(at_root, allowMissingColumns=True)
    return done.select(*KEY, "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), "ends")


def prefix_trie(df: DataFrame, fan: int = FAN, light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes have KEY, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the ends
    that are few; the second table has KEY and lists of ends of the nodes with many."""
    lean(df.sparkSession)
    rows, ids = rebuilt(df)
    nodes, aside = merged(partial_tries(rows, ids, light), fan, light)
    ends = aside[0]
    for more in [*aside[1:], nodes.where(F.size("ends") > light).select(*KEY, "ends")]:
        ends = ends.unionByName(more)
    ends = written(ends, "trie-ends")
    found = rolled_up(nodes).withColumn("ends", F.when(F.size("ends") > light, F.array().cast("array<long>")).otherwise(F.col("ends")))
    return found, ends


def ends_digests(nodes: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """KEY and the digest of the nodes with many ends: ids are sorted and written as text in ranges by many tasks; what is
    left for one task a node is the hash itself over the texts, one at a time."""
    keys = ends.select(*KEY).distinct()
    ids = ends.unionByName(nodes.join(keys, KEY, "left_semi").select(*KEY, "ends")).select(*KEY, F.explode("ends").alias("id"))
    dealt = ids.repartitionByRange(max(partitions(ids.sparkSession), 1), *KEY, "id").sortWithinPartitions(*KEY, "id")
    texts = "depth long, k1 long, k2 long, pid int, seq long, text binary"
    text_names = [f.split()[0] for f in texts.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            change = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(cols[0])]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for s in range(a, b, chunk):
                    text = ",".join(map(str, cols[3][s : min(s + chunk, b)].tolist())).encode()
                    values = [int(cols[0][a]), int(cols[1][a]), int(cols[2][a]), pid, seq, text]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()], strict=True)], text_names)
                    seq += 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])], [*KEY, "digest"])

        for batch in batches:
            for *own, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 5)], strict=True):
                if own != key:
                    if key is not None:
                        yield out()
                    key, state = own, hashlib.sha256(text)
                else:
                    state.update(b",")
                    state.update(text)
        if key is not None:
            yield out()

    lines = written(dealt.mapInArrow(thrifty(write), texts), "trie-lines")
    return lines.repartition(*KEY).sortWithinPartitions(*KEY, "pid", "seq").mapInArrow(thrifty(digest), "depth long, k1 long, k2 long, digest string")


def node_rows(df: DataFrame, fan: int = FAN, light: int = LIGHT) -> DataFrame:
    nodes, ends = prefix_trie(df, fan, light)
    nodes = written(nodes, "trie-nodes")
    few = F.sha2(F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").cast("binary"), 256)
    found = nodes.join(ends_digests(nodes, ends), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", few).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(load(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos FROM t
), ids AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1))))) % 4 AS head
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT i.conv_id, o.pos AS was, o.h, o.w FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.pos <= i.head
  UNION ALL SELECT o.conv_id, o.pos, o.h, o.w FROM own o JOIN ids i ON i.conv_id = o.conv_id WHERE o.pos > i.head
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY was) AS depth, count(*) OVER (PARTITION BY conv_id) AS deepest FROM r
), paths AS (
  SELECT conv_id, depth, deepest, w, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM n
  UNION ALL SELECT i.conv_id, 0, coalesce(m.deepest, 0), 0, '' FROM ids i LEFT JOIN (SELECT conv_id, max(deepest) AS deepest FROM n GROUP BY conv_id) m ON m.conv_id = i.conv_id
), nodes AS (
  SELECT k, depth, min(conv_id) AS c, count(*) AS members, min(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = deepest), '')) AS ends
  FROM paths GROUP BY k, depth
), linked AS (
  SELECT n.*, p.k AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.c AND p.depth = n.depth - 1
), children AS (
  SELECT parent AS k, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT a.k, a.depth, sum((u.members - 1) * u.w) AS saved, count(*) FILTER (WHERE ch.k IS NULL) AS leaves
  FROM nodes u JOIN paths a ON a.conv_id = u.c AND a.depth <= u.depth LEFT JOIN children ch ON ch.k = u.k GROUP BY a.k, a.depth
)
SELECT l.c AS conv_id, CAST(l.depth AS BIGINT) AS depth, q.c AS parent_conv_id, CAST(l.members AS BIGINT) AS n_convs, CAST(coalesce(ch.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, l.ends AS ends_sha256
FROM linked l LEFT JOIN nodes q ON l.depth > 0 AND q.k = l.parent AND q.depth = l.depth - 1 LEFT JOIN children ch ON ch.k = l.k JOIN sums s ON s.k = l.k AND s.depth = l.depth
"""
