"""Conversation tries, fill-in-the-middle and exact top-k search against SQL and plain code."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import cover_tree, middle, prefix_trie
from tessera.llm.registry import oracle_sql, queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_fill_in_middle", "op13_dual_tree"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df, rel = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    assert df.columns == rel.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rel.fetchall()))


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda e: e[0])] for c, x in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:d]), ([], []))
            members.append(c)
            if d == len(turns):
                ends.append(c)
    below, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = below.get(p, [])
        leaves[p] = sum(leaves[q] for q in kids) if kids else 1
        saved[p] = (len(nodes[p][0]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) + sum(saved[q] for q in kids)
        if p:
            below.setdefault(p[:-1], []).append(p)
    return sorted(map(repr, ((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for p, (m, e) in nodes.items())))


@pytest.mark.parametrize(("fan", "light"), [(16, 2048), (2, 5)])
def test_trie_by_plain_code(spark, fan, light):
    """Null turns, ties, repeats, a conversation over several tasks, absent bases, copies, one long chain of prefixes."""
    rng = random.Random(3)
    rows = []
    for c in range(300):
        n = rng.choice([0, 1, 2, 3, 5, 9]) if c % 7 else 40
        rows += [(c, i if rng.random() > 0.05 else None, rng.choice("ab"), rng.choice(["x y", "z", None, ""])) for i in range(n)]
    rows += [(1000, i // 2, "a", "x") for i in range(700)]
    rows += [(c, i, "u", "same") for c in range(2000, 2300) for i in range(3)] + [(c, i, "chain", "of prefixes") for c in range(3000, 3030) for i in range(c - 2995)]
    rows += [(None, 1, "a", "b"), (21, None, None, None), (21, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit("x") for x in ("k1", "pos", "n", "words", "_place", "ends")}).repartition(5)
    assert sorted(map(repr, map(tuple, prefix_trie.node_rows(df, fan, light).collect()))) == plain_trie(rows)
    assert prefix_trie.node_rows(df.where("false")).count() == 0


def plain_cut(doc, text, plain_from):
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    return a, b, "plain" if not text or re.search("<[PSM]>", text) or c % 100 >= plain_from else "spm" if d % 100 < 20 else "psm"


@pytest.mark.parametrize("run", [1, 3, 64])
@pytest.mark.parametrize("unit", [".", r"\S+\s*|\s+", r"[^\n]*\n|[^\n]+"])
def test_middle_by_plain_code(spark, odd_docs, no_docs, unit, run):
    """Whole units are cut whatever the run; restored texts are the texts."""
    more = spark.createDataFrame([(100 + i, f"w{i} zz\n \U0001f600é{i}\t" * i) for i in range(30)] + [(90, "a <S> b"), (91, "<<P>"), (92, "<P <M")], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        units = re.findall(f"(?s){unit}", text)
        a, b, form = plain_cut(r.doc_id, text, 95)
        lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((r.doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, text))
    made = middle.fill_in_middle(docs, unit=unit, run=run, plain_from=95)
    assert sorted(map(repr, map(tuple, made.withColumn("text", middle.restored()).collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"} and middle.fill_in_middle(no_docs).count() == 0


@pytest.mark.parametrize("from_files", [True, False])
def test_texts_travel_once(spark, docs_like, from_files):
    """One exchange of texts serves runs, requests and the final join, and no text is matched twice."""
    df = middle.fill_in_middle(docs_like, from_files=from_files)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("regexp_extract_all") == 1


@pytest.fixture(scope="module")
def docs_like(spark):
    return spark.createDataFrame([(i, "some words here " * i) for i in range(50)], "doc_id long, text string")


def plain_top(rows, every, k):
    best = {}
    for q, v in rows:
        if q % every:
            continue
        found = best.setdefault(q, {})
        for c, w in rows:
            if c != q and len(v) == len(w):
                s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True))))
                found[c] = max(s, found.get(c, s))
    out = []
    for q, found in best.items():
        for i, (c, s) in enumerate(sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k]):
            out.append((q, i + 1, c, s))
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "group_rows"), [(4096, 512), (40, 8)])
def test_top_k_by_plain_code(spark, shard_rows, group_rows):
    """Clusters, a third of equal vectors, ties, repeated ids, several dimensions, large and tiny components."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)] + [(5, [1.0] * 8), (10, rows[10][1]), (10, [0.25] * 8)]
    rows += [(2000 + i, [float(i % 3), -1.0, 0.001]) for i in range(12)] + [(2100, [1e30, 0.0, 1.0]), (2110, [3e9, 2e9, 1.0]), (2111, [3e9 + 256, 2e9, 1.0]), (2120, [0.0, 0.0, -0.0]), (2130, []), (2131, [])]
    odd = [(3000, None), (3010, [None, 1.0, 2.0]), (3020, [float("nan"), 1.0, 2.0]), (3030, [float("inf"), 1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("h", "dim", "name", "score", "rank")}).repartition(3)
    as_floats = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    got = cover_tree.top_k(df, every=10, k=5, shard_rows=shard_rows, group_rows=group_rows).collect()
    assert sorted(map(tuple, got)) == plain_top(as_floats, 10, 5)
    assert cover_tree.top_k(df.where("false")).count() == 0


def test_cover_trees_cover_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 4)) * 10)[np.arange(4000) % 40] + rng.integers(-40, 40, size=(4000, 4)))
    x = np.unique(x, axis=0)
    tree, order = cover_tree.CoverTree.build(x)
    assert (tree.x == x[order]).all() and sorted(order.tolist()) == list(range(len(x)))
    for i in range(len(tree.kids)):
        own = tree.x[tree.start[i] : tree.stop[i]]
        assert np.isclose(np.sqrt(((own - tree.x[tree.centre[i]]) ** 2).sum(axis=1)).max(), tree.radius[i])
        if tree.kids[i]:
            kids = slice(tree.first[i], tree.first[i] + tree.kids[i])
            heads = tree.x[tree.centre[kids]]
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(axis=2))
            np.fill_diagonal(apart, np.inf)
            assert apart.min() >= tree.radius[i] / cover_tree.BASE and tree.radius[kids].max() <= tree.radius[i] / cover_tree.BASE
            assert (tree.start[kids][0], tree.stop[kids][-1]) == (tree.start[i], tree.stop[i])
    queries_, _ = cover_tree.CoverTree.build(x[::80])
    best, scored = cover_tree.dual_search(queries_, [-1] * len(queries_.x), tree, [[i] for i in range(len(x))], 5, np.full(len(queries_.x), -np.inf))
    for q, found in zip(queries_.x, best.found, strict=True):
        s = tree.x @ q
        assert sorted(found.items(), key=lambda e: (-e[1], e[0])) == [(int(i), int(s[i])) for i in np.lexsort((np.arange(len(s)), -s))[:5]]
    assert scored < 0.25 * len(queries_.x) * len(x)  # most pairs are pruned where the data have a structure
