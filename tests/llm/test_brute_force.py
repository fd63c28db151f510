"""Operators against brute force, exact round trips and held-out labels, on small tables."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import arrays, common, hnsw, jaccard_join, order_minhash, packing, piece_dropout, pseudo_likelihood, registry, repair, secrets, toxicity
from tessera.llm.shingles import span_hashes
from tessera.llm.tokens import SegmentEncoder, vocabulary_path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


ODD = ["a", "'s", "'", "the", "The", "É", "é", "é", "́", " ", "  ", "\n", "\r", "\t", " ", " ", "\x85", "\x1c", ".", ",", "...", "!", "<|endoftext|>", "1", "23", "ß", "ª", "µ", "œ", "ς", "İ", "漢", "😀", "ﬁ", "​"]


def odd_texts(n=3000, alphabet=ODD):
    random.seed(7)
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_segments_give_the_librarys_ids(docs, name, byte_level):
    texts = odd_texts() + [r.text for r in docs]
    plain = Tokenizer.from_file(vocabulary_path(name)).encode_batch(texts, add_special_tokens=False)
    got = SegmentEncoder(name, byte_level).encode_many(texts)
    assert all(np.array(e.ids, dtype="<u4").tobytes() == g for e, g in zip(plain, got, strict=True))


def thue_morse(n):
    """Two words that every polynomial modulo a power of two takes for one."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse(1024)
    texts = [a, b, f"x {a} y", f"x {b} y", f"one two {a} three four five", f"one two {b} three four five"]
    for name, byte_level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        plain = Tokenizer.from_file(vocabulary_path(name)).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in SegmentEncoder(name, byte_level).encode_many(texts)] == [e.ids for e in plain]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.jaccard_components(df).orderBy("doc_id").collect()] == list(range(len(texts)))


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_segments_that_share_a_hash_keep_their_own_ids(docs, name, byte_level):
    texts = odd_texts(300) + [r.text for r in docs[:100]]
    plain = Tokenizer.from_file(vocabulary_path(name)).encode_batch(texts, add_special_tokens=False)
    encoder = SegmentEncoder(name, byte_level)
    whole = encoder.table.hashes
    encoder.table.hashes = lambda *x: ((h := whole(*x))[0] & np.uint64(255), *h[1:])
    encoder.table.most = 100
    for _ in range(2):
        got = [x for a in range(0, len(texts), 37) for x in encoder.encode_many(texts[a : a + 37])]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [e.ids for e in plain]


def test_span_hashes_follow_the_bytes_alone():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 20_000).astype(np.uint8)
    start = rng.integers(0, 19_000, 4000)
    stop = start + rng.integers(0, 40, 4000)
    start[:20], stop[:20] = 100, 1000
    h, head, tail = span_hashes(data, start, stop)
    by = {}
    for x, y, a, b, c in zip(start.tolist(), stop.tolist(), h.tolist(), head.tolist(), tail.tolist(), strict=True):
        raw = data[x:y].tobytes()
        assert by.setdefault(raw, a) == a and b == int.from_bytes(raw[:8], "little") and c == int.from_bytes(raw[8:16], "little")
    assert len(set(by.values())) == len(by)


def test_bitmaps_let_every_link_through():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 64, 65, 130, 300, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.uniform(0, 0.3)], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            linked = 100 * common >= 80 * (len(a) + len(b) - common)
            let = jaccard_join.may_link(np.array([len(a)]), [jaccard_join.bitmap(a)], np.array([len(b)]), [jaccard_join.bitmap(b)], 80)[0]
            assert let or not linked
    far = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(50)]
    n, maps = np.full(49, 300), [jaccard_join.bitmap(x) for x in far]
    assert not jaccard_join.may_link(n, maps[:-1], n, maps[1:], 80).any()


def test_names_that_two_sets_share_start_another_try(spark, docs, monkeypatch):
    texts = [r.text for r in docs[:40]] + near_copies(20, 3)
    want, _ = classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = jaccard_join.signatures

    def signatures(src, known, size, percent, seed):
        out = plain(src, known, size, percent, seed)
        return out.withColumn("sid", out.sid.bitwiseAND(3)) if seed == jaccard_join.SEED else out

    monkeypatch.setattr(jaccard_join, "signatures", signatures)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_token_files_round_trip(spark, sf, docs):
    tok = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got, at = {r.doc_id: r for r in repair.op2_token_files(spark, sf).collect()}, 0
    for d in docs:
        ids = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 2], dtype="<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_decode_at_random_places():
    rng = np.random.default_rng(1)
    parts = [np.append(rng.zipf(1.3, n) % 300, 2).astype("<u4") for n in (0, 1, 5, 400, 9000, 30000)] + [np.array([7] * 999 + [2], dtype="<u4")]
    shard = repair.Shard(repair.compress(list(range(len(parts))), [p.tobytes() for p in parts]))
    assert len(shard.left) > 50 and np.array_equal(shard.whole(), np.concatenate(parts))
    for i, p in enumerate(parts):
        assert np.array_equal(shard.document(i), p)
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            assert np.array_equal(shard.ids(i, a, b), p[a:b])


def test_grammar_goes_on_while_it_pays():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3000, 2000).astype("<u4")
    copies = [text.tobytes()] * 64
    few, whole = (repair.Shard(repair.compress(list(range(64)), copies, gain=g)) for g in (repair.GAIN, 0.0))
    for shard in (few, whole):
        assert np.array_equal(shard.whole(), np.tile(text, 64)) and shard.length.max() > 500 and len(shard.symbols) < 64 * 8
    assert (whole.n_symbols == 2).all()  # one rule, and the end, which stays a symbol of its own


def test_packing_is_whole_and_tight(spark, sf, docs):
    tok = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in packing.op6_packing(spark, sf).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append(r)
    for d in docs:
        ids, at = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lost = total = 0
    for rows in used.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        lost, total = lost + (0 if at & (at - 1) == 0 else 4096 - at), total + at
    assert lost < 0.05 * total


def test_repeated_rows_are_dealt_over_groups(spark):
    df = spark.createDataFrame([(7, "one document that very many rows repeat " * 40)] * 6000, "doc_id long, text string")
    rows = packing.pack(df, windows=16).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert len({r.sequence_id >> 32 for r in rows}) > 8 and max(used.values()) <= 4096 and sum(r.start == 0 for r in rows) == 6000


def test_differencing_is_even():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 400)
    sums = [int(sizes[w].sum()) for w in packing.differencing(sizes, 40)]
    assert sum(sums) == sizes.sum() and max(sums) - min(sums) <= 20
    windows = packing.pack_sizes(np.array([3000, 3000, 3000]), 4096)
    assert sorted(map(len, windows)) == [1, 1, 1]


def test_order_minhash_by_plain_code(spark, sf, docs):
    got = {r.doc_id: r for r in order_minhash.op5_order_minhash(spark, sf).collect()}
    omh = order_minhash.OrderMinHash()
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        q = len(d.text) // 4
        changed = d.text[: len(d.text) - q] + after[:q]
        r = got[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == order_minhash.to_hex(omh.signature(d.text)) and r.edited_fingerprint == order_minhash.to_hex(omh.signature(changed))
        assert r.near_next == (omh.signature(d.text) == omh.signature(after)).mean()


def plain_signature(text, k=8, m=32, ell=2, seed=1):
    """Order MinHash from its definition, with Python's integers."""
    p, mix, full = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (1 << 64) - 1

    def stir(x):
        x = (x ^ x >> 30) * mix[0] & full
        x = (x ^ x >> 27) * mix[1] & full
        return x ^ x >> 31

    if not text:
        return [0] * m
    seen, numbered = defaultdict(int), []
    for i in range(max(1, len(text) - k + 1)):
        gram = text[i : i + k]
        name = stir((len(gram) + sum(ord(c) * pow(p, j, 1 << 64) for j, c in enumerate(gram))) & full) >> 24
        numbered.append((stir((name * p + seen[name] * mix[1]) & full), i))
        seen[name] += 1
    out = []
    for j in range(m):
        flip, times = stir((seed + j) * p & full), stir((seed + m + j) * p & full) | 1
        least = sorted(numbered, key=lambda g: (g[0] ^ flip) * times & full)[:ell]
        h = len(least)
        for g, _ in sorted(least, key=lambda g: g[1]):
            h = stir((h * p + g) & full)
        out.append(h >> 32)
    return out


def test_order_minhash_follows_its_definition():
    random.seed(6)
    texts = ["", "a", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc"] + ["".join(random.choice("abcde é漢😀") for _ in range(random.randint(1, 300))) for _ in range(25)]
    omh = order_minhash.OrderMinHash()
    for text in texts:
        assert omh.signature(text).tolist() == plain_signature(text), text


def test_order_minhash_feels_order():
    omh = order_minhash.OrderMinHash(m=64)
    random.seed(5)
    a, b = ("".join(random.choice("abcdefghij") for _ in range(600)) for _ in range(2))
    near = lambda x, y: order_minhash.likeness(omh.signature(x), omh.signature(y))
    assert near(a, a) == 1 and near(a, b) < 0.05 and 0.1 < near(a + b, b + a) < 0.9 and near(a, a[:300] + "zz" + a[300:]) > near(a + b, b + a)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(n, seed, length=60, edits=5):
    random.seed(seed)
    base, out = [f"w{random.randint(0, 999)}" for _ in range(length)], []
    for _ in range(n):
        words = list(base)
        for _ in range(random.randint(0, edits)):
            words[random.randrange(length)] = f"x{random.randint(0, 99999)}"
        out.append(" ".join(words[: length - random.randint(0, 6)]))
    return out


@pytest.mark.parametrize(("sub_bucket", "large", "least_hot", "most_bits"), [(4096, 48, 200, 1 << 29), (4, 2, 200, 1 << 29), (4, 2, 1, 1)])
def test_jaccard_equals_all_pairs(spark, docs, monkeypatch, sub_bucket, large, least_hot, most_bits):
    """Also with dealt buckets, salted keys, and joins in place of filters."""
    monkeypatch.setattr(jaccard_join, "SUB_BUCKET", sub_bucket)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(common, "LEAST_HOT", least_hot)
    monkeypatch.setattr(arrays.IdFilter, "MOST", most_bits)
    texts = [r.text for r in docs[:60]] + near_copies(90, 1) + near_copies(40, 2, 30, 3) + ["same words here again and again"] * 5
    want, sizes = classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == sizes
    repeated = df.unionAll(df.where("doc_id % 7 = 0")).repartition(3)  # rows that repeat, in several partitions
    assert sorted(r.doc_id for r in jaccard_join.keep_one(repeated).collect()) == sorted(set(want))


def test_whole_keys_come_together():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 5000))
    keys[1000:4000] = keys[1000]
    keys.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 70])], ["k"]) for a in range(0, 5000, 70)]
    got = [t.column("k").to_numpy() for t in common.whole_keys(iter(batches), ["k"], least=300)]
    assert np.array_equal(np.concatenate(got), keys) and len(got) > 3
    assert all(not set(a) & set(b) for i, a in enumerate(got) for b in got[i + 1 :]) and list(common.whole_keys(iter([]), ["k"])) == []


def test_jaccard_query(spark, sf, docs):
    want, _ = classes([r.text for r in docs])
    got = {r.doc_id: r.component_id for r in jaccard_join.op9_jaccard_join(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == [docs[i].doc_id for i in want]


def test_jaccard_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(registry.oracle_sql()["op9_jaccard_join"])
    rows = jaccard_join.op9_jaccard_join(spark, sf).collect()
    assert sorted(want.columns) == sorted(rows[0].asDict()) and sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(tuple(r) for r in want.select("doc_id, n_shingles, component_id").fetchall())


def test_secrets_by_plain_patterns(spark, sf, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    cases = ['API_KEY = "abc123xyz"', "token=a token=token:abcdef", "AKIA" + "A" * 15, "AKIA" + "Z" * 16, "f" * 23 + " " + "0" * 24, "ſecret=abcdef password: hunter22", "passphrase is xK9$mQ2vLp!", "é password=é password=abcdef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(r.doc_id + 100, r.text) for r in docs], "doc_id long, text string")
    for r, (_, text) in zip(sorted(secrets.secret_spans(df).collect(), key=lambda r: r.doc_id), [(i, t) for i, t in enumerate(cases)] + [(d.doc_id + 100, d.text) for d in docs], strict=True):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert secrets.find_spans(cases[6])[0][0][2] == "guess"


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password") < cost("qwertyuiop") < cost("Tr0ub4dor&3") and cost("aaaaaaaaaaaa") < 5 and cost("abcabcabcabc") < 6 and cost("19871204") < 6 and cost("changeme") < 3
    random.seed(1)
    for _ in range(50):  # the cheapest segmentation is no dearer than either part's, put together
        a, b = ("".join(random.choice("ab1Q$z") for _ in range(random.randint(1, 8))) for _ in range(2))
        assert cost(a + b) <= cost(a) + cost(b) + 1e-9


def plain_guess_cost(value):
    """The same segmentation, every edge of every place followed to its end."""
    S, n, low = secrets, len(value), value.lower()
    plain, best, pick = low.translate(S.LEET), [0.0] + [math.inf] * len(value), math.log10(6)
    spoken, vowel, cluster = re.compile(r"[A-Za-z]?[a-z]{2,13}"), re.compile("[aeiouyAEIOUY]"), re.compile("[^aeiouyAEIOUY]{5}")
    for i in range(n):
        edges = [(i + 1, S._brute(value[i]))]
        for j in range(i + 3, min(n, i + S.LONGEST_WORD) + 1):
            word, leet = S.RANK.get(low[i:j]), S.RANK.get(plain[i:j])
            if word or leet:
                edges.append((j, pick + math.log10((word or leet) + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.6 * (not word)))
        if m := spoken.match(value, i):
            edges += [(j, pick + 4.0) for j in range(i + 3, m.end() + 1) if vowel.search(value, i, j) and not cluster.search(value, i, j)]
        if m := S.DATE.match(value, i):
            edges.append((m.end(), pick + math.log10(365 * 120 if m.end() - i > 4 else 120)))
        for width in range(1, 9):
            j = i + width
            while j + width <= n and value[j : j + width] == value[i : i + width]:
                j += width
                if width > 1:
                    edges.append((j, pick + sum(map(S._brute, value[i : i + width])) + math.log10((j - i) / width)))
                elif j - i >= 3:
                    edges.append((j, pick + math.log10(94 * (j - i))))
        j, turns = i + 1, 0
        while j < n and j < i + 64 and low[j] in S.NEAR.get(low[j - 1], ()):
            turns += j - i < 2 or ord(low[j]) - ord(low[j - 1]) != ord(low[j - 1]) - ord(low[j - 2])
            j += 1
            if j - i >= 4:
                edges.append((j, pick + math.log10(47 * (j - i)) + 0.7 * turns))
        for j, cost in edges:
            best[j] = min(best[j], best[i] + cost)
    return best[n]


def test_guess_costs_are_those_of_a_plain_program():
    random.seed(9)
    parts = ["password", "p@ss", "qwerty", "asdf", "1234", "19871204", "2020", "aaaa", "abab", "Tr0ub", "zxcv", "é", "bcdfg", "stormy", "$", "Q", "7", "==", "ab1", "summer", "x"]
    for _ in range(400):
        value = "".join(random.choice(parts) for _ in range(random.randint(0, 8)))
        assert abs(secrets.guess_cost(value) - plain_guess_cost(value)) < 1e-9, value
    for _ in range(25):
        value = "".join(random.choice(parts) * random.choice([1, 1, 1, random.randint(1, 150)]) for _ in range(4))
        assert abs(secrets.guess_cost(value) - plain_guess_cost(value)) < 1e-9, value


def test_long_values_take_linear_time(spark):
    began = time.time()
    assert secrets.guess_cost("a" * 1_000_000) < 9 and secrets.guess_cost("ab" * 200_000) < 12
    assert time.time() - began < 8
    began = time.time()
    spans, most = secrets.find_spans("password=" + "a" * 1_000_000 + " token: " + "qwertyuiop" * 2000)
    assert time.time() - began < 8 and spans[0] == (0, 1_000_009, "assign") and most > 9
    df = spark.createDataFrame([(1, "pwd => " + "z" * 100_000)], "doc_id long, text string")
    assert secrets.secret_spans(df).first().n_guess == 0  # one character, repeated


def test_mask(spark):
    text = "x token=abcdef1234567890abcdef1234567890 y"
    r = secrets.mask_secrets(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")).first()
    assert r.text == "x [secret] y" and r.n_chars == len(r.text)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    v[1000:1400] = v[0]
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    index = hnsw.build_index(df, 20, shard_rows=700)
    queries = hnsw.valid_vectors(df, "vec_id", "embedding").where("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in hnsw.search_index(index, queries, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    found = 0
    for i in range(0, 3000, 20):
        score = (v.astype(np.float64) * v[i].astype(np.float64)).sum(axis=1)
        best = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:20]
        found += len(set(best) & {j for j, _ in got[i]})
        assert len(got[i]) == 20 and all(abs(s - score[j]) < 1e-9 for j, s in got[i]) and got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
    assert found >= 0.9 * 150 * 20


def test_dropout_zero_is_the_library_and_all_decode(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    texts = [t for t in odd_texts(1500) if "▁" not in t] + [r.text for r in docs]
    plain = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.0)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in plain.encode_many(texts)] == sp.encode(texts)
    some = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.2, seed=1)
    other = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.2, seed=2)
    texts += odd_texts(500, [*ODD, "▁", "\ufdd0", "\ud7ff"])
    a, b = some.encode_many(texts), other.encode_many(texts)
    assert [some.model.decode(np.frombuffer(x, dtype="<u4").astype(np.int64)) for x in a] == texts
    assert a == some.encode_many(texts) and sum(x != y for x, y in zip(a, b, strict=True)) > 0.5 * len(docs)


def plain_agenda(model, segment, key, dropout):
    """The agenda as one list: the best candidate is taken out, and merged unless its own draw skips it."""
    parts = [(i, i + 1, int(x)) for i, x in enumerate(model.symbols(segment))]
    gone, ordinary = set(), {i: p for i, p in enumerate(model.pieces)}
    by_name = {ordinary[int(i)]: int(i) for i in model.join} | model.char
    while True:
        best = None
        for (a, m, x), (_, e, y) in zip(parts[:-1], parts[1:], strict=True):
            if x < model.size and y < model.size and (a, m, e) not in gone and (piece := by_name.get(ordinary[x] + ordinary[y])) is not None:
                if best is None or model.rank[piece] < best[0]:
                    best = (model.rank[piece], a, m, e, piece)
        if best is None:
            return model.with_bytes(np.array([x for *_, x in parts], dtype=np.int64)).astype("<u4").tobytes()
        _, a, m, e, piece = best
        one = np.array([a]), np.array([m]), np.array([e])
        if dropout and piece_dropout.skipped(np.array([key], dtype=np.uint64), piece_dropout.candidate(*one), dropout)[0]:
            gone.add((a, m, e))
            continue
        at = next(i for i, p in enumerate(parts) if p[0] == a)
        parts[at : at + 2] = [(a, e, piece)]


def test_dropout_is_that_of_a_plain_agenda(docs):
    model = piece_dropout.PieceModel("piece_bpe_32k.model")
    segments = [t.replace(" ", "▁") for t in odd_texts(150) if t] + ["▁" + w for r in docs[:4] for w in r.text.split()[:150]] + ["a" * 90, "漢字かな" * 30]
    key = np.random.default_rng(2).integers(0, 1 << 63, len(segments), dtype=np.uint64)
    for dropout in (0.0, 0.1, 0.5):
        want = [plain_agenda(model, s, k, dropout) for s, k in zip(segments, key, strict=True)]
        assert model.encode_segments(segments, key, dropout) == want
        assert [model.encode_long(s, int(k), dropout) for s, k in zip(segments, key, strict=True)] == want
        ways = model.encode_segments(segments, key, dropout, True)
        assert ways == [model.encode_long(s, int(k), dropout, True) for s, k in zip(segments, key, strict=True)]


def test_what_is_kept_changes_no_draw(docs):
    encoder = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.2, seed=9)
    text = " ".join(r.text for r in docs[:3])
    (got,) = encoder.encode_many([text])
    salt = np.array([zlib.crc32(text.encode())], dtype=np.uint64) * np.uint64(0x1_0001) + np.uint64(9 * 1_000_003)
    segments = re.findall("▁+[^▁\n\t]*|[\n\t]+|[^▁\n\t]+", ("▁" + text.replace(" ", "▁")))
    key = piece_dropout.mixed(piece_dropout.mixed(np.repeat(salt, len(segments))) + np.arange(len(segments)).astype(np.uint64))
    assert got == b"".join(plain_agenda(encoder.model, s, k, 0.2) for s, k in zip(segments[:300], key, strict=False)) + got[sum(len(plain_agenda(encoder.model, s, k, 0.2)) for s, k in zip(segments[:300], key, strict=False)) :]


def test_long_segments_take_linear_time():
    encoder = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.1)
    text, began = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(100_000)), time.time()
    (ids,) = encoder.encode_many([text])
    assert time.time() - began < 20 and encoder.model.decode(np.frombuffer(ids, dtype="<u4").astype(np.int64)) == text


def test_each_occurrence_draws_its_own_dropout():
    encoder = piece_dropout.DropoutEncoder("piece_bpe_32k.model", 0.3, seed=3)
    texts = [f"{i} configuration" for i in range(300)] + ["configuration " * 300]
    got = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in encoder.encode_many(texts)]
    assert [encoder.model.decode(x) for x in got] == texts
    names = [[encoder.model.pieces[j] for j in x] for x in got[:-1]]
    words = {tuple(x[max(i for i, p in enumerate(x) if p.startswith("▁")) :]) for x in names}
    assert len(words) > 4 and all("".join(w) == "▁configuration" for w in words)
    again = encoder.encode_many(texts[5:6] * 2)  # repeated rows are alike
    assert again[0] == again[1] == got[5].astype("<u4").tobytes()


def test_toxicity_on_held_out_rows(spark, tmp_path):
    random.seed(4)
    common, bad = [f"word{i}" for i in range(300)], ["idiot", "grubbenfoo", "grubbenbar", "grubbenbaz", "moron"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        words = [random.choice(common) for _ in range(40)] + ([random.choice(bad) for _ in range(2)] if toxic else [])
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 200 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_label_model_trusts_the_better_voters():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.9, 0.02), (0.7, 0.05), (0.6, 0.3))], axis=1)
    votes = np.concatenate([votes, votes[:, 2:]], axis=1)  # a copy of the worst voter adds no evidence
    p = toxicity.label_model(votes, np.full(4000, -1), np.array([True, False, False, False]))
    assert ((p > 0.5) == y).mean() > max(0.92, (votes[:, 1] == y).mean(), (votes[:, 2] == y).mean())


def test_scores_prefer_the_order_that_was_learned(spark):
    random.seed(8)
    chain = {i: [(i * 7 + 1) % 50, (i * 3 + 2) % 50] for i in range(50)}
    texts = []
    for _ in range(400):
        w = [random.randrange(50)]
        for _ in range(199):
            w.append(random.choice(chain[w[-1]]))
        texts.append(w)
    shuffled = [random.sample(w, len(w)) for w in texts[:50]]
    df = spark.createDataFrame([(i, " ".join(f"t{x}" for x in w)) for i, w in enumerate(texts + shuffled)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in pseudo_likelihood.pseudo_likelihood(df).collect()}
    assert np.mean([got[i] for i in range(400)]) > np.mean([got[i] for i in range(400, 450)]) + 0.3


def test_links_are_all_pairs_within_the_threshold(spark):
    random.seed(12)
    texts = []
    for g in range(4):
        base = [f"g{g}w{random.randrange(500)}" for _ in range(120)]
        for _ in range(9):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = f"x{random.random()}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[9], "a b", "a b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    first = {s: sets.index(s) for s in sets}
    want = {tuple(sorted((first[sets[i]], first[sets[j]]))) for i, j in near if sets[i] != sets[j]}
    got = jaccard_join.jaccard_links(df).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in got) == sorted(want) and len(want) > 25
    assert all(r.copies_a == sets.count(sets[r.a]) and r.copies_b == sets.count(sets[r.b]) for r in got)
    counts = {r.doc_id: r.n_links for r in jaccard_join.link_counts(df).collect()}
    assert counts == {i: sum(i in p for p in near) for i in range(len(sets))}


def words_in(text):
    return np.concatenate([w for _, _, w, _ in pseudo_likelihood.words_of(pa.array([text]))])


def small_vocabulary(n=300, cells=16, seed=0):
    rng = np.random.default_rng(seed)
    words = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return pseudo_likelihood.Vocabulary(words, rng.zipf(1.5, len(words)).clip(1, 10_000) + 31, rng.integers(0, 500, cells).astype(float), rng.integers(0, 9, cells).astype(float))


def random_network(known, seed=1):
    net, rng = pseudo_likelihood.Network(known), np.random.default_rng(seed)
    net.flat += rng.normal(0, 0.3, net.size).astype(np.float32)
    return net


def test_probabilities_are_those_of_plain_loops_and_sum_to_one():
    known = small_vocabulary()
    net, rng = random_network(known), np.random.default_rng(2)
    items, bound = rng.integers(0, known.size, 9).astype(np.int32), np.array([0, 2, 9])
    around = pseudo_likelihood.windows(items, bound, np.arange(9), known.size)
    got = net.log_items(around, items, known)
    e, u, w, b, v, c = (p.astype(np.float64) for p in net.parts)

    def way(item):  # halve the item's class until it is alone
        run = [i for i in known.order.tolist() if known.label[i] == known.label[item]]
        first = int(np.flatnonzero(known.label[known.order] == known.label[item])[0])
        low, high = first, first + len(run)
        while high - low > 1:
            cut = (low + high) // 2
            mass = lambda x, y: sum(known.mass[i] for i in known.order[x:y])
            right = run.index(item) + first >= cut
            yield cut, math.log(mass(cut, high) / mass(low, cut)), right
            low, high = (cut, high) if right else (low, cut)

    def log_p(ids, item):
        h = np.tanh(np.concatenate([e[k] for k in ids]) @ w + b)
        z = h @ v + c
        out = z[known.label[item]] - math.log(sum(math.exp(x) for x in z))
        for cut, prior, right in way(item):
            score = prior + float(u[cut] @ h[: pseudo_likelihood.TURN])
            out -= math.log1p(math.exp(-score if right else score))
        return out

    for i in range(9):
        doc = 0 if i < 2 else 1
        ids = [items[j] if bound[doc] <= j < bound[doc + 1] else known.size for j in (i - 2, i - 1, i + 1, i + 2)]
        assert list(around[i]) == ids and abs(log_p(ids, int(items[i])) - got[i]) < 1e-4
    every = np.arange(known.size, dtype=np.int32)
    assert abs(np.exp(net.log_items(np.repeat(around[:1], known.size, axis=0), every, known)).sum() - 1) < 1e-4


def test_gradients_lower_the_loss_of_every_part():
    known = small_vocabulary(120, 8)
    rng = np.random.default_rng(3)
    around = rng.integers(0, known.size + 1, (4096, 4)).astype(np.int32)
    items = (around[:, 1] * 7 % known.size).astype(np.int32)  # the word follows from its neighbour
    net = pseudo_likelihood.Network(known)
    state = pseudo_likelihood.Moments(net)
    before, old = net.log_items(around, items, known).mean(), net.flat.copy()
    for _ in range(15):
        net.train(around, items, known, state)
    after = net.log_items(around, items, known).mean()
    assert after > before + 1 and all(m.any() for m in state.met)
    assert (net.parts[1] != 0).any() and (net.flat != old).mean() > 0.5 and (net.parts[0][-1] == 0).all()


def test_every_window_trains_the_network_once(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(20)] + [(99, "lone"), (100, None)], "doc_id long, text string").coalesce(1)
    src = df.select("text")
    known = pseudo_likelihood.vocabulary(pseudo_likelihood.word_counts(src))
    met = []
    plain = pseudo_likelihood.array_sum
    try:
        pseudo_likelihood.array_sum = lambda *x: met.append(plain(*x)) or met[-1]
        net = pseudo_likelihood.train(src, spark.sparkContext.broadcast(known))
    finally:
        pseudo_likelihood.array_sum = plain
    assert sum(m[net.size + 2 * known.size + 1] for m in met) == 801 and len(met) == pseudo_likelihood.ROUNDS
    fresh = pseudo_likelihood.Network(known)
    used = known.items(words_in(" ".join(r.text for r in df.where("doc_id < 20").collect())))
    assert (net.parts[0] != fresh.parts[0]).any(axis=1)[used].all()


def test_every_word_has_its_own_count(spark):
    n = 20_000
    texts = [" ".join(["Common"] * 5000)] + [" ".join(f"r{i}" for i in range(a, a + 1000)) for a in range(0, n, 1000)] + [None, ""]
    src = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = pseudo_likelihood.word_counts(src)
    known = pseudo_likelihood.vocabulary(counts)
    got = {r.word: r.n for r in counts.collect()}
    rare = words_in(" ".join(f"r{i}" for i in range(n)))
    assert len(got) == n + 1 and all(got[int(x)] == 1 for x in rare.view(np.int64)) and got[int(words_in("common").view(np.int64)[0])] == 5000
    assert known.known == 1 and known.items(words_in("common")).tolist() == [0] and (known.items(rare) > 0).all()
    assert known.cell_total.sum() == n + 0.5 * (n + known.cells)


def test_scores_are_sums_over_words_and_know_what_is_alone(spark):
    random.seed(3)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(random.choice(common) if random.random() < 0.8 else f"u{i}x{j}" for j in range(60)) for i in range(60)]
    texts += texts[:6] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = pseudo_likelihood.word_counts(df)
    known = pseudo_likelihood.vocabulary(counts)
    shared = spark.sparkContext.broadcast(known)
    net = pseudo_likelihood.train(df, shared)
    n = {r.word: r.n for r in counts.collect()}
    for r in pseudo_likelihood.score(df, net, shared, counts).collect():
        text = texts[r.doc_id] or ""
        if not text:
            assert (r.n_tokens, r.log_prob, r.mean_log_prob, r.n_unknown) == (0, 0, None, 0)
            continue
        w = words_in(text)
        items = known.items(w)
        p = net.log_items(pseudo_likelihood.windows(items, np.array([0, len(w)]), np.arange(len(w)), known.size), items, known)
        names = w.view(np.int64).tolist()
        own, held, alone = 0.0, 0.0, 0
        for name, item in zip(names, items.tolist(), strict=True):
            if item >= known.known:
                own += math.log((n[name] + 0.5) / known.cell_total[item - known.known])
                held += math.log((n[name] - names.count(name) + 0.5) / known.cell_total[item - known.known])
                alone += n[name] == names.count(name)
        assert abs(r.log_prob - p.sum() - own) < 1e-3 and abs(r.held_log_prob - p.sum() - held) < 1e-3 and r.n_unknown == alone
        assert (r.n_unknown == 0) == (r.doc_id in {*range(6), *range(60, 66)})


def test_a_mini_batch_is_what_plain_loops_make():
    known, rng = small_vocabulary(200, 8), np.random.default_rng(4)
    around, target = rng.integers(0, known.size + 1, (300, 4)).astype(np.int32), (rng.zipf(1.3, 300) % known.size).astype(np.int32)
    net, turn = random_network(known), pseudo_likelihood.TURN
    net.parts[0][-1] = 0
    e, u, w, b, v, c = (p.astype(np.float64) for p in net.parts)
    grads, met = [np.zeros_like(p) for p in (e, u, w, b, v, c)], [np.zeros(len(e), dtype=int), np.zeros(len(u), dtype=int)]
    backs = []
    for ids, item in zip(around.tolist(), target.tolist(), strict=True):
        x = np.concatenate([e[k] for k in ids])
        h = np.tanh(x @ w + b)
        g = np.exp(h @ v + c)
        g /= g.sum()
        g[known.label[item]] -= 1
        up = v @ g
        for at in range(known.way[item], known.way[item] + known.depth[item]):
            node = known.node[at]
            miss = 1 / (1 + math.exp(-known.prior[node] - u[node] @ h[:turn])) - known.turn[at]
            up[:turn] += miss * u[node]
            grads[1][node] += miss * h[:turn] / 300
            met[1][node] += 1
        back = up * (1 - h * h)
        backs.append(back)
        for p, q in zip(grads[2:], (np.outer(x, back), back, np.outer(h, g), g), strict=True):
            p += q / 300
    dense = [old - pseudo_likelihood.RATE * grad / (np.abs(grad) + 1e-8) for old, grad in zip((w, b, v, c), grads[2:], strict=True)]
    for ids, back in zip(around.tolist(), backs, strict=True):
        for k, part in zip(ids, (back @ dense[0].T).reshape(4, -1), strict=True):  # the words' vectors follow the dense layers
            grads[0][k] += part / 300
            met[0][k] += 1
    state = pseudo_likelihood.Moments(net)
    net.train(around, target, known, state)
    for got, old, grad in zip(net.parts[:2], (e, u), grads[:2], strict=True):
        want = old - pseudo_likelihood.SPARSE_RATE * grad / (np.sqrt((grad**2).mean(axis=1, keepdims=True)) + 1e-8)
        want[len(u) :] = 0  # the vector of what is beyond a text
        assert np.abs(got - want).max() < 2e-3 and np.abs(got - old).max() > 0.05
    assert all(np.abs(got - want).max() < 1e-4 for got, want in zip(net.parts[2:], dense, strict=True))
    assert all((m == n).all() for m, n in zip(state.met, met, strict=True))


def test_a_step_adds_equal_rows_without_sorting_them():
    known, rng = small_vocabulary(30_000, 4096), np.random.default_rng(5)
    net = pseudo_likelihood.Network(known)
    state = pseudo_likelihood.Moments(net)
    at = rng.zipf(1.2, 13_000) % known.size
    grad = rng.normal(0, 1, (13_000, pseudo_likelihood.TURN)).astype(np.float32)
    squares = np.zeros(known.size, dtype=np.float32)
    table = net.parts[1].copy()

    def sorting():
        order = np.argsort(at.astype(np.uint16), kind="stable")
        own = at[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows, total = own[starts], np.add.reduceat(grad[order], starts, axis=0)
        squares[rows] += (total * total).mean(axis=1)
        table[rows] -= pseudo_likelihood.SPARSE_RATE * total / (np.sqrt(squares[rows])[:, None] + 1e-8)

    took = [[], []]
    for _ in range(30):
        for times, run in zip(took, (sorting, lambda: state.step(1, net.parts[1], at, grad.copy())), strict=True):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
    assert np.abs(table - net.parts[1]).max() < 1e-3 and (table != 0).any()
    assert min(took[1]) < 0.75 * min(took[0])


def test_a_pass_in_several_calls_is_one_pass():
    known, rng = small_vocabulary(), np.random.default_rng(1)
    around, target = rng.integers(0, known.size + 1, (4096, 4)).astype(np.int32), rng.integers(0, known.size, 4096).astype(np.int32)
    whole, parts = pseudo_likelihood.Network(known), pseudo_likelihood.Network(known)
    whole.train(around, target, known, pseudo_likelihood.Moments(whole))
    state = pseudo_likelihood.Moments(parts)
    for a in range(0, 4096, 2048):
        parts.train(around[a : a + 2048], target[a : a + 2048], known, state)
    assert np.array_equal(whole.flat, parts.flat)


def test_pipeline_is_what_plain_code_makes(spark, sf, docs, tmp_path):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + i, t) for i, t in enumerate(near_copies(25, 4))] + [(20_000, "api_key=abcdef123456 and no more"), (20_001, None), (20_002, "")]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.written(stage(spark, table, str(tmp_path)), "stage")
        kept.append({r.doc_id: r.text for r in table.collect()} if "text" in table.columns else table.collect())
    clean, single, masked, packed = kept
    toxic = {r.doc_id for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect() if r.predicted}
    assert set(clean) == {i for i, _ in rows} - toxic and len(clean) > 0.8 * len(rows)
    names, texts = zip(*sorted(clean.items()), strict=True)
    of, _ = classes(list(texts))
    assert set(single) == {names[i] for i in set(of)} and len(single) < len(clean) and all(single[i] == clean[i] for i in single)
    assert set(masked) == set(single) and masked[20_000] == "[secret] and no more" and masked[20_001] is None
    for i, text in single.items():
        spans = secrets.find_spans(text)[0] if text else []
        covered = set().union(*[range(a, b) for a, b, _ in spans]) if spans else set()
        plain = "".join(c if k not in covered else "" for k, c in enumerate(text or ""))
        assert (masked[i] or "").replace("[secret]", "") == plain.replace("[secret]", "")
    tok = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(int)
    for r in packed:
        pieces[r.doc_id].append(r)
        used[r.sequence_id] += r.length
    assert set(pieces) == set(masked) and max(used.values()) <= 4096
    for i, text in masked.items():
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_toxicity_on_the_held_out_labels(spark):
    """Labels of rows that the model didn't learn from, of a table of some size."""
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no such table")
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))
