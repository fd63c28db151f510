import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import sections as X
from tessera.operators.index import IndexStore, postings
from tessera.plans.api import Status
from tessera.sources import archives as A
from tessera.sources import playbook as P
from tessera.sources import rawdocs as D
from tessera.streaming import refresh as R


def make_zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_zip_sources(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"repo/_versions/3.1/guides/x/a.adoc": "A", "repo/_versions/main/guides/b.adoc": "B", "repo/_versions/main/guides/c.txt": "C"})
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    entries = A.entries(spark, f"{tmp_path}/*.zip")
    got = {tuple(r) for r in A.versioned_docs(entries, ["main", "3.1"]).collect()}
    assert got == {("3.1", "x/a.adoc", "A"), ("main", "b.adoc", "B")}
    make_zip(tmp_path / "e.zip", {"r-1/docs/modules/ROOT/pages/i/n.adoc": "N", "r-1/docs/modules/dev/pages/o.adoc": "O", "r-1/docs/antora.yml": "title: My Ext\n"})
    e = A.entries(spark, f"{tmp_path}/e.zip")
    assert [tuple(r) for r in A.extension_docs(e, "ext").collect()] == [("extensions/ext/i/n.adoc", "N")]
    assert A.component_title(e) == "My Ext"


def test_playbook_and_manifest(spark, tmp_path):
    text = "content:\n  sources:\n  - url: https://github.com/o/r.git\n    branches: [HEAD, v*, dev]\n    start_path: docs\n  - url: https://other.example/x\n  - url:\n"
    assert [tuple(r) for r in P.sources_table(spark, text).collect()] == [("r", "o", "r", "dev", "docs")]
    assert P.content_sources("a: [") == [] and P.resolve_branch(None) == "main" and P.resolve_branch(3.2) == "3.2" and P.resolve_branch("/x/") == "main"
    (tmp_path / "m.json").write_text('[{"name": "a.adoc", "path": "d/a.adoc", "sha": "1", "size": 3}, {"name": "b", "path": "d/b", "sha": "2"}]')
    assert [tuple(r) for r in P.manifest_paths(P.read_manifest(spark, str(tmp_path / "m.json")), "d/").collect()] == [("a.adoc", "1")]


def test_raw_documents(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a b.adoc", "x\ny"), ("1", "s/c.adoc", "z"), ("2", "d.adoc", "w")], D.SCHEMA)
    assert D.write_files(docs, str(tmp_path / "f")) == 3
    assert {tuple(r) for r in D.read(spark, str(tmp_path / "f")).collect()} == {tuple(r) for r in docs.collect()}
    D.write(docs, str(tmp_path / "t"))
    D.write(docs.where("version = '2'").withColumn("content", F.lit("new")), str(tmp_path / "t"))
    table = D.read_table(spark, str(tmp_path / "t"))
    assert {r.content for r in table.collect()} == {"x\ny", "z", "new"}
    assert [r.path for r in D.list_paths(table, "1").collect()] == ["a b.adoc", "s/c.adoc"] and D.exists(table, "2") and not D.exists(table, "3")
    assert D.read(spark, str(tmp_path / "none")).count() == 0


def table(store, name, version="1"):
    return sorted(map(repr, store.read(name, version).collect()))


def test_refresh_removes_keeps_and_turns_all_tables_at_once(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "store"))
    pages = lambda **c: spark.createDataFrame([(f"{k}.adoc", v, "core") for k, v in c.items()], "path string, content string, extension string")
    assert R.refresh_version(store, "1", pages(a="= A\none two", b="= B\nthree", c="= C\nfour"))
    assert not R.refresh_version(store, "1", pages(a="= A\none two", b="= B\nthree", c="= C\nfour"))
    assert R.refresh_version(store, "1", pages(a="= A\none two", b="= B\nseven", d="= D\nfive"))
    want = R.X.chunks(pages(a="= A\none two", b="= B\nseven", d="= D\nfive").selectExpr("'1' AS version", "*"))
    assert sorted(r.page for r in store.read("chunks", "1").collect()) == sorted(r.page for r in want.collect())
    assert {r.path for r in store.read("manifest", "1").collect()} == {"a.adoc", "b.adoc", "d.adoc"}
    words = {r.lexeme for r in store.read("postings", "1").collect()}
    assert {"one", "seven", "five"} <= words and not {"three", "four"} & words
    # a write that fails after some tables leaves all of them as they were
    before = {n: table(store, n) for n in ("raw", "manifest", "chunks", "postings")}
    writes, plain = [], type(store.read("raw", "1").write).parquet

    def parquet(self, path, *args, **kwargs):
        writes.append(path)
        if len(writes) > 2:
            raise OSError("disk full")
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(type(store.read("raw", "1").write), "parquet", parquet)
    with pytest.raises(OSError):
        R.refresh_version(store, "1", pages(a="= A\nnine"))
    monkeypatch.undo()
    left = {p.name for p in (tmp_path / "store" / "1").iterdir()}
    assert not any(w.rsplit("/", 1)[1] in left for w in writes)  # nothing of the failed write stays
    assert len(writes) == 3 and before == {n: table(store, n) for n in before}
    assert R.refresh_version(store, "1", pages(a="= A\nnine")) and len(table(store, "raw")) == 1


def test_refresh_of_one_extension_and_tombstones(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    listing = lambda **c: (lambda: spark.createDataFrame([(k, v) for k, v in c.items()], "path string, content string"))

    def broken():
        raise OSError("unreachable")

    out = R.refresh_extensions(store, "main", {"x": listing(a="= A\none", b="= B\ntwo"), "bad": broken, "y": listing(c="= C\nthree")})
    assert out == {"x": True, "bad": "unreachable", "y": True}
    assert R.refresh_extensions(store, "main", {"x": listing(a="= A\none"), "y": listing(c="= C\nthree")}) == {"x": True, "y": False}
    assert {(r.path, r.extension) for r in store.read("raw", "main").collect()} == {("a", "x"), ("c", "y")}
    arrived = spark.createDataFrame([("main", "c", None, "y", 1)], R.RAW)
    assert R.refresh_batch(store, arrived) == ["main"] and [r.path for r in store.read("raw", "main").collect()] == ["a"]
    built = []
    one = store.read_through("manifest", "new", lambda: built.append(1) or spark.createDataFrame([("p", "s")], "path string, sha string"))
    assert one.count() == 1 and store.read_through("manifest", "new", lambda: built.append(1)).count() == 1 and built == [1]


def test_damaged_archives_give_what_can_be_read(spark, tmp_path):
    import io
    import zipfile

    def archive(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, f"text of {n} " * 50)
        return bytearray(out.getvalue())

    good, broken = archive(["a.adoc", "b.adoc", "c.txt"]), archive(["d.adoc", "e.adoc"])
    broken[45:60] = b"\xff" * 15  # inside the first entry's data
    for name, data in (("good", good), ("broken", broken), ("cut", good[:100]), ("empty", b"")):
        (tmp_path / f"{name}.zip").write_bytes(bytes(data))
    got = {r.name for r in A.entries(spark, str(tmp_path), ".adoc").collect()}
    assert {"a.adoc", "b.adoc", "e.adoc"} <= got <= {"a.adoc", "b.adoc", "d.adoc", "e.adoc"}


def test_stream_refresh(spark, tmp_path):
    store, source = IndexStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, R.RAW).coalesce(1).write.mode("append").parquet(source)
    seen: list = []
    go = lambda: R.refresh_stream(spark, source, store, str(tmp_path / "ck"), seen=seen.extend).awaitTermination()
    write([("1", "a.adoc", "= A\none two", "core", 1), ("1", "b.adoc", "= B\nthree", "core", 1)])
    go()
    write([("1", "a.adoc", "= A\nfour", "core", 2), ("1", "a.adoc", "= A\nolder", "core", 1)])
    go()
    chunks = {r.page: r.content for r in store.read("chunks", "1").collect()}
    assert chunks["a"].endswith("four") and chunks["b"].endswith("three") and seen == ["1", "1"]
    assert store.read("postings", "1").where("lexeme = 'four'").count() == 1 and store.versions("chunks") == ["1"]
    status = Status()

    def load(version):
        if version == "bad":
            raise OSError("no such version")
        return spark.createDataFrame([(version, "x.adoc", "= X\ny", "core", 1)], R.RAW)

    R.warm_up(store, load, ["1", "2", "bad"], status)
    assert status.report() == (200, {"ready": True, "total": 3, "completed": 2, "failed": ["bad"]})
    store.append("raw", "2", store.read("raw", "2").drop("version"))
    assert store.read("raw", "2").count() == 2
    store.delete("chunks", "2")
    assert store.read("chunks", "2") is None
    store.drop_all()
    assert store.versions("chunks") == []


def listing(spark, texts):
    return spark.createDataFrame([(f"{k}.adoc", v, "core") for k, v in texts.items()], "path string, content string, extension string")


def _bytes(root):
    return {str(f): f.stat().st_size for f in root.rglob("*.parquet")}


def test_refresh_writes_what_changed_and_compacts(spark, tmp_path):
    """Bytes follow the changed pages; segments stay few; what is read is what a rebuild gives, at every step."""
    store, texts = IndexStore(spark, str(tmp_path / "store")), {f"p{i}": f"= Page {i}\n" + f"word{i} common text number {i * 7} " * 40 for i in range(400)}
    assert R.refresh_version(store, "1", listing(spark, texts))
    whole = sum(_bytes(tmp_path / "store").values())
    written, seen = [], set(_bytes(tmp_path / "store"))
    for step in range(7):
        texts[f"p{step}"] = f"= Page {step}\nchanged once {step} more{step}"
        texts[f"new{step}"] = f"= New\nfresh{step}"
        texts.pop(f"p{300 + step}")
        if step == 5:  # a page that goes and comes back
            texts["p305"] = "= Back\nagain here"
        if step == 7:
            texts.pop("new3")
        assert R.refresh_version(store, "1", listing(spark, texts))
        now = _bytes(tmp_path / "store")
        written.append(sum(v for k, v in now.items() if k not in seen))
        seen |= set(now)
        raw = {r.path: r.content for r in store.read("raw", "1").collect()}
        assert raw == {f"{k}.adoc": v for k, v in texts.items()}
    assert sorted(written)[len(written) // 2] < 0.5 * whole
    fresh = X.chunks(listing(spark, texts).selectExpr("'1' AS version", "*"))
    assert sorted(map(repr, store.read("chunks", "1").select(fresh.columns).collect())) == sorted(map(repr, fresh.collect()))
    key = ["page", "ordinal", "lexeme", "tf", "positions"]
    assert sorted(map(repr, store.read("postings", "1").select(key).collect())) == sorted(map(repr, postings(fresh, ["page", "ordinal"]).select(key).collect()))
    parts = store._snapshot("1")["chunks"]["parts"]
    assert sum(x["kind"] == "rows" for x in parts) <= 9 and sum(x["kind"] == "gone" for x in parts) < 4
    assert not R.refresh_version(store, "1", listing(spark, texts))


def test_a_failed_update_or_merge_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    """Whichever write fails: readers see the tables as they were, and what was half written is gone after the next success."""
    store, texts = IndexStore(spark, str(tmp_path / "store")), {f"p{i}": f"= P\nword{i}" for i in range(12)}
    R.refresh_version(store, "1", listing(spark, texts))
    writer, calls = type(store.read("raw", "1").write), [0]
    plain = writer.parquet

    def parquet(self, path, *args, **options):
        calls[0] -= 1
        if calls[0] == 0:
            raise RuntimeError("lost")
        return plain(self, path, *args, **options)

    monkeypatch.setattr(writer, "parquet", parquet)
    contents = lambda: {r.path.removesuffix(".adoc"): r.content for r in store.read("raw", "1").collect()}
    failures = 0
    for step, fail_at in enumerate((2, 6, 9, 13, 16)):
        old, texts = texts, {**texts, f"p{step}": f"= P\nchanged{step}"}
        calls[0] = fail_at
        try:
            R.refresh_version(store, "1", listing(spark, texts))
        except RuntimeError:
            failures += 1
        calls[0] = 0
        # an update that failed changed nothing; one whose merge failed is whole already
        now = contents()
        assert now in (old, texts)
        assert {r.page: r.content for r in store.read("chunks", "1").collect()} == {k: v.split("\n")[1] for k, v in now.items()}
        assert {(r.page, r.lexeme) for r in store.read("postings", "1").collect()} == {(r.chunk, r.lexeme) for r in postings(spark.createDataFrame([(k, v.split("\n")[1]) for k, v in now.items()], "chunk string, content string"), ["chunk"]).collect()}
        R.refresh_version(store, "1", listing(spark, texts))
        assert contents() == texts
    assert failures >= 3
    assert not any(p.name.startswith("_unsorted") for p in (tmp_path / "store" / "1").iterdir())


def test_a_batch_reads_no_whole_version(spark, tmp_path):
    """Arrived rows meet the manifest's rows of their paths; removals, repeats and unchanged rows included."""
    store, rows = IndexStore(spark, str(tmp_path / "store")), "version string, path string, content string, extension string, seq long"
    put = lambda *r: R.refresh_batch(store, spark.createDataFrame(list(r), rows))
    assert put(("1", "a.adoc", "= A\none", "x", 1), ("1", "b.adoc", "= B\ntwo", "x", 1), ("2", "c.adoc", "= C\nthree", "y", 1)) == ["1", "2"]
    assert put(("1", "a.adoc", "= A\none", "x", 2)) == [] and put(("1", "z.adoc", None, "x", 2)) == []
    assert put(("1", "a.adoc", "= A\nfour", "x", 4), ("1", "a.adoc", "= A\nold", "x", 3), ("1", "b.adoc", None, "x", 5)) == ["1"]
    assert {(r.path, r.content) for r in store.read("raw", "1").collect()} == {("a.adoc", "= A\nfour")}
    assert {r.lexeme for r in store.read("postings", "1").collect()} == {"four"} and {r.page for r in store.read("chunks", "1").collect()} == {"a"}
    assert store.read("raw", "2").count() == 1
