"""Archives cut at any place, written by others and by this package, against the standard library's reader."""

import io
import os
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives as A


class Unseekable(io.RawIOBase):
    """Makes the writer put sizes after entries."""

    def __init__(self):
        self.data = bytearray()

    def writable(self):
        return True

    def write(self, b):
        self.data += b
        return len(b)


def archive(files, method=zipfile.ZIP_DEFLATED, streamed=False):
    out = Unseekable() if streamed else io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            z.writestr(name, data)
    return bytes(out.data) if streamed else out.getvalue()


def made(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "über", "PK", "\x03\x04", "PK\x03\x04", "\n", " "]
    return [(f"d{i % 3}/é{i}.adoc", "".join(rng.choices(words, k=rng.choice([0, 1, 30, 400])))) for i in range(40)] + [("folder/", ""), ("x.txt", "other"), ("d0/é0.adoc", "twice")]


def want(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return sorted((i.filename, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if not i.is_dir())


FORMS = [(m, s) for m in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED) for s in (False, True)] + [(zipfile.ZIP_BZIP2, False), (zipfile.ZIP_LZMA, False)]


@pytest.mark.parametrize(("method", "streamed"), FORMS)
def test_walk_finds_what_the_directory_lists(method, streamed):
    """Stored text that holds signatures, and archives in archives, are cut inside entries."""
    inner = archive(made(1), zipfile.ZIP_STORED)
    data = archive([*made(2), ("inner.zip", inner), *[(f"z{i}", t) for i, (_, t) in enumerate(made(3))]], method, streamed)
    walk, got = A.Walk(""), []
    for piece in data.split(A.SIGNATURE.encode())[1:]:
        got += walk.feed(piece)
    got += walk.read(last=True)
    assert sorted((n, c.decode("utf-8", "replace")) for n, c in got) == want(data)


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_ranges_of_any_size(spark, tmp_path, split):
    rng = random.Random(split)
    files = {"a": archive(made(4)), "b": archive([(f"p{i}.adoc", "".join(rng.choices("abcdef ", k=300))) for i in range(60)]), "nested": archive([("in.zip", archive(made(5), zipfile.ZIP_STORED)), ("after.adoc", "after")], zipfile.ZIP_STORED), "streamed": archive(made(6), streamed=True), "none": archive([]), "no": b"no archive", "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        pieces = A._pieces(spark, f"file://{tmp_path}")
        assert split > 1000 or pieces.where("archive like '%b.zip'").select("block").distinct().count() > 5
        got = sorted((os.path.basename(r.archive)[:-4], r.name, r.content) for r in A.entries(spark, f"file://{tmp_path}").collect())
        assert got == sorted((k, *x) for k, d in files.items() if k not in ("no", "empty") for x in want(d))
        some = sorted(r.name for r in A.entries(spark, f"file://{tmp_path}", ".adoc").where("archive like '%a.zip'").collect())
        assert some == sorted(n for n, _ in want(files["a"]) if n.endswith(".adoc"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_damaged_entries_leave_the_others(spark, tmp_path):
    data = bytearray(archive([("one.adoc", "1" * 500), ("two.adoc", os.urandom(300).hex()), ("three.adoc", "3")]))
    second = data.index(A.SIGNATURE.encode(), 4)
    struct.pack_into("<L", data, second + 18, 1 << 20)  # its size reaches over what follows
    locked = bytearray(archive([("locked.adoc", "x" * 50), ("open.adoc", "y")]))
    locked[6] |= 1
    for name, content in (("long", data), ("locked", locked), ("cut", archive(made(7))[:400])):
        (tmp_path / f"{name}.zip").write_bytes(bytes(content))
    got = {(os.path.basename(r.archive), r.name) for r in A.entries(spark, f"file://{tmp_path}", ".adoc").collect()}
    assert {("long.zip", "one.adoc"), ("long.zip", "three.adoc"), ("locked.zip", "open.adoc")} <= got
    assert ("long.zip", "two.adoc") not in got and ("locked.zip", "locked.adoc") not in got


def test_written_archives_are_archives(spark, tmp_path):
    rows = [(f"p{i}.adoc", t) for i, (_, t) in enumerate(made(8))] + [(None, "no name"), ("null.adoc", None), ("same", "a"), ("same", "b")]
    df = spark.createDataFrame(rows, "name string, content string").withColumn("piece", F.lit(1)).repartition(3)
    A.write_archives(df, f"file://{tmp_path}/out")
    listed = sorted((n, c or "") for n, c in rows if n is not None)
    read = []
    for f in os.listdir(tmp_path / "out"):
        if f.startswith("part"):
            with zipfile.ZipFile(tmp_path / "out" / f) as z:
                assert z.testzip() is None
                read += [(i.filename, z.read(i).decode()) for i in z.infolist()]
    assert sorted(read) == listed == sorted((r.name, r.content) for r in A.entries(spark, f"file://{tmp_path}/out").collect())
    A.write_archives(df.where("false"), f"file://{tmp_path}/none")
    assert A.entries(spark, f"file://{tmp_path}/none").count() == 0


def test_many_entries_and_numbers_of_eight_bytes(tmp_path):
    central = b"".join(A._central(b"n", 0, 0, zlib.crc32(b""), 0, 0, 0) for _ in range(70_000))
    entry = A.SIGNATURE.encode() + struct.pack(A.HEAD, 20, 0, 0, 0, 33, 0, 0, 0, 1, 0) + b"n"
    with zipfile.ZipFile(io.BytesIO(entry + central + A._end(70_000, len(central), len(entry)) + A.SIGNATURE.encode())) as z:
        assert len(z.infolist()) == 70_000
    piece = struct.pack(A.HEAD, 45, 0, 0, 0, 33, zlib.crc32(b"abc"), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"n" + struct.pack("<2H2Q", 1, 16, 3, 3) + b"abc"
    assert A.read_entry(piece + b"rest") == ("n", b"abc", len(piece))
