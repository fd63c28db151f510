"""Zip archives as sources, read and written in pieces by Spark's own text reader and writer.

An archive is cut where an entry's header begins: its signature is the reader's line separator, so that one archive of any
size is many tasks' work, in any store that Spark reads, and a task holds an entry at a time. Entries are found by their own
headers, as in a stream; the directory at the archive's end isn't needed, and entries that it leaves out are there as well.

The signature may also occur inside an entry. An entry that its piece doesn't hold whole takes the pieces after it. Where
that reaches the end of a task's range, the range after it began inside an entry: the archive is then walked anew in the
order of its pieces, as a stream through one task.

Edge cases: what isn't an archive, folders, encrypted entries, entries of unknown methods, of more than 2 GB or with a wrong
checksum give no row, and the pieces that a damaged entry has taken are tried on their own; text that isn't UTF-8 is
read with replacement signs; names that occur twice are rows of their own; an empty archive gives no rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import workers_find_package

SIGNATURE = "PK\x03\x04"
HEAD, CENTRAL, END = "<5H3L2H", "<4s4B4HL2L5H2L", "<4s4H2LH"  # the entry's header is without its signature
MOST, BATCH = (1 << 31) - (1 << 20), 1 << 20

#: What the reader raises for broken, encrypted and unknown forms of entries.
DAMAGED = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError, struct.error)


class Cut(Exception):
    """An entry goes on after the bytes at hand: it needs so many at least."""


def _central(name: bytes, flags: int, method: int, crc: int, packed: int, size: int, offset: int) -> bytes:
    return struct.pack(CENTRAL, b"PK\x01\x02", 20, 3, 20, 0, flags, method, 0, 33, crc, packed, size, len(name), 0, 0, 0, 0, 0, offset) + name


def _end(n: int, width: int, offset: int) -> bytes:
    large = b""
    if n >= 0xFFFF:
        large = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, width, offset) + struct.pack("<4sLQL", b"PK\x06\x07", 0, offset + width, 1)
    return large + struct.pack(END, b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), width, offset, 4)


def _unpacked(method: int, flags: int, crc: int, data: bytes, size: int) -> bytes:
    """The bytes of an entry, checked, by way of an archive of this entry alone."""
    flags &= ~0x808
    head = SIGNATURE.encode() + struct.pack(HEAD, 20, flags, method, 0, 33, crc, len(data), size, 1, 0) + b"x"
    central = _central(b"x", flags, method, crc, len(data), size, 0)
    with zipfile.ZipFile(io.BytesIO(head + data + central + _end(1, len(central), len(head) + len(data)) + SIGNATURE.encode())) as z:
        return z.read("x")


def _described(piece: bytes, at: int, crc: int, packed: int, size: int) -> int:
    """The end of the numbers after an entry of unknown size, if they say this; else 0."""
    for form, mark in (("<3L", b"PK\x07\x08"), ("<L2Q", b"PK\x07\x08"), ("<3L", b""), ("<L2Q", b"")):
        numbers = mark + struct.pack(form, crc, packed, size)
        if piece[at : at + len(numbers)] == numbers:
            return at + len(numbers)
    return 0


def read_entry(piece: bytes, suffix: str = "", check: bool = False) -> tuple[str, bytes | None, int] | None:
    """(name, contents, where it ends) of the entry whose header, without its signature, begins the piece; contents only
    of files with the suffix, others are unpacked only to check them. None: there is no entry that can be read. Raises Cut if
    it goes on after the piece."""
    if len(piece) < 26:
        raise Cut(26)
    version, flags, method, _, _, crc, packed, size, n, extra = struct.unpack_from(HEAD, piece)
    at = 26 + n + extra
    if version & 0xFF > 63 or method > 20 and method not in (93, 95, 97, 98, 99):
        return None
    if len(piece) < at:
        raise Cut(at)
    name, more = piece[26 : 26 + n].decode("utf-8" if flags & 0x800 else "cp437"), piece[26 + n : at]
    while len(more) >= 4:  # sizes of eight bytes
        kind, width = struct.unpack_from("<2H", more)
        if kind == 1:
            long = [x for (x,) in struct.iter_unpack("<Q", more[4 : 4 + width // 8 * 8])]
            size = long.pop(0) if size == 0xFFFFFFFF and long else size
            packed = long.pop(0) if packed == 0xFFFFFFFF and long else packed
        more = more[4 + width :]
    wanted = bool(name) and not name.endswith("/") and name.endswith(suffix)
    if name.endswith("/") and not packed:
        return name, None, at
    if not flags & 8 or packed and crc:
        if packed > MOST or size > MOST:
            return None
        if len(piece) < at + packed:
            raise Cut(at + packed)
        data = _unpacked(method, flags, crc, piece[at : at + packed], size) if wanted or check else None
        return name, data if wanted else None, at + packed
    if flags & 1 or method not in (0, 8):
        return None
    if method == 8:  # its end is where its last block ends
        stream, crc, size, left, parts = zlib.decompressobj(-15), 0, 0, piece[at:], []
        while not stream.eof:
            some = stream.decompress(left, BATCH)
            left = stream.unconsumed_tail
            crc, size = zlib.crc32(some, crc), size + len(some)
            if size > MOST:
                return None
            if wanted:
                parts.append(some)
            if not some and not left and not stream.eof:
                raise Cut(2 * len(piece))
        stop = len(piece) - len(stream.unused_data)
        if end := _described(piece, stop, crc, stop - at, size):
            return name, b"".join(parts) if wanted else None, end
        if len(piece) - stop < 24:
            raise Cut(stop + 24)
        return None
    stop = piece.find(b"PK\x07\x08", at)
    while stop >= 0:  # stored: it ends where marked numbers say its size and checksum
        if struct.pack("<L", stop - at) == piece[stop + 8 : stop + 12] and (end := _described(piece, stop, zlib.crc32(piece[at:stop]), stop - at, stop - at)):
            return name, piece[at:stop] if wanted else None, end
        stop = piece.find(b"PK\x07\x08", stop + 1)
    raise Cut(2 * len(piece))


class Walk:
    """Entries from pieces in their order. ``held`` are pieces of an entry that needs ``need`` bytes at least."""

    def __init__(self, suffix: str):
        self.suffix, self.held, self.size, self.need = suffix, [], 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple[str, bytes]]:
        self.held.append(piece)
        self.size += len(piece) + (4 if len(self.held) > 1 else 0)
        if self.size >= self.need:
            yield from self.read()

    def read(self, last: bool = False) -> Iterator[tuple[str, bytes]]:
        """The entries that are whole among the pieces held. last: no piece follows, so that a cut entry is damaged."""
        while self.held:
            # no piece is joined twice before what is held has doubled, or is as long as the first entry's header says
            whole, found = SIGNATURE.encode().join(self.held), None
            try:
                found = read_entry(whole, self.suffix, len(self.held) > 1)
            except Cut as cut:
                if not last and cut.args[0] <= 2 * MOST:
                    self.need = cut.args[0]
                    return
            except DAMAGED:
                pass
            if found and found[1] is not None:
                yield found[:2]
            used, at = 1, len(self.held[0])
            while found and used < len(self.held) and at + 4 <= found[2]:
                at += len(self.held[used]) + 4
                used += 1
            self.held, self.need = self.held[used:], 0
            self.size = sum(map(len, self.held)) + 4 * max(0, len(self.held) - 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """archive, block (where the range of the file begins), piece."""
    lines = spark.read.option("lineSep", SIGNATURE).text(path)
    return lines.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _walked(suffix: str, ranges: bool, cut: bool = False):
    """Pieces to entries. ranges: each range of a file is walked on its own; cut: not its entries, but the archive of each that
    ends inside an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk, rows, size = None, Walk(suffix), [], 0

        def closed() -> Iterator[tuple]:
            if cut:
                for _ in walk.read():
                    pass
                if walk.held:
                    yield (at[0],)
            else:
                yield from ((at[0], *x) for x in walk.read(last=True))

        def found() -> Iterator[tuple]:
            nonlocal at, walk
            for batch in batches:
                for archive, block, piece in zip(*batch.columns, strict=True):
                    here = (archive.as_py(), block.as_py() if ranges else None)
                    if here != at:
                        if at:
                            yield from closed()
                        at, walk = here, Walk(suffix)
                        if block.as_py() == 0:
                            continue  # what comes before the first signature
                    for x in walk.feed(piece.as_py()):
                        if not cut:
                            yield (at[0], *x)
            if at:
                yield from closed()

        names = ["archive"] if cut else ["archive", "name", "content"]
        for row in found():
            rows.append(row if cut else (*row[:2], row[2].decode("utf-8", "replace")))
            size += 1 if cut else len(row[2])
            if size >= BATCH or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})

    return run


ENTRIES = "archive string, name string, content string"


def entries(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, name, content of each file in the zips at path; of a damaged archive those that can be read."""
    workers_find_package(spark)
    pieces = _pieces(spark, path)
    each = pieces.mapInArrow(_walked(suffix, True), ENTRIES)
    cut = pieces.mapInArrow(_walked(suffix, True, True), "archive string").distinct()
    if cut.isEmpty():
        return each
    ordered = pieces.withColumn("nth", F.monotonically_increasing_id()).join(cut, "archive", "left_semi").repartition("archive").sortWithinPartitions("archive", "block", "nth")
    return each.join(cut, "archive", "left_anti").unionByName(ordered.select("archive", "block", "piece").mapInArrow(_walked(suffix, False), ENTRIES))


def write_archives(df: DataFrame, path: str) -> None:
    """df's name and content as zips in a new folder, one of each task's rows (under 4 GB): a task holds an entry and the
    names of its archive. Null names are left out, null contents are empty."""
    workers_find_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        central, offset, held = [], 0, b""  # the writer puts a signature after every row: the first row is empty
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                raw, data = name.as_py().encode(), (content.as_py() or "").encode()
                press = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed, crc = press.compress(data) + press.flush(), zlib.crc32(data)
                yield pa.RecordBatch.from_pydict({"piece": [held]})
                held = struct.pack(HEAD, 20, 0x800, 8, 0, 33, crc, len(packed), len(data), len(raw), 0) + raw + packed
                central.append(_central(raw, 0x800, 8, crc, len(packed), len(data), offset))
                offset += 4 + len(held)
                if offset > 0xFFFFFFFF:
                    raise ValueError("the rows of a task are more than an archive of 4 GB holds: more partitions are needed")
        if central:
            listed = b"".join(central)
            # the last signature is the archive's comment
            yield pa.RecordBatch.from_pydict({"piece": [held + listed + _end(len(central), len(listed), offset)]})

    rows = df.where("name is not null").select("name", "content").mapInArrow(run, "piece binary")
    rows.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", SIGNATURE).text(path)


def versioned_docs(entry: DataFrame, versions: list[str], folder: str = "guides", suffix: str = ".adoc") -> DataFrame:
    """version, path, content: one pass over the archive serves all versions; path is what follows the version's folder."""
    marker = F.transform(F.array(*[F.lit(v) for v in versions]), lambda v: F.struct(v.alias("version"), F.concat(F.lit("_versions/"), v, F.lit(f"/{folder}/")).alias("mark")))
    met = entry.where(F.col("name").endswith(suffix)).select("name", "content", F.explode(F.filter(marker, lambda m: F.col("name").contains(m["mark"]))).alias("m"))
    rest = F.substring(F.col("name"), F.position(F.col("m.mark"), F.col("name")) + F.length("m.mark"), F.length("name"))
    return met.select("m.version", rest.alias("path"), "content")


def extension_docs(entry: DataFrame, extension: str, start_path: str = "docs", prefix: str = "extensions", suffix: str = ".adoc") -> DataFrame:
    """path, content of a module's pages: the archive's first folder goes; other modules are skipped."""
    inner = F.regexp_replace("name", "^[^/]*/", "")
    root = f"{start_path.strip('/')}/modules/ROOT/pages/" if start_path.strip("/") else "modules/ROOT/pages/"
    pages = entry.withColumn("inner", inner).where(F.col("inner").startswith(root) & F.col("inner").endswith(suffix))
    rest = F.substring(F.col("inner"), F.lit(len(root) + 1), F.length("inner"))
    return pages.select(F.concat(F.lit(f"{prefix}/{extension}/"), rest).alias("path"), "content")


def component_title(entry: DataFrame, start_path: str = "docs") -> str | None:
    """The title in the component's antora.yml; blank or malformed ones don't count."""
    from .playbook import title_of

    name = f"{start_path.strip('/')}/antora.yml".lstrip("/")
    rows = entry.where(F.regexp_replace("name", "^[^/]*/", "") == name).select("content").limit(1).collect()
    return title_of(rows[0][0]) if rows else None
