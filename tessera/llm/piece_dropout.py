"""Encoding with a SentencePiece BPE model under seeded merge dropout, and lossless decoding.

A text is cut at the places that no piece crosses: before a run of spaces and around characters that no piece holds. A
segment's merges are made as the library makes them - the agenda holds all adjacent symbols whose join is a piece, and
gives the join of the best score, leftmost first - but a candidate is skipped, for good, with probability ``dropout``: by
a keyed hash of seed, text, occurrence, and where the candidate's parts start, meet and end. Each occurrence of a segment
so draws its own skips, equal words differ along a text and between texts, and the whole is reproducible.

A segment's way without skips is kept in a table: its ids, and the candidates that are merged. An occurrence that skips
none of these has these ids (a skip of a candidate that wouldn't be merged changes nothing); only the others go through
an agenda of their own, many at once as rows of a matrix, or, where they are long, by a heap each.

Edge cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces; the sign that
stands for a space (U+2581), where a text holds it, is written as byte pieces and so decodes to itself; repeated rows
are encoded alike; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, load, thrifty
from .segments import MOST_BYTES, SegmentTable, spread
from .shingles import U, byte_chunks, mixed
from .tokens import chunks, vocabulary_path

SPACE = "▁"
#: A surrogate, which no text holds, stands for the space sign of a text until it is written as bytes.
HELD = "\ud800"
SPACE_HELD = {ord(HELD): ord(SPACE)}
DROPOUT, SEED = 0.1, 13
#: Longer segments have a heap for their agenda.
LONG = 256
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_ALL = (1 << 64) - 1


def candidate(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the candidate whose parts start, meet and end at these characters of a segment."""
    return start.astype(U) * U(_PLACES[0]) + middle.astype(U) * U(_PLACES[1]) + end.astype(U) * U(_PLACES[2])


def skipped(key: np.ndarray, candidates: np.ndarray, dropout: float) -> np.ndarray:
    return mixed(key + candidates) < U(int(dropout * (1 << 64)))


def _mixed_one(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


class PieceModel:
    """The pieces of a SentencePiece BPE model and the joins that make each."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        ordinary: dict[str, int] = {}
        #: what each id decodes to
        self.bytes: list[bytes] = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                ordinary[piece] = i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.char = {p: i for p, i in ordinary.items() if len(p) == 1}
        #: the symbol of each code point of the lower planes: a piece, or size + code point
        self.symbol = np.arange(0x3000, dtype=np.int64) + n
        for c, i in self.char.items():
            if ord(c) < len(self.symbol):
                self.symbol[ord(c)] = i
        # rank: by score, which falls with the id; a symbol that no piece holds is n + its code point
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.empty(n, dtype=np.int64)
        self.of_rank = np.argsort(-score, kind="stable")
        self.rank[self.of_rank] = np.arange(n)
        pairs = sorted((ordinary[p[:c]] * n + ordinary[p[c:]], i) for p, i in ordinary.items() for c in range(1, len(p)) if p[:c] in ordinary and p[c:] in ordinary)
        self.pair = np.array([k for k, _ in pairs], dtype=np.int64)
        self.join = np.array([i for _, i in pairs], dtype=np.int64)
        self.size = n
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        slots = 1 << 20
        self.slot = np.full(slots, -1, dtype=np.int32)
        self.slot_of = lambda k: ((k.astype(U) * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)
        self.slot[self.slot_of(self.pair)] = 1  # may hold a pair: most don't, and need no search
        inner = {c for p in ordinary for c in p}
        cross = any(SPACE in p.strip(SPACE) or (p.endswith(SPACE) and p.strip(SPACE)) for p in ordinary)
        if cross:
            raise ValueError("the model's pieces cross spaces")
        #: of bytes: 1 spaces, 2 characters that no piece holds (they break segments), 0 all others
        self.kind = np.zeros(256, dtype=np.int8)
        self.kind[0x20] = 1
        self.kind[[ord(c) for c in "\n\t" if c not in inner]] = 2

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols make, or size."""
        out = np.full(left.size, self.size, dtype=np.int32)
        x, y = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        both = (x >= 0) & (y >= 0) & (x < self.size) & (y < self.size)
        key = np.where(both, x * self.size + y, 0)
        some = np.flatnonzero((self.slot[self.slot_of(key)] > 0) & both)
        k = key[some]
        at = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        good = self.pair[at] == k
        out[some[good]] = self.rank[self.join[at[good]]]
        return out.reshape(left.shape)

    @functools.cached_property
    def pair_rank(self) -> dict[int, int]:
        return dict(zip(self.pair.tolist(), self.rank[self.join].tolist(), strict=True))

    def symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not len(code) or code.max() < len(self.symbol):
            return self.symbol[code]
        return np.array([self.char.get(chr(c), self.size + c) for c in code.tolist()], dtype=np.int64)

    def encode_segments(self, segments: list[str], key: np.ndarray, dropout: float, ways: bool = False) -> list[bytes]:
        """Little-endian 32-bit ids of each segment; key: a hash for each, of seed, text and occurrence.

        ways: before the ids, the number of merged candidates, and each one's number in two halves.
        """
        lengths = np.array([len(t) for t in segments])
        width, size = int(lengths.max()), self.size
        s = np.full((len(segments), width), -1, dtype=np.int32)
        s[np.arange(width)[None, :] < lengths[:, None]] = self.symbols("".join(segments))
        final, count = np.full_like(s, -1), lengths.copy()
        place = np.minimum(np.arange(width + 1, dtype=np.int32)[None, :], lengths[:, None].astype(np.int32))
        rank = self.ranks(s[:, :-1], s[:, 1:])
        if dropout and width > 1:
            rank[skipped(key[:, None], candidate(place[:, :-2], place[:, 1:-1], place[:, 2:]), dropout)] = size
        at, merged = np.arange(len(segments)), []
        while rank.shape[1]:
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(at)), best] < size
            if not going.all():
                final[at[~going], : s.shape[1]] = s[~going]
                at, s, place, rank, best, count = at[going], s[going], place[going], rank[going], best[going], count[going]
            if not len(at):
                break
            rows = np.arange(len(at))
            if ways:
                merged.append((at, candidate(place[rows, best], place[rows, best + 1], place[rows, best + 2])))
            s[rows, best] = self.of_rank[rank[rows, best]]
            # what is right of the join moves one place to the left
            width = s.shape[1] - 1
            moved = np.arange(width)[None, :] > best[:, None]
            s = np.where(moved, s[:, 1:], s[:, :-1])
            place = np.where(np.arange(width + 1)[None, :] > best[:, None], place[:, 1:], place[:, :-1])
            rank = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            count -= 1
            width = int(count.max())
            if width < s.shape[1]:
                s, place, rank = s[:, :width], place[:, : width + 1], rank[:, : max(0, width - 1)]
            for side in (-1, 0):
                c = best + side
                ok = np.flatnonzero((c >= 0) & (c < count - 1))
                c = c[ok]
                fresh = self.ranks(s[ok, c], s[ok, c + 1])
                if dropout:
                    fresh[skipped(key[at[ok]], candidate(place[ok, c], place[ok, c + 1], place[ok, c + 2]), dropout)] = size
                rank[ok, c] = fresh
            ended = np.flatnonzero((best == count - 1) & (best < rank.shape[1]))  # nothing is right of the join
            rank[ended, best[ended]] = size
        if len(at):
            final[at, : s.shape[1]] = s
        held = final >= 0
        flat, ends = final[held], np.cumsum(held.sum(axis=1)).tolist()
        if len(flat) and flat.max() >= size:
            out = [self.with_bytes(flat[a:b]).astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        else:
            data = flat.astype("<u4").tobytes()
            out = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if not ways:
            return out
        owner, number = (np.concatenate([m[k] for m in merged]) if merged else np.zeros(0, dtype=U) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        number, n = number[order].view("<u4").tobytes(), np.bincount(owner.astype(np.int64), minlength=len(segments))
        ends = np.cumsum(n).tolist()
        return [np.uint32(k).tobytes() + number[8 * (e - k) : 8 * e] + ids for k, e, ids in zip(n.tolist(), ends, out, strict=True)]

    def encode_long(self, segment: str, key: int, dropout: float, ways: bool = False) -> bytes:
        """The same for one segment, by a heap: time is in proportion to its length, but for a logarithm."""
        s = self.symbols(segment).tolist()
        n, size, most, known = len(s), self.size, int(dropout * (1 << 64)), self.pair_rank
        after, before, agenda, merged = [*range(1, n), n], [-1, *range(n - 1)], [], []

        def number(i: int) -> int:
            middle = after[i]
            return (i * _PLACES[0] + middle * _PLACES[1] + after[middle] * _PLACES[2]) & _ALL

        def offer(i: int) -> None:
            j = after[i]
            if j < n and s[i] < size and s[j] < size and (rank := known.get(s[i] * size + s[j])) is not None and not (most and _mixed_one((key + number(i)) & _ALL) < most):
                heapq.heappush(agenda, (rank, i, s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            rank, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue  # one of its parts is gone
            if ways:
                merged.append(number(i))
            s[i], s[j], after[i] = int(self.of_rank[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        ids = self.with_bytes(np.array([x for x in s if x >= 0], dtype=np.int64)).astype("<u4").tobytes()
        return np.uint32(len(merged)).tobytes() + np.array(merged, dtype="<u8").tobytes() + ids if ways else ids

    def with_bytes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols that are no pieces as byte pieces."""
        if not len(symbols) or symbols.max() < self.size:
            return symbols
        parts = [self.byte_id[list(chr(SPACE_HELD.get(x - self.size, x - self.size)).encode("utf-8", "surrogatepass"))] if x >= self.size else [x] for x in symbols.tolist()]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text: the space that encoding put before it is dropped."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return ""
        data = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[ids] - (ends - length), length)]
        return data.tobytes().decode("utf-8", "surrogatepass")[1:]


class DropoutEncoder:
    """encode_many(texts) -> bytes of little-endian 32-bit ids; a table of bounded size keeps segments' ways without skips."""

    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.dropout, self.seed = PieceModel(model), dropout, seed
        self.table = SegmentTable(lambda segments: self._fresh(segments, np.zeros(len(segments), dtype=U), 0.0, True))

    def _fresh(self, segments: list[str], key: np.ndarray, dropout: float, ways: bool = False) -> list[bytes]:
        """Segments of like width together; long ones one by one."""
        out: list[bytes] = [b""] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        while order and len(segments[order[-1]]) > LONG:
            i = order.pop()
            out[i] = self.model.encode_long(segments[i], int(key[i]), dropout, ways)
        while order:
            few = order[-max(1, min(8192, 400_000 // (len(segments[order[-1]]) + 1))) :]
            order = order[: -len(few)]
            for i, data in zip(few, self.model.encode_segments([segments[i] for i in few], key[few], dropout, ways), strict=True):
                out[i] = data
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for a, b, data, offsets in byte_chunks(pa.array([" " + t if t else "" for t in texts], pa.large_string()), MOST_BYTES):
            kind = self.model.kind[data]
            edge = np.ones(len(data), dtype=bool)  # a segment starts where the kind changes, but not after spaces
            edge[1:] = (kind[1:] != kind[:-1]) & ~((kind[:-1] == 1) & (kind[1:] == 0))
            edge[offsets[:-1][offsets[:-1] < len(data)]] = True
            start = np.flatnonzero(edge)
            stop = np.append(start[1:], len(data)) if len(start) else start
            bound, raw = np.searchsorted(start, offsets), data.tobytes()

            def text_of(at: np.ndarray, raw=raw, start=start, stop=stop) -> list[str]:
                return [raw[x:y].decode().replace(SPACE, HELD).replace(" ", SPACE) for x, y in zip(start[at].tolist(), stop[at].tolist(), strict=True)]

            found, length = self.table.ids_of(data, start, stop, text_of)
            at = np.cumsum(length) - length
            merges = found[at].astype(np.int64) if len(at) else at
            ids_at, n_ids = at + 1 + 2 * merges, length - 1 - 2 * merges
            drawn, other = np.zeros(len(start), dtype=bool), np.zeros(0, dtype="<u4")
            if self.dropout:
                salt = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts[a:b]], dtype=U) * U(0x1_0001) + U(self.seed * 1_000_003)
                place = np.arange(len(start)) - np.repeat(bound[:-1], np.diff(bound))
                key = mixed(mixed(np.repeat(salt, np.diff(bound))) + place.astype(U))
                pair = spread(at + 1, 2 * merges)
                numbers = found[pair].view("<u8") if len(pair) else np.zeros(0, dtype=U)
                owner = np.repeat(np.arange(len(start)), merges)
                drawn[owner[skipped(key[owner], numbers, self.dropout)]] = True
                some = np.flatnonzero(drawn)
                made = self._fresh(text_of(some), key[some], self.dropout)
                other = np.frombuffer(b"".join(made), dtype="<u4")
                n_ids[some] = [len(d) // 4 for d in made]
                ids_at[some] = len(found) + np.cumsum(n_ids[some]) - n_ids[some]
            flat = np.concatenate([found, other])[spread(ids_at, n_ids)].tobytes()
            ends = np.concatenate(([0], np.cumsum(n_ids)))[bound].tolist()
            out += [flat[4 * x : 4 * y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return out


@functools.lru_cache(maxsize=2)
def dropout_encoder(model: str, dropout: float, seed: int) -> DropoutEncoder:
    return DropoutEncoder(model, dropout, seed)


ENCODED = "doc_id long, ids binary"
RESULT = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, lossless boolean"


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many = dropout_encoder(model, dropout, seed).encode_many
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(encode_many(texts[a:b]), pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(thrifty(run), ENCODED)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Encodes and decodes every whole text: counts, the crc32 of its ids, and whether the text came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = dropout_encoder(model, dropout, seed)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                part = [t or "" for t in texts[a:b]]
                data = encoder.encode_many(part)
                back = [encoder.model.decode(np.frombuffer(d, dtype="<u4").astype(np.int64)) for d in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a:b], pa.int64()), pa.array([len(t) for t in part], pa.int64()), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array([x == y for x, y in zip(part, back, strict=True)])],
                    ["doc_id", "n_chars", "n_tokens", "ids_crc32", "lossless"],
                )

    return id_text(docs).mapInArrow(thrifty(run), RESULT)


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
