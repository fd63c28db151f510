"""Hashed word shingles of whole texts, vectorised over the bytes of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z become a-z. A word's hash takes its bytes in eights, each folded into a
bijective mixer (words of equal length up to eight bytes never share one); a shingle's hash is a sum of its words'
hashes, each times its place's constant, mixed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SEED = 20240
#: Bytes that are worked on together; a longer text is alone.
CHUNK = 1 << 20
#: Longer spans are hashed by BLAKE2b, one at a time.
LONG_SPAN = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first eight bytes, next eight bytes) of each range of bytes: spans of up to 16 bytes are given whole by their length and the latter two."""
    padded = np.zeros((len(data) + 23) // 8 * 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights, length = padded.view("<u8"), stop - start
    h = mixed(length.astype(U) * U(_P) + U(seed))
    heads = np.zeros((2, len(start)), dtype=U)
    at, left = np.flatnonzero(length), length
    k = 0
    while len(at):
        place, left = start[at] + 8 * k, length[at] - 8 * k
        i, shift = place >> 3, ((place & 7) << 3).astype(U)
        x = (eights[i] >> shift | (eights[i + 1] << U(1)) << (U(63) - shift)) & _MASK[np.minimum(left, 8)]
        if k < 2:
            heads[k, at] = x
        h[at] = mixed(h[at] ^ x)
        at = at[left > 8]
        k += 1
        if k == 2:
            long = at[length[at] > LONG_SPAN]
            for j in long.tolist():
                digest = hashlib.blake2b(data[start[j] : stop[j]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
                h[j] = int.from_bytes(digest, "little")
            at = at[length[at] <= LONG_SPAN]
    return h, heads[0], heads[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True; a border of documents ends a run."""
    n = len(inside)
    padded = np.zeros(n + 2, dtype=np.int8)
    padded[1:-1] = inside
    edge = np.diff(padded)
    first, last = edge[:-1] == 1, edge[1:] == -1
    inner = offsets[(offsets > 0) & (offsets < n)]
    touching = inner[(padded[inner] == 1) & (padded[inner + 1] == 1)]
    first[touching], last[touching - 1] = True, True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def byte_chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, bytes, offsets) for ranges of whole texts of about so many bytes together; a longer text is alone."""
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a chunk's texts, and where each text's words start and the last one's end."""
    start, stop = runs(~_SPACE[data], offsets)
    return span_hashes(_LOWER[data], start, stop, seed)[0], np.searchsorted(start, offsets)


class Shingler:
    """sets(array) gives each text's sorted distinct shingle hashes (null, empty or wordless: none)."""

    def __init__(self, size: int = 5, seed: int = SEED):
        self.size, self.seed = size, seed

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in byte_chunks(texts, CHUNK):
            yield from self._chunk(data, offsets)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words, bound = word_hashes(data, offsets, self.seed)
        size = self.size
        grams = np.zeros(max(0, len(words) - size + 1), dtype=U)
        weight = 1
        for j in range(size):
            grams += words[j : j + len(grams)] * U(weight)
            weight = weight * _Q & ((1 << 64) - 1)
        grams = mixed(grams)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(grams[a : b - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                h, weight = (b - a) * 0x632BE59BD9B4E019, 1
                for w in words[a:b].tolist():
                    h, weight = h + w * weight, weight * _Q
                yield mixed(np.array([h & ((1 << 64) - 1)], dtype=U))
            else:
                yield np.zeros(0, dtype=U)
