"""Cutting texts into segments and looking them up, vectorised over the bytes of many texts.

A segment is found by a 64-bit hash of its bytes, and its bytes are compared with those that the table keeps for that
hash, so that its ids are its own whatever the hashes are. Only segments that the table lacks are made into strings and
encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import U, runs, span_hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x0A]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
MOST_BYTES = 1 << 21


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] places, then start[1], ..."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than spaces and line ends: (where the white space before each starts, start, stop)."""
    start, stop = runs(~_SPACE[data], offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    before = offsets[doc].copy()
    if len(start) > 1:
        before[1:] = np.maximum(before[1:], stop[:-1])
    return before, start, stop


def trailing(data_end: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The white space at each text's end, where there is some: (start, stop)."""
    at = np.searchsorted(stop, data_end, "right") - 1
    last = np.where(at >= 0, stop[np.maximum(at, 0)] if len(stop) else 0, 0)
    first = np.maximum(last, offsets[:-1])
    some = first < data_end
    return first[some], data_end[some]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a Latin-1 letter."""
    out = _ASCII_LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, dtype=np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, dtype=np.int64)
    capital = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
    out[capital] += 0x20
    return out


def flagged(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a marked byte."""
    total = np.concatenate(([0], np.cumsum(mark)))
    return total[offsets[1:]] > total[offsets[:-1]]


def odd_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes of white space other than space and line end, and whatever is rare enough to be taken for it."""
    return (data == 0x09) | ((data >= 0x0B) & (data <= 0x0D)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))


def split_words(data: np.ndarray, before: np.ndarray, start: np.ndarray, stop: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Segments of words: a run of letters, with the one space before it if spaces are kept, and the stops and commas
    after it are segments of their own; a word of other kinds is one segment with all white space before it."""
    stops = (data == 0x2E) | (data == 0x2C)
    last = np.maximum.accumulate(np.where(stops, -1, np.arange(len(data))))
    core = np.maximum(last[stop - 1] + 1, start)
    other = np.concatenate(([0], np.cumsum(~latin_letters(data))))
    letters = (core > start) & (other[core] == other[start])
    a, b = np.zeros((len(start), 3), dtype=np.int64), np.zeros((len(start), 3), dtype=np.int64)
    if keep_space:
        gap = start - before
        line_end = (gap == 1) & (data[np.minimum(before, len(data) - 1)] == 0x0A)
        letters &= gap <= 1
        alone = letters & line_end
        a[alone, 0], b[alone, 0] = before[alone], start[alone]
        a[:, 1] = np.where(alone, start, before)
    else:
        a[:, 1] = start
    b[:, 1] = np.where(letters, core, stop)
    a[letters, 2], b[letters, 2] = core[letters], stop[letters]
    some = (b > a).ravel()
    return a.ravel()[some], b.ravel()[some]


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype: str):
        self.data, self.used = np.zeros(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(need - self.used, len(self.data) // 2), dtype=self.data.dtype)])
        self.data[self.used : need] = values
        self.used = need


class _Entries:
    """Segments with their bytes and ids; a segment's place is found by its hash."""

    def __init__(self) -> None:
        self.keys, self.entry = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32)
        self.head, self.tail, self.n_bytes = _Column("u8"), _Column("u8"), _Column("i4")
        #: the bytes of segments that the two don't hold
        self.at_byte, self.raw = _Column("i4"), _Column("u1")
        self.n_ids, self.at_id, self.ids = _Column("i4"), _Column("i4"), _Column("u4")

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.entry[at], -1)

    def add_ids(self, parts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where each of the parts starts."""
        first = self.ids.used + np.cumsum(length) - length
        self.ids.add(parts)
        return first

    def add(self, keys: np.ndarray, head: np.ndarray, tail: np.ndarray, raw: np.ndarray, n_bytes: np.ndarray, parts: np.ndarray, length: np.ndarray) -> None:
        """keys ascending; raw and parts: the bytes of those that are long, and all ids, one after another."""
        place, new = np.searchsorted(self.keys, keys), np.arange(len(keys)) + self.head.used
        self.keys, self.entry = np.insert(self.keys, place, keys), np.insert(self.entry, place, new)
        held = np.where(n_bytes > SHORT, n_bytes, 0)
        self.at_byte.add(self.raw.used + np.cumsum(held) - held)
        for column, values in ((self.head, head), (self.tail, tail), (self.n_bytes, n_bytes), (self.raw, raw), (self.at_id, self.add_ids(parts, length)), (self.n_ids, length)):
            column.add(values)

    @property
    def full(self) -> bool:
        return self.ids.used > MOST_HELD or self.raw.used > MOST_HELD


#: What an entry's first two numbers hold of its bytes.
SHORT = 16
#: Ids, or bytes, of a table at most: places are 32-bit.
MOST_HELD = 1 << 26


class SegmentTable:
    """Ids by segment: found by a 64-bit hash, and told apart by their bytes, which the table keeps. Segments that share a
    hash with another one are encoded where they occur. Beyond most entries a new table is begun, beside the last one."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 700_000):
        self.encode, self.most = encode, most
        self.now, self.older = _Entries(), None

    def same(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, head: np.ndarray, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each range of bytes is the segment of the entry."""
        now, n = self.now, stop - start
        out = (now.n_bytes.data[at] == n) & (now.head.data[at] == head) & (now.tail.data[at] == tail)
        long = np.flatnonzero(out & (n > SHORT))
        if len(long):
            m = n[long]
            equal = now.raw.data[spread(now.at_byte.data[at[long]], m)] == data[spread(start[long], m)]
            out[long] = np.logical_and.reduceat(equal, np.cumsum(m) - m)
        return out

    def hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return span_hashes(data, start, stop)

    def ids_of(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, text_of: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, the number of ids of each range of bytes). text_of: strings of places in start."""
        if len(self.now.keys) > self.most or self.now.full:
            self.now, self.older = _Entries(), self.now
        keys, head, tail = self.hashes(data, start, stop)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        now, old = self.now, self.older
        missing = np.flatnonzero(now.find(unique) < 0)
        if len(missing) and old is not None:
            at = old.find(unique[missing])
            some, at = at >= 0, at[at >= 0]
            if len(at):
                n, m = old.n_bytes.data[at], old.n_ids.data[at]
                long = n > SHORT
                now.add(unique[missing[some]], old.head.data[at], old.tail.data[at], old.raw.data[spread(old.at_byte.data[at[long]], n[long])], n, old.ids.data[spread(old.at_id.data[at], m)], m)
                missing = missing[~some]
        if len(missing):
            at = first[missing]
            made = self.encode(text_of(at))
            n = stop[at] - start[at]
            long = n > SHORT
            now.add(unique[missing], head[at], tail[at], data[spread(start[at[long]], n[long])], n, np.frombuffer(b"".join(made), dtype="<u4"), np.array([len(d) // 4 for d in made], dtype=np.int64))
        at = now.find(unique)[inverse]
        length, place = now.n_ids.data[at], now.at_id.data[at]
        odd = np.flatnonzero(~self.same(data, start, stop, head, tail, at))
        if len(odd):
            made = self.encode(text_of(odd))
            length[odd] = [len(d) // 4 for d in made]
            place[odd] = now.add_ids(np.frombuffer(b"".join(made), dtype="<u4"), length[odd])
        return now.ids.data[spread(place, length)], length
