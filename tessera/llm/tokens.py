"""Token ids of whole texts, by the tokenizers library, at the speed of a word table.

Both public BPE vocabularies cut a text before any merge is made, and never across the border between a visible
character and white space, or after a whole run of letters. So the ids of a text are the ids of its segments one after
another. Each distinct segment is encoded once by the library, many in one call, and kept in a table of bounded size
that lives as long as its Python worker. Texts with rare white space, and for vocabularies that lower letters those
with characters beyond Latin-1, are given to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from .segments import MOST_BYTES, SegmentTable, flagged, lowered, odd_space, split_words, trailing, words
from .shingles import byte_chunks

#: Segments kept. Packing runs where the pipeline's other stages have left their memory, and so keeps fewer.
MOST_SEGMENTS = {True: 700_000, False: 250_000}
LOWER = r"a-z\xdf-\xf6\xf8-\xff"
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
SIMPLE = {True: re.compile(rf" [{LETTER}]+"), False: re.compile(rf"[{LOWER}]+")}


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)} | {0x20: " "}


BYTES = _byte_letters()


def vocabulary_path(name_or_path: str) -> str:
    """A file name of the public tokenizers, or the path of any tokenizer file."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class SegmentEncoder:
    """encode_many(texts) -> for each text the bytes of little-endian unsigned 32-bit ids, equal to the library's ids.

    byte_level: the vocabulary keeps spaces (else it marks word ends and lowers).
    """

    def __init__(self, vocabulary: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.byte_level, self.simple = byte_level, SIMPLE[byte_level].fullmatch
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.table = SegmentTable(self._encode_segments, MOST_SEGMENTS[byte_level])
        vocab = self.tokenizer.get_vocab()
        #: ids that open a segment (byte level: a space) or close one (a word's end)
        self.mark = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.mark[[i for w, i in vocab.items() if (w.startswith("Ġ") if byte_level else w.endswith("</w>"))]] = True

    def _encode(self, segments: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]

    def _encode_segments(self, segments: list[str]) -> list[bytes]:
        simple = [i for i, s in enumerate(segments) if self.simple(s)]
        chosen = set(simple)
        other = [i for i in range(len(segments)) if i not in chosen]
        out: list[bytes] = [b""] * len(segments)
        for places, encode in ((simple, self._encode_simple), (other, self._encode)):
            for i, data in zip(places, encode([segments[i] for i in places]), strict=True):
                out[i] = data
        return out

    def _encode_simple(self, segments: list[str], together: int = 64) -> list[bytes]:
        """Runs of letters, so many in one text: each is one segment there too, and marked ids tell where it starts or ends.

        Letters in lower case need neither normalizing nor the vocabulary's own splitting: the bare merges suffice.
        """
        parts = [segments[a : a + together] for a in range(0, len(segments), together)]
        if self.byte_level:
            encoded = self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)
        else:
            encoded = self.bare.encode_batch_fast([" ".join(p).encode().decode("latin-1").translate(BYTES) for p in parts], add_special_tokens=False)
        out: list[bytes] = []
        for part, e in zip(parts, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.mark[ids])
            bounds = [*at.tolist(), len(ids)] if self.byte_level else [0, *(at + 1).tolist()]
            if len(bounds) != len(part) + 1:
                out += self._encode(part)
                continue
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for a, b, data, offsets in byte_chunks(pa.array(texts, pa.large_string()), MOST_BYTES if self.byte_level else MOST_BYTES // 4):
            odd = flagged(odd_space(data) if self.byte_level else data >= 0xC4, offsets)
            if not self.byte_level:
                data = lowered(data)
            before, start, stop = words(data, offsets)
            first, last = split_words(data, before, start, stop, self.byte_level) if len(start) else (start, stop)
            if self.byte_level:
                x, y = trailing(offsets[1:], offsets, stop)
                if len(x):
                    first, last = np.concatenate([first, x]), np.concatenate([last, y])
                    order = np.argsort(first, kind="stable")
                    first, last = first[order], last[order]
            if odd.any():
                good = ~odd[np.searchsorted(offsets, first, "right") - 1]
                first, last = first[good], last[good]
            raw = data.tobytes()
            ids, length = self.table.ids_of(data, first, last, lambda at: [raw[first[i] : last[i]].decode() for i in at.tolist()])  # noqa: B023
            ends = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(first, offsets)].tolist()
            flat = ids.tobytes()
            part = [flat[4 * x : 4 * y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            if odd.any():
                places = np.flatnonzero(odd).tolist()
                for i, whole in zip(places, self._encode([texts[a + i] for i in places]), strict=True):
                    part[i] = whole
            out += part
        return out


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, byte_level: bool) -> SegmentEncoder:
    """One for each vocabulary and Python worker: the table serves the worker's later tasks too."""
    return SegmentEncoder(vocabulary, byte_level)


def chunks(texts: list, most_chars: int = 2_000_000):
    """Ranges (a, b) of texts with about so many characters together: bounds the memory of a batch."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= most_chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
