"""Secrets in whole texts: fixed patterns, and credential-context values that would cost many guesses.

The base kinds are assignments to credential names, access-key ids and long runs of hex digits. The method adds
``guess``: a value in a wider credential context (``passphrase is ...``, ``pwd => ...``, ``user:...@host``) whose least
guess cost reaches ``GUESSES``. A dynamic program finds that cost: the cheapest segmentation into words, dates, repeats,
keyboard walks (of 64 keys at most) and brute-force spans, in powers of ten of guesses.

Spans are in code points, ends exclusive; an assignment's span is its whole match. Edge cases: a null or empty text has
no spans (the hash is that of an empty string); repeated rows are scanned once each; null doc_ids are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import workers_find_package
from .common import id_text, load, map_rows, thrifty

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short holds no longer match
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_\x20-]?key|(?:access|private|client)[_\x20-]?(?:key|secret)|credentials?|authorization|bearer|login)"""
    r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|\x20+(?=["']))["']?(?P<value>[^\s"'<>,;]{6,})|://[^\s/:@]+:(?P<url>[^\s/@]{6,})@""",
    re.IGNORECASE | re.ASCII,
)
#: A superset of what any pattern needs, for RE2 over whole Arrow columns.
SUSPECT = r"(?i:passw|passphrase|passcode|pwd|secret|token|api[_ -]?key|[set][_ -]?key|credential|authorization|bearer|login)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|://[^\s/:@]+:"
#: A value is a secret from 10^9 guesses on.
GUESSES = 9.0

# Common words of passwords and placeholders in order of rank (fixed values).
WORDS = (
    "password pass admin user login secret token key test demo example sample default changeme change welcome letmein master root "
    "guest dragon monkey football baseball shadow sunshine princess flower summer winter spring autumn love hello freedom "
    "whatever trust secure private public server database config access system service account client local temp dummy none null "
    "true false your my the this that here name value string insert replace placeholder redacted hidden unknown company office "
    "january february march april june july august september october november december monday tuesday friday sunday"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("@43105$7!8", "aaeiosstib")
ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = {row[i] for i in (c - 1, c + 1) if 0 <= i < len(row)}
            for other, shifts in ((r - 1, (c, c + 1)), (r + 1, (c - 1, c))):
                if 0 <= other < len(ROWS):
                    near |= {ROWS[other][i] for i in shifts if 0 <= i < len(ROWS[other])}
            out[key] = near
    for a, b in zip(ALPHABET[:-1], ALPHABET[1:], strict=True):  # alphabetic sequences are walks as well
        out[a].add(b), out[b].add(a)
    return out


NEAR = _neighbours()
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
LETTERS = re.compile("[A-Za-z]")
VOWELS = frozenset("aeiouyAEIOUY")
MOST_SPOKEN, MOST_WALK, MOST_PERIOD, CLUSTER = 14, 64, 8, 5
#: A stretch of one period that is longer than LONG keeps this many places at either end; what is between is only jumped over.
MARGIN, LONG = 64, 384


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def periods(value: str, most: int = MOST_PERIOD) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """For each width up to most, how many characters from each place on are the same as those a width later; and the long
    stretches of one period, as (start, end)."""
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n, follows, long = len(code), [], []
    for width in range(1, most + 1):
        same = np.zeros(n, dtype=bool)
        same[: max(0, n - width)] = code[: max(0, n - width)] == code[width:]
        stops = np.flatnonzero(~same)  # the last place is always one
        follows.append((stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)).tolist())
        starts = np.concatenate(([0], stops[:-1] + 1))
        big = np.flatnonzero(stops - starts + width > LONG)
        long += [(int(starts[i]), int(stops[i]) + width) for i in big]
    return follows, long


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation of value.

    best[j] = min over i of best[i] + cost of value[i:j]; brute force costs its characters alone, each other kind a
    choice of pattern as well. Words, dates and walks are bounded. Repeats aren't, but a repeat that begins deep in a
    stretch of its period is never cheaper than one from near the stretch's start, and a way through a long stretch
    without one never cheaper than one: so the middle of a long stretch is left out, and time is linear in the length.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # some capitals have small forms of several characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    follows, long = periods(value)
    skip = bytearray(n + 1)
    for start, end in long:
        skip[start + MARGIN : end - MARGIN] = bytes([1]) * (end - start - 2 * MARGIN)
    small, vowel, cluster = [0] * (n + 2), [n] * (n + 1), [n + 1] * (n + 1)  # small letters from here; the next vowel; the end of the next cluster
    quiet = 0
    for i in range(n - 1, -1, -1):
        c = value[i]
        small[i] = small[i + 1] + 1 if "a" <= c <= "z" else 0
        quiet = 0 if c in VOWELS else quiet + 1
        vowel[i] = vowel[i + 1] if quiet else i
        cluster[i] = i + CLUSTER if quiet >= CLUSTER else cluster[i + 1]
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    pick = math.log10(6)
    i = -1
    while i < n - 1:
        i += 1
        if skip[i]:
            i = skip.find(0, i) - 1
            continue
        at, c = best[i], value[i]
        if at + _brute(c) < best[i + 1]:
            best[i + 1] = at + _brute(c)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            word, leet = RANK.get(low[i:j]), RANK.get(plain[i:j])
            if word or leet:
                cost = at + pick + math.log10((word or leet) + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.6 * (not word)
                if cost < best[j]:
                    best[j] = cost
        if small[i + 1] >= 2 and LETTERS.match(c):
            cost = at + pick + 4.0  # some word of a language: a vowel in it, no cluster of consonants
            for j in range(max(i + 3, vowel[i] + 1), min(i + MOST_SPOKEN, i + 1 + small[i + 1], cluster[i] - 1) + 1):
                if cost < best[j]:
                    best[j] = cost
        if date := DATE.match(value, i):
            cost = at + pick + (math.log10(365 * 120) if date.end() - i > 4 else math.log10(120))
            if cost < best[date.end()]:
                best[date.end()] = cost
        for width in range(1, MOST_PERIOD + 1):
            times = follows[width - 1][i] // width + 1
            if times < (3 if width == 1 else 2):
                continue
            unit = at + pick + (math.log10(94) if width == 1 else sum(map(_brute, value[i : i + width])))
            j, k = i, 0
            while k < times:
                k, j = k + 1, j + width
                if skip[j]:  # to the first multiple beyond what is left out
                    more = -(-(skip.find(0, j) - j) // width)
                    k, j = k + more - 1, j + (more - 1) * width
                    continue
                if k >= (3 if width == 1 else 2) and unit + math.log10(k) < best[j]:
                    best[j] = unit + math.log10(k)
        j, turns = i + 1, 0
        while j < n and j < i + MOST_WALK and low[j] in NEAR.get(low[j - 1], ()):
            turns += j - i < 2 or ord(low[j]) - ord(low[j - 1]) != ord(low[j - 1]) - ord(low[j - 2])
            j += 1
            if j - i >= 4:
                cost = at + pick + math.log10(47 * (j - i)) + 0.7 * turns
                if cost < best[j]:
                    best[j] = cost
    return best[n]


_kept = functools.lru_cache(maxsize=4096)(guess_cost)


def _cost(value: str) -> float:
    return _kept(value) if len(value) <= 256 else guess_cost(value)


def find_spans(text: str) -> tuple[list[tuple[int, int, str]], float]:
    """(start, end, kind) in order, base kinds and guess, and the largest guess cost of a credential-context value."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    most = 0.0
    for m in CONTEXT.finditer(text):
        kind = "value" if m["value"] is not None else "url"
        a, b = m.span(kind)
        while b > a and text[b - 1] in ".!?)]}":
            b -= 1
        cost = _cost(text[a:b])
        most = max(most, cost)
        if cost >= GUESSES:
            spans.append((a, b, "guess"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), most


def suspects(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts.fill_null(""), SUSPECT).to_pylist()


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, most_cost double"


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of its base spans, all spans, and the largest guess cost."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for doc, text, maybe in zip(batch.column(0).to_pylist(), batch.column(1), suspects(batch.column(1)), strict=True):
                if not maybe:
                    rows.append((doc, 0, 0, 0, nothing, "", 0, 0.0))
                    continue
                spans, most = find_spans(text.as_py())
                count = {k: sum(s[2] == k for s in spans) for k in KINDS}
                base = listed([s for s in spans if s[2] != "guess"])
                rows.append((doc, count["assign"], count["access"], count["hex"], hashlib.sha256(base.encode()).hexdigest(), listed(spans), count["guess"], most))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], FOUND.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))

    return id_text(docs).mapInArrow(thrifty(run), FOUND)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each union of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, mask: str = "[secret]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret replaced by the mask, all columns kept; length_col follows the text where it exists."""
    workers_find_package(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            maybe = suspects(texts)
            if any(maybe):
                changed = [masked(x.as_py(), find_spans(x.as_py())[0], mask) if m else x.as_py() for x, m in zip(texts, maybe, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(changed, texts.type))
            yield batch

    out = map_rows(docs, run, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(schema[length_col].dataType))
    return out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(load(spark, sf_dir, "documents"))
