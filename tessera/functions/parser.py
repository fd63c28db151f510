"""A typed token parser for English full-text search, and the analyzer that uses it.

Tags and character references are blanked. What is left is cut into segments: the longest runs of letters, marks and digits
of any script and of the characters ``. - + @ / : _ ~ % ? = #`` that join them. A segment is one thing, if it is one as a
whole, in this order: an e-mail address, a URL (which gives its host and its path as well), a host, a file path, a number.
Any other segment falls into words at all joining characters but dashes; dashes make compounds, which give the whole and each
part, and put a sign on a number after them. Every token takes a position. Words, compounds and parts without digits are
stemmed (Porter2), and stop words among them go but keep their positions; everything else is kept as it is, in lower case.

Segments are found in whole Arrow batches by a table over code points; only distinct segments are looked at one by one. A
chunk's postings come from its own row: nothing is shuffled, and no occurrence meets a vocabulary.

Null texts are empty and have no tokens; positions beyond the last one share it, and only so many are kept of a lexeme.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import spread, workers_find_package
from .porter2 import STOP, porter2

#: As in common full-text vectors, later places have the last position, and positions beyond so many are left out.
LAST_POSITION, MOST_POSITIONS = 16383, 256
TAG, REFERENCE = r"<[A-Za-z/!?][^<>]*>", r"&(?:[A-Za-z]+|#[0-9]+|#[xX][0-9A-Fa-f]+);"
JOINERS = ".-+@/:_~%?=#"
BEFORE, AFTER = ".@:?=#%_", ".-+@:_~%?=#"
PROTOCOL = r"[a-z][a-z0-9+]*://"
LABEL = r"[a-z0-9]+(?:-+[a-z0-9]+)*"
EMAIL = rf"[a-z0-9][a-z0-9._+%-]*@{LABEL}(?:\.{LABEL})+"
HOST = rf"{LABEL}(?:\.{LABEL})*\.[a-z][a-z0-9]*"
URL, LOCAL_URL = rf"{HOST}(?::[0-9]+)?/.*", rf"{LABEL}(?:\.{LABEL})*(?::[0-9]+)?(?:/.*)?"
FILE = r"[a-z0-9._~-]*(?:/[a-z0-9._~-]+)+/?"
#: In the order in which a whole segment is tried.
NUMBERS = {"sfloat": r"[-+]?[0-9]+(?:\.[0-9]+)?e[-+]?[0-9]+", "version": r"[0-9]+(?:\.[0-9]+){2,}", "float": r"[-+]?[0-9]+\.[0-9]+", "int": r"[-+]?[0-9]+"}
_BLANK = re.compile(f"{TAG}|{REFERENCE}")
_FULL = {k: re.compile(v, re.DOTALL).fullmatch for k, v in ({"email": EMAIL, "url": URL, "local": LOCAL_URL, "host": HOST, "file": FILE} | NUMBERS).items()}
_PROTOCOL, _DIGITS = re.compile(PROTOCOL).match, re.compile("[0-9]+").fullmatch
STOPS = frozenset(STOP)
#: Characters of texts that are worked on together; a longer text is alone.
CHUNK = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    """By code point: 0 outside of segments, 1 a letter, mark or digit, 2 a joining character."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LMN"]] = 1
    table[[ord(c) for c in JOINERS]] = 2
    return table


def _words(segment: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    table = _classes()
    pieces = "".join(c if c == "-" or table[ord(c)] == 1 else " " for c in segment).split(" ")
    for piece in pieces:
        run: list[str] = []
        parts = [p for p in piece.split("-") if p]
        for i, p in enumerate([*parts, ""]):
            if p and not _DIGITS(p):
                run.append(p)
                continue
            if len(run) > 1:
                out += [("compound", "-".join(run)), *(("part", x) for x in run)]
            elif run:
                out.append(("word", run[0]))
            run = []
            if p:
                out.append(("int", f"-{p}" if i or piece.startswith("-") else p))
    return out


@functools.lru_cache(maxsize=1 << 17)
def segment_tokens(segment: str) -> tuple[tuple[str, str], ...]:
    """(kind, token) of one segment."""
    s = segment.lower().lstrip(BEFORE)
    protocol = _PROTOCOL(s)
    s = s[protocol.end() if protocol else 0 :].rstrip(AFTER)
    if not s:
        return ()
    if _FULL["email"](s):
        return (("email", s),)
    if _FULL["local" if protocol else "url"](s):
        host, slash, path = s.partition("/")
        return (("url", s), ("host", host), ("url_path", slash + path)) if slash else (("host", host),)
    for kind in ("host", "file", *NUMBERS):
        if _FULL[kind](s):
            return ((kind, s),)
    return tuple(_words(s))


@functools.lru_cache(maxsize=1 << 17)
def lexeme(kind: str, token: str) -> str | None:
    """None for a stop word."""
    if kind not in ("word", "compound", "part") or any(unicodedata.category(c)[0] == "N" for c in token):
        return token
    return None if token in STOPS else porter2(token)


def text_tokens(text: str | None) -> list[tuple[str, str]]:
    """All tokens of one text, in order."""
    table = _classes()
    blanked = _BLANK.sub(" ", text or "")
    segments = "".join(c if table[ord(c)] else " " for c in blanked).split(" ")
    return [t for s in segments if s for t in segment_tokens(s)]


def query_lexemes(text: str) -> list[str]:
    """The distinct lexemes of a query, without stop words."""
    return list(dict.fromkeys(x for t in text_tokens(text) if (x := lexeme(*t)) is not None))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    a, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield a, held
            a, held, size = i + 1, [], 0
    if held:
        yield a, held


class Tokens:
    """The tokens of a chunk of texts: doc, pos (from 1) and code of each, and the distinct (kind, token) by code."""

    def __init__(self, texts: list[str]):
        texts = [_BLANK.sub(" ", t) if "<" in t or "&" in t else t for t in texts]
        joined = "\n".join(texts)
        c = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")] > 0
        edge = np.diff(np.concatenate(([0], c.view(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        seg_doc = np.searchsorted(begins, start, "right") - 1
        coded = pa.array([joined[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.string()).dictionary_encode()
        found = [segment_tokens(s) for s in coded.dictionary.to_pylist()]
        names: dict[tuple[str, str], int] = {}
        flat = np.array([names.setdefault(t, len(names)) for some in found for t in some], dtype=np.int64)
        count = np.array([len(some) for some in found], dtype=np.int64)
        base = np.cumsum(count) - count
        seg = coded.indices.to_numpy().astype(np.int64)
        n = count[seg] if len(seg) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        self.kinds = list(names)
        self.doc = np.repeat(seg_doc, n)
        self.code = flat[np.arange(total) + np.repeat(base[seg] - (ends - n), n)] if total else np.zeros(0, dtype=np.int64)
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.pos = np.arange(total) - first[self.doc] + 1


def _mapped(df: DataFrame, keys: list[str], content: str, run: Callable[[list[str]], tuple[np.ndarray, list[pa.Array]]], fields: str) -> DataFrame:
    """keys and fields: run gives, for a list of texts, the place of the text that each of its rows is of, and the fields."""
    workers_find_package(df.sparkSession)
    src = df.select(*keys, F.col(content).cast("string").alias("content"))
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string(fields).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _chunks(batch.column(len(keys)).to_pylist()):
                doc, columns = run(texts)
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *columns], schema.names)

    return spread(src).mapInArrow(each, schema)


def typed_tokens(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, pos, kind, token: every token of every text."""

    def run(texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        t = Tokens(texts)
        kinds, tokens = (pa.array([x[i] for x in t.kinds], pa.string()) for i in (0, 1))
        at = pa.array(t.code)
        return t.doc, [pa.array(t.pos, pa.int32()), kinds.take(at), tokens.take(at)]

    return _mapped(df, keys, content, run, "pos int, kind string, token string")


#: Of texts: the distinct lexemes, and for each occurrence its text's place, its lexeme's place and its position.
Lexemes = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]


def english(texts: list[str]) -> Lexemes:
    """Stop words go but take a place."""
    t, names = Tokens(texts), {}
    by_code = np.array([-1 if (x := lexeme(*k)) is None else names.setdefault(x, len(names)) for k in t.kinds], dtype=np.int64)
    lex = by_code[t.code] if len(by_code) else np.zeros(0, dtype=np.int64)
    kept = lex >= 0
    return list(names), t.doc[kept], lex[kept], t.pos[kept]


def lexemes(df: DataFrame, keys: list[str], content: str = "content", analyze: Callable[[list[str]], Lexemes] = english) -> DataFrame:
    """keys, lexeme, pos: every occurrence."""

    def run(texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        names, doc, lex, pos = analyze(texts)
        return doc, [pa.array(names, pa.string()).take(pa.array(lex)), pa.array(pos, pa.int32())]

    return _mapped(df, keys, content, run, "lexeme string, pos int")


def _groups(names: list[str], doc: np.ndarray, lex: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order by text and lexeme in which positions stay ascending, which rows begin a group, where)."""
    order = np.argsort(doc * (len(names) + 1) + lex, kind="stable")
    d, x = doc[order], lex[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))[: len(d)]
    return order, new, np.flatnonzero(new)


def term_counts(df: DataFrame, keys: list[str], content: str = "content", analyze: Callable[[list[str]], Lexemes] = english) -> DataFrame:
    """keys, lexeme, tf: all occurrences counted."""

    def run(texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        names, doc, lex, _ = analyze(texts)
        order, _, first = _groups(names, doc, lex)
        size = np.diff(np.append(first, len(doc)))
        return doc[order][first], [pa.array(names, pa.string()).take(pa.array(lex[order][first])), pa.array(size, pa.int64())]

    return _mapped(df, keys, content, run, "lexeme string, tf long")


def postings(df: DataFrame, keys: list[str], content: str = "content", only: list[str] | None = None, analyze: Callable[[list[str]], Lexemes] = english) -> DataFrame:
    """keys, lexeme, tf, positions (ascending, bounded): a row of df makes its own postings. only: of these lexemes."""
    wanted = None if only is None else frozenset(only)

    def run(texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        names, doc, lex, pos = analyze(texts)
        if wanted is not None:
            kept = np.array([x in wanted for x in names] + [False])[lex]
            doc, lex, pos = doc[kept], lex[kept], pos[kept]
        order, new, first = _groups(names, doc, lex)
        doc, lex, pos = doc[order], lex[order], np.minimum(pos[order], LAST_POSITION)
        again = np.concatenate(([False], ~new[1:] & (pos[1:] == pos[:-1])))[: len(doc)]
        place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        some = ~again & (place < MOST_POSITIONS)
        counts = np.add.reduceat(some.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(pos[some], pa.int32()))
        return doc[first], [pa.array(names, pa.string()).take(pa.array(lex[first])), pa.array(counts, pa.int32()), lists]

    return _mapped(df, keys, content, run, "lexeme string, tf int, positions array<int>")


def tokens_sql(content: str) -> str:
    """DuckDB's list of 'kind:token' of a text."""
    word = r"\p{L}\p{M}\p{N}"
    segments = f"regexp_extract_all(regexp_replace(coalesce({content}, ''), '{TAG}|{REFERENCE}', ' ', 'g'), '[{word}.+@/:_~%?=#-]+')"
    full = "regexp_full_match(r, '{}')".format
    numbers = " ".join(f"WHEN {full(v)} THEN ['{k}:' || r]" for k, v in NUMBERS.items())
    signed = "list_transform(parts, lambda p, i: CASE WHEN regexp_full_match(p, '[0-9]+') THEN chr(1) || CASE WHEN i > 1 OR starts_with(piece, '-') THEN '-' ELSE '' END || p || chr(1) ELSE p END)"
    signed = signed.replace("parts", "list_filter(string_split(piece, '-'), lambda e: e <> '')")
    runs = f"list_filter(string_split(regexp_replace(array_to_string({signed}, '-'), '-?\\x01([^\\x01]+)\\x01-?', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda e: e <> '')"
    of_run = "CASE WHEN regexp_full_match(z, '-?[0-9]+') THEN ['int:' || z] WHEN contains(z, '-') THEN list_concat(['compound:' || z], list_transform(string_split(z, '-'), lambda e: 'part:' || e)) ELSE ['word:' || z] END"
    words = f"flatten(list_transform(regexp_split_to_array(r, '[^{word}-]+'), lambda piece: flatten(list_transform({runs}, lambda z: {of_run}))))"
    host = "regexp_extract(r, '^[^/]*')"
    url = f"CASE WHEN contains(r, '/') THEN ['url:' || r, 'host:' || {host}, 'url_path:' || substr(r, length({host}) + 1)] ELSE ['host:' || r] END"
    start = f"regexp_replace(lower(s), '^[{BEFORE}]+', '')"
    after = AFTER.replace("-", "") + "-"
    of_segment = f"""CASE WHEN r = '' THEN [] WHEN {full(EMAIL)} THEN ['email:' || r] WHEN regexp_full_match(r, CASE WHEN p THEN '{LOCAL_URL}' ELSE '{URL}' END) THEN {url}
      WHEN {full(HOST)} THEN ['host:' || r] WHEN {full(FILE)} THEN ['file:' || r] {numbers} ELSE {words} END"""
    # a struct carries what is known of a segment into the next lambda
    stripped = f"list_transform({segments}, lambda s: {{'p': regexp_matches({start}, '^{PROTOCOL}'), 'r': regexp_replace(regexp_replace({start}, '^{PROTOCOL}', ''), '[{after}]+$', '')}})"
    return f"flatten(list_transform({stripped}, lambda x: {of_segment.replace('CASE WHEN p THEN', 'CASE WHEN x.p THEN').replace('(r,', '(x.r,').replace(' r ', ' x.r ').replace('|| r,', '|| x.r,').replace('|| r]', '|| x.r]')}))"
