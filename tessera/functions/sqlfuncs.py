"""The text functions for SQL users: SQL functions that Catalyst inlines, and table functions for parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import DOUBLING, SUFFIXES


BLANK = "".join(map(chr, range(33)))


def stem_sql(w: str) -> str:
    """The rule stemmer as a SQL CASE over the expression w."""
    arms = []
    for s in SUFFIXES:
        rest = f"left({w}, length({w}) - {len(s)})"
        if s in DOUBLING:
            rest = f"CASE WHEN right({rest}, 1) = substr({rest}, length({rest}) - 1, 1) AND NOT right({rest}, 1) IN ('a', 'e', 'i', 'o', 'u') THEN left({w}, length({w}) - {len(s) + 1}) ELSE {rest} END"
        arms.append(f"WHEN right({w}, {len(s)}) = '{s}' AND length({w}) >= {len(s) + 3} THEN {rest}")
    arms.append(f"WHEN right({w}, 1) = 's' AND right({w}, 2) <> 'ss' AND length({w}) >= 4 THEN left({w}, length({w}) - 1)")
    return f"CASE {' '.join(arms)} ELSE {w} END"


FUNCTIONS = {
    "rule_stem(w STRING) RETURNS STRING": stem_sql("w"),
    "slug(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(t, '')), '[''`]', ''), '[^a-z0-9-]', '-'), '-{2,}', '-'), '^-+|-+$', '')",
    "trgm(t STRING) RETURNS ARRAY<STRING>": "array_distinct(flatten(transform(filter(split(lower(t), '[^a-z0-9]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))",
    "trgm_similarity(a STRING, b STRING) RETURNS DOUBLE": "coalesce(try_divide(size(array_intersect(trgm(a), trgm(b))), size(array_union(trgm(a), trgm(b)))), 0D)",
    "ts_rank_pair(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE": "1D - exp(aggregate(a, 0D, (s, p) -> s + aggregate(b, 0D, (t, q) -> t + IF(p = q, 0D, ln(1D - sqrt(0.01D * IF(abs(p - q) > 100, 1e-30D, 1D / (1.005D + 0.05D * exp(abs(p - q) / 1.5D - 2D)))))))))",
    "ts_rank_one(n INT) RETURNS DOUBLE": "aggregate(sequence(1, n), 0D, (a, j) -> a + 0.1D / (j * j)) / 1.64493406685D",
}


@udtf(returnType="ordinal int, title string, start_line int, end_line int")
class ParseSections:
    """parse_sections(text) as a table function; the DataFrame form is operators.sections.section_rows."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from _sections(text)


@udtf(returnType="ordinal int, start_line int, end_line int, content string")
class ParseCodeBlocks:
    """parse_code_blocks(text) as a table function; the DataFrame form is operators.sections.code_blocks."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").split("\n")
        fences = [i for i, line in enumerate(lines) if re.fullmatch("-{4,}", line.strip(BLANK))]
        for n, (a, b) in enumerate(zip(fences[::2], fences[1::2], strict=False)):
            yield n, a + 1, b + 1, "\n".join(lines[a + 1 : b])


def _sections(text: str | None) -> Iterator[tuple]:
    if not text or not text.strip():
        return
    lines, code, segments = text.split("\n"), False, [["", 1, False, None]]
    for i, line in enumerate(lines):
        bare = line.strip(BLANK)
        if re.fullmatch("-{4,}", bare):
            code = not code
        elif not code and (m := re.fullmatch(r"={1,5}\s+(.+)", bare)):
            segments[-1][3] = i
            segments.append([m[1].strip(BLANK), i + 1, False, None])
            continue
        segments[-1][2] |= bare != ""
    n = 0
    for title, start, visible, stop in segments:
        if visible or (stop is not None and start == 1 and stop > 0):
            yield n, title, start, len(lines) if stop is None else stop
            n += 1


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("parse_sections", ParseSections)
    spark.udtf.register("parse_code_blocks", ParseCodeBlocks)
