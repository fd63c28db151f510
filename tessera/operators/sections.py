"""Sections, code blocks, metadata and chunks of markup documents, each in its document's own row: no shuffle.

Lines are an array; fences and headings are positions in it. All functions take and give Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEADING, FENCE, SOURCE = r"^={1,5}\s+.+$", r"^-{4,}$", r"^\[source(?:,\s*([^\]]+))?\]$"
ATTRIBUTE = r"(?m)^:([a-zA-Z][a-zA-Z0-9_-]*):\s*(.*)$"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator of one row keeps the optimizer from putting their
    expressions into the lambdas that use them, where they would be computed for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds lines, bare (trimmed) lines, and the 0-based positions of fences and of headings outside code."""
    df = held(df, lines=F.split(F.coalesce(content, F.lit("")), "\n", -1))
    df = held(df, bare=F.transform("lines", T.trimmed))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    df = held(df, fences=F.filter(places, lambda i: F.get("bare", i).rlike(FENCE)))
    outside = lambda i: F.size(F.filter("fences", lambda f: f < i)) % 2 == 0
    return held(df, heads=F.filter(places, lambda i: F.get("bare", i).rlike(HEADING) & outside(i)))


def sections(df: DataFrame) -> DataFrame:
    """Adds ``sections``: title, start_line, end_line (1-based), for rows of with_lines().

    A section that isn't the last is kept if its body holds a visible line, or if it starts on line 1 and the next
    heading doesn't; the last one if its body holds a visible line.
    """
    n = F.size("lines")

    def at(k: Column) -> Column:
        head = F.get("heads", k - 1)  # the heading of segment k, none for the preamble
        following = F.get("heads", k)
        start = F.when(k == 0, F.lit(1)).otherwise(head + 1)
        first_body = F.when(k == 0, F.lit(0)).otherwise(head + 1)
        title = F.when(k == 0, F.lit("")).otherwise(T.trimmed(F.regexp_extract(F.get("bare", head), r"^={1,5}\s+(.+)$", 1)))
        return F.struct(title.alias("title"), start.cast("int").alias("start_line"), F.coalesce(following, n).cast("int").alias("end_line"), first_body.alias("first"), following.alias("following"))

    df = held(df, segments=F.transform(F.sequence(F.lit(0), F.size("heads")), at))

    def kept(s: Column) -> Column:
        body = F.slice("bare", s["first"] + 1, F.greatest(F.lit(0), s["end_line"] - s["first"]))
        return F.exists(body, lambda x: x != "") | (s["following"].isNotNull() & (s["start_line"] == 1) & (s["following"] > 0))

    blank = ~F.exists("bare", lambda x: x != "")
    some = F.transform(F.filter("segments", kept), lambda s: F.struct(s["title"].alias("title"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line")))
    return held(df, sections=F.when(blank, F.slice(some, 1, 0)).otherwise(some))


def section_rows(df: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """A row per section: keys, ordinal, title, start_line, end_line, level, section_content, chunk_content.

    chunk_content takes the 1-based start as a 0-based place, up to the next section's start: a section's own heading is
    left out and the next one's is taken in. strict gives section_content instead. Each section's text is cut out in its
    document's row: a section carries its own lines, not the document's.
    """
    df = sections(with_lines(df))
    n = F.size("lines")
    df = held(df, deeper=F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("bare", i).rlike(r"^={2,5}\s+.+$")))

    def whole(s: Column, i: Column) -> Column:
        start, end = s["start_line"], s["end_line"]
        stop = F.least(F.coalesce(F.get("sections", i + 1)["start_line"], n), n)
        own = F.array_join(F.slice("lines", start, F.greatest(F.lit(0), end - start + 1)), "\n")
        chunk = F.array_join(F.slice("lines", F.least(start + 1, n + 1), F.greatest(F.lit(0), stop - start)), "\n")
        above = F.array_max(F.filter("deeper", lambda h: h < start))
        level = F.coalesce(F.length(F.regexp_extract(F.get("bare", above), "^(=+)", 1)), F.lit(2))
        return F.struct(s["title"].alias("title"), start.alias("start_line"), end.alias("end_line"), level.alias("level"), own.alias("section_content"), (own if strict else chunk).alias("chunk_content"))

    out = df.select(*keys, F.posexplode(F.transform("sections", whole)).alias("ordinal", "s"))
    return out.select(*keys, "ordinal", "s.title", "s.start_line", "s.end_line", "s.level", "s.section_content", "s.chunk_content")


def code_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per closed fence pair: keys, ordinal, language, content, context, start_line, end_line."""
    df = with_lines(df)

    def block(p: Column) -> Column:
        opened, shut, after = F.get("fences", 2 * p - 2), F.get("fences", 2 * p - 1), F.coalesce(F.get("fences", 2 * p - 3), F.lit(-1))
        # the last line since the last block that isn't blank or a heading decides the language
        between = F.filter(F.reverse(F.slice("bare", after + 2, F.greatest(F.lit(0), opened - after - 1))), lambda x: (x != "") & ~x.rlike(HEADING))
        last = F.get(between, F.lit(0))
        language = F.when(last.rlike(SOURCE), F.lower(T.trimmed(F.regexp_extract(last, SOURCE, 1)))).otherwise("")
        head = F.array_max(F.filter("heads", lambda h: h < opened))
        context = F.coalesce(T.trimmed(F.regexp_extract(F.get("bare", head), r"^={1,5}\s+(.+)$", 1)), F.lit(""))
        content = F.array_join(F.slice("lines", opened + 2, F.greatest(F.lit(0), shut - opened - 1)), "\n")
        return F.struct(F.coalesce(language, F.lit("")).alias("language"), content.alias("content"), context.alias("context"), (opened + 1).cast("int").alias("start_line"), (shut + 1).cast("int").alias("end_line"))

    blocks = F.transform(F.sequence(F.lit(1), F.floor(F.size("fences") / 2).cast("int")), block)
    blocks = F.when(F.size("fences") >= 2, blocks).otherwise(F.slice(blocks, 1, 0))
    out = df.select(*keys, F.posexplode(blocks).alias("ordinal", "b"))
    return out.select(*keys, "ordinal", "b.language", "b.content", "b.context", "b.start_line", "b.end_line")


def header_block(content: Column) -> Column:
    """What stands before the first line that starts with two equal signs and a space."""
    return F.get(F.split(content, r"(?m)^== ", 2), F.lit(0))


def attribute(content: Column, name: str) -> Column:
    """The last value of a header attribute, or null."""
    header = header_block(content)
    names, values = (F.regexp_extract_all(header, F.lit(ATTRIBUTE), F.lit(g)) for g in (1, 2))
    hits = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: x["k"] == name)
    return F.get(hits, F.size(hits) - 1)["v"]


def listed(value: Column) -> Column:
    """A comma-separated attribute as an array; null is empty."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), T.trimmed)
    return F.filter(parts, lambda x: x != "")


def page_title(content: Column, fallback: Column) -> Column:
    title = F.regexp_extract(content, r"(?m)^= (.+)$", 1)
    return F.when(title == "", fallback).otherwise(title)


def document_title(content: Column) -> Column:
    return F.regexp_extract(content, r"(?m)^=\s+(.+)$", 1)


BLOCK_EDGE, OPENS, CLOSES, HEADER_LINE = r"^(={4,}|-{4,})$", r"^ifn?def::", r"^endif::", r"^(:|include::|\[)"


def _spans(marks: Column, opens: Column, ends: Column) -> Column:
    """Ranges (first, last) of positions that marks (place, and what is written there) open and end, by a fold over the marks alone."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit("").alias("sign"), none.alias("ranges"))

    def step(a: Column, m: Column) -> Column:
        opening, ending = opens(a, m), ends(a, m)
        depth = a["depth"] + F.when(opening, 1).when(ending, -1).otherwise(0)
        fresh = opening & (a["depth"] == 0)
        closed = F.when(ending & (depth == 0), F.concat(a["ranges"], F.array(F.struct(a["first"].alias("first"), m["at"].alias("last"))))).otherwise(a["ranges"])
        return F.struct(depth.alias("depth"), F.when(fresh, m["at"]).otherwise(a["first"]).alias("first"), F.when(fresh, m["sign"]).otherwise(a["sign"]).alias("sign"), closed.alias("ranges"))

    whole = F.lit(2**31 - 1)
    finish = lambda a: F.when(a["depth"] > 0, F.concat(a["ranges"], F.array(F.struct(a["first"].alias("first"), whole.alias("last"))))).otherwise(a["ranges"])
    return F.aggregate(marks, start, step, finish)


def _covered(ranges: Column, at: Column) -> Column:
    return F.exists(ranges, lambda r: (r["first"] <= at) & (at <= r["last"]))


def with_first_paragraph(df: DataFrame, content: Column, name: str = "first_paragraph") -> DataFrame:
    """Adds the first paragraph after the title, outside blocks and conditions.

    Blocks are ranges between equal edge signs, conditions ranges between their outermost marks outside blocks; of the
    lines in neither that aren't directives, the paragraph goes from the first visible one to a blank one or a heading.
    """
    line = "struct<at:int,text:string>"
    df = held(df, _bare=F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), T.trimmed))
    title = F.array_position(F.transform("_bare", lambda x: x.startswith("= ")), True).cast("int")
    after = F.when(title > 0, F.slice("_bare", title + 1, F.size("_bare"))).otherwise(F.slice("_bare", 1, 0))
    df = held(df, _lines=F.transform(after, lambda x, i: F.struct(i.alias("at"), x.alias("text"))).cast(f"array<{line}>"))

    def marks(pattern: str, sign: Column, hidden: Column | None = None) -> Column:
        some = F.filter("_lines", lambda x: x["text"].rlike(pattern) & (F.lit(True) if hidden is None else ~_covered(hidden, x["at"])))
        return F.transform(some, lambda x: F.struct(x["at"].alias("at"), sign(x["text"]).alias("sign")))

    edges = marks(BLOCK_EDGE, lambda x: F.left(x, F.lit(1)))
    df = held(df, _blocks=_spans(edges, lambda a, m: a["depth"] == 0, lambda a, m: (a["depth"] > 0) & (a["sign"] == m["sign"])))
    turns = marks(f"{OPENS}|{CLOSES}", lambda x: F.when(x.rlike(CLOSES), "-").otherwise("+"), F.col("_blocks"))
    df = held(df, _conditions=_spans(turns, lambda a, m: m["sign"] == "+", lambda a, m: (m["sign"] == "-") & (a["depth"] > 0)))
    plain = F.filter("_lines", lambda x: ~_covered(F.col("_blocks"), x["at"]) & ~_covered(F.col("_conditions"), x["at"]) & ~x["text"].rlike(f"{HEADER_LINE}|{CLOSES}"))
    df = held(df, _texts=F.transform(plain, lambda x: x["text"]))
    begin = F.array_position(F.transform("_texts", lambda x: x != ""), True).cast("int")
    df = held(df, _rest=F.when(begin > 0, F.slice("_texts", begin, F.size("_texts"))).otherwise(F.slice("_texts", 1, 0)))
    stop = F.array_position(F.transform("_rest", lambda x: (x == "") | x.rlike("^={2,6} .+")), True).cast("int")
    found = F.when(stop > 0, F.slice("_rest", 1, stop - 1)).otherwise(F.col("_rest"))
    return df.withColumn(name, T.clean_description(F.array_join(found, " "))).drop("_bare", "_lines", "_blocks", "_conditions", "_texts", "_rest")


def with_description(df: DataFrame, content: Column, summary: Column | None = None, name: str = "description", n: int = 300) -> DataFrame:
    """Adds the summary if there is one, else the description attribute, else the first paragraph; at most n characters."""
    df = with_first_paragraph(df, content, "_paragraph")
    named = F.regexp_extract(content, r"(?m)^:description:\s*(.+)$", 1)
    own = F.when(named != "", T.clean_description(named)).otherwise(F.col("_paragraph"))
    given = F.coalesce(F.lit(None).cast("string") if summary is None else summary, F.lit(""))
    chosen = F.when(given != "", given).when(T.trimmed(F.coalesce(content, F.lit(""))) == "", "").otherwise(own)
    return df.withColumn(name, T.truncate_words(chosen, n)).drop("_paragraph")


def chunks(raw: DataFrame, base: str = "https://docs.example.org/guides/", core: str = "core", strict: bool = False) -> DataFrame:
    """raw (version, path, content, extension) -> the chunk table: one row per section."""
    content = F.col("content")
    topics = F.array_distinct(F.concat(listed(attribute(content, "topics")), listed(attribute(content, "categories"))))
    named = listed(attribute(content, "extensions"))
    extensions = F.when(F.col("extension").isNotNull(), F.array("extension")).when(F.size(named) > 0, named).otherwise(F.array(F.lit(core)))
    page = T.page_name(F.col("path"))
    pages = raw.select("version", page.alias("page"), "content", page_title(content, page).alias("page_title"), topics.alias("topics"), extensions.alias("extensions"))
    rows = section_rows(pages, ["version", "page", "page_title", "topics", "extensions"], strict)
    return rows.select(
        "version", "page", F.concat_ws("#", "page", T.slug(F.col("title"))).alias("chunk_key"), F.col("page_title").alias("title"), F.col("title").alias("section"), "ordinal",
        T.build_url(F.col("page"), F.col("title"), base).alias("url"), "topics", "extensions", T.first_sentence(F.col("chunk_content")).alias("summary"), F.col("chunk_content").alias("content"),
    )
