"""Text functions as Column expressions: everything stays in the JVM, inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which the stemmer tries them; three characters must stay (fixed values).
SUFFIXES = "ation tion sion ment ness able ible ous ive ity ful less ing ed ly er est es".split()
#: After these a doubled final consonant is made single.
DOUBLING = ("ing", "ed", "er")
# Words that a request's keywords leave out (fixed values).
STOP_WORDS = "a an and the how does do is are was were what which who when where why in on at to for with from by of about explain show me work works working please your".split()

# Markup that cleaning removes or replaces by its text, in order (fixed values).
CLEANING = [
    (r"(?ms)^////.*?^////", ""),
    (r"include::[^\[]*\[[^\]]*\]", ""),
    (r"(?:ifdef|ifndef|endif)::[^\[]*\[[^\]]*\]", ""),
    (r"(?m)^:\w[\w-]*:.*$", ""),
    (r"(?m)^\[(?:id=|\.|source)[^\]]*\]\s*$", ""),
    (r"(?m)^\[(?:source|listing|literal|verse|quote|sidebar|example|passthrough)(?:,[^\]]*)?\]\s*$", ""),
    (r"(?m)^\[(?:NOTE|TIP|WARNING|IMPORTANT|CAUTION)\]\s*$", ""),
    (r"(?m)^\[\.[\w-]+\]\s*$", ""),
    (r"(?m)^\[\[[\w-]+\]\]\s*$", ""),
    (r"(?m)^\[#[\w-]+\]\s*$", ""),
    (r"xref:[^\[]*\[([^\]]*)\]", "$1"),
    (r"link:[^\[]*\[([^\]]*)\]", "$1"),
    (r"<<[^,>]+,([^>]+)>>", "$1"),
    (r"<<[^,>]+>>", ""),
    (r"image::?[^\[]*\[[^\]]*\]", ""),
    (r"icon:[^\[]*\[[^\]]*\]", ""),
    (r"anchor:[^\[]+\[[^\]]*\]", ""),
    (r"\{[\w-]+\}", ""),
    (r"<\d+>|<\.>", ""),
    (r"(?m)^(NOTE|TIP|WARNING|IMPORTANT|CAUTION):\s*", ""),
    (r"(?m)^\|={3,}\s*$", ""),
    (r"(?m)^\|\s+", ""),
    (r"(?m)^//\s+.*$", ""),
    (r"\n{3,}", "\n\n"),
]
# What descriptions lose as well, in order (fixed values).
DESCRIPTION_CLEANING = [
    (r"(?m)^={4,}\s*$", ""),
    (r"(?m)^(WARNING|TIP|NOTE|IMPORTANT|CAUTION):\s*", ""),
    (r"(?:pass|stem):\[[^\]]*\]", ""),
    (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
    (r"_{1,2}([^_]+)_{1,2}", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\s+", " "),
]


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def plain_words(c: Column) -> Column:
    """The text in lower case without characters other than letters, digits, dashes and white space, in one pass."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9\s-]+", ""))


def tokenize(c: Column, least: int = 3) -> Column:
    """Words in lower case without characters other than letters, digits and dashes; words of fewer than ``least`` go."""
    return F.filter(F.split(plain_words(c), r"\s+"), lambda w: F.length(w) >= least)


def stem(w: Column) -> Column:
    """The rule stemmer as one CASE: the first suffix that leaves three characters is taken off."""

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - k)

    out = None
    for s in SUFFIXES:
        rest = cut(len(s))
        if s in DOUBLING:
            double = (F.right(rest, F.lit(1)) == F.substring(rest, F.length(rest) - 1, F.lit(1))) & ~F.right(rest, F.lit(1)).isin(*"aeiou")
            rest = F.when(double, cut(len(s) + 1)).otherwise(rest)
        fits = w.endswith(s) & (F.length(w) >= len(s) + 3)
        out = F.when(fits, rest) if out is None else out.when(fits, rest)
    plural = w.endswith("s") & ~w.endswith("ss") & (F.length(w) >= 4)
    return out.when(plural, cut(1)).otherwise(w)


def stem_word(w: str) -> str:
    """The rule stemmer for one word, as the Column form."""
    for s in SUFFIXES:
        if w.endswith(s) and len(w) >= len(s) + 3:
            rest = w[: -len(s)]
            return rest[:-1] if s in DOUBLING and len(rest) > 1 and rest[-1] == rest[-2] and rest[-1] not in "aeiou" else rest
    return w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) >= 4 else w


def tokens(text: str, least: int = 3) -> list[str]:
    """tokenize() for one string."""
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub(r"[^a-zA-Z0-9 \t\n\x0b\f\r-]+", "", text or "").lower()) if len(w) >= least]


def stems(c: Column) -> Column:
    return F.transform(tokenize(c), stem)


def parse_keywords(c: Column) -> Column:
    words = F.transform(F.split(trimmed(c), r"\s+"), F.lower)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def strip_code_blocks(c: Column) -> Column:
    """Lines outside fences of four dashes or more; an unclosed fence drops what follows. A line goes with the line end
    before it, for which the text gets one at its start."""
    blank = r"[\x00-\x20&&[^\n]]*"
    fence = rf"\n{blank}-{{4,}}{blank}(?=\n|\z)"
    return F.substring(F.regexp_replace(F.concat(F.lit("\n"), c), rf"{fence}(?s:.*?)(?:{fence}|\z)", ""), F.lit(2), F.length(c))


def _folded(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), rules, c)


def clean_markup(c: Column) -> Column:
    return trimmed(_folded(F.coalesce(c, F.lit("")), CLEANING))


def clean_description(c: Column) -> Column:
    return trimmed(_folded(clean_markup(c), DESCRIPTION_CLEANING))


def truncate_words(c: Column, n: int) -> Column:
    """At the last space up to n, if it is beyond 0.7 n, else at n; an ellipsis follows."""
    head = F.substring(c, 1, n + 1)
    at = n + 1 - F.locate(" ", F.reverse(head))  # 0-based place of the last space
    cut = F.when((F.locate(" ", head) > 0) & (at > n * 0.7), F.substring(c, F.lit(1), at)).otherwise(F.substring(c, 1, n))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def first_sentence(c: Column, n: int = 200) -> Column:
    """The first sentence on the first line, else the first n characters; a leading heading mark is dropped."""
    text = F.regexp_replace(trimmed(c), r"^={1,5}\s+", "")
    sentence = F.regexp_extract(text, r"^(.*?\.)(?:\s|$)", 1)
    return F.when(trimmed(c) == "", "").otherwise(F.substring(F.when(sentence != "", sentence).otherwise(text), 1, n))


def slug(c: Column) -> Column:
    steps = [("['`]", ""), ("[^a-z0-9-]", "-"), ("-{2,}", "-"), ("^-+|-+$", "")]
    return _folded(F.lower(F.coalesce(c, F.lit(""))), steps)


def page_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.adoc$", "")


def build_url(page: Column, section: Column | None = None, base: str = "https://docs.example.org/guides/") -> Column:
    url = F.concat(F.lit(base), page_name(page))
    return url if section is None else F.concat(url, F.when(slug(section) == "", "").otherwise(F.concat(F.lit("#"), slug(section))))


def display_name(c: Column, prefix: str = "") -> Column:
    """Words between dashes, each with a capital; ``prefix`` is dropped first."""
    name = F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c) if prefix else c
    words = F.filter(F.split(name, "-"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))), " ")


def trigrams(c: Column) -> Column:
    """The set of trigrams of each run of letters and digits, padded by two spaces before and one after."""
    words = F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda w: w != "")
    of_word = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(of_word))


def trigram_set(text: str) -> set[str]:
    """trigrams() for one string."""
    return {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", text.lower()) if w for i in range(len(w) + 1)}


def head_trigrams(c: Column, chars: int = 2000) -> Column:
    """Some of the trigrams: those of the whole words within the first characters."""
    words = F.split(F.lower(F.substring(c, 1, chars)), "[^a-z0-9]+")
    whole = F.when(F.length(c) > chars, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return trigrams(F.array_join(F.array_distinct(whole), " "))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; a and b are trigram sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def etag(*cols: str) -> Column:
    """16 hex digits of the SHA-256 of the row's JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 16)


def cache_seconds(kind: Column, version: Column) -> Column:
    return F.when(kind == "catalog", 1800).when(version.isNull() | (version == "main"), 900).otherwise(3600)


def extension_of(path: Column, prefix: str = "extensions", core: str = "core") -> Column:
    return F.when(path.startswith(prefix + "/"), F.get(F.split(path, "/", 3), F.lit(1))).otherwise(core)


def decoded_content(content: Column, encoding: Column) -> Column:
    """Base64 with white space removed; other encodings pass; null is empty."""
    plain = F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")
    return F.coalesce(F.when(encoding == "base64", plain).otherwise(content), F.lit(""))


def concrete_branch(branches: Column) -> Column:
    """The first branch that is a name: no /regex/, HEAD or wildcard; else main."""
    named = F.filter(branches, lambda b: ~b.rlike(r"^/.*/$") & (b != "HEAD") & ~b.rlike("[*?]"))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("main"))
