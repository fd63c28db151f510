"""Pluggable parsers: a format is a set of Column builders, found by file suffix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sections as X


class Parser(Protocol):
    suffix: str

    def tokenize(self, c: Column) -> Column: ...
    def section_rows(self, df: DataFrame, keys: list[str]) -> DataFrame: ...
    def code_blocks(self, df: DataFrame, keys: list[str]) -> DataFrame: ...
    def attribute(self, c: Column, name: str) -> Column: ...


@dataclass(frozen=True)
class MarkupParser:
    suffix: str = ".adoc"

    def tokenize(self, c: Column) -> Column:
        return T.tokenize(c)

    def section_rows(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return X.section_rows(df, keys)

    def code_blocks(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return X.code_blocks(df, keys)

    def attribute(self, c: Column, name: str) -> Column:
        return X.attribute(c, name)


_REGISTRY: dict[str, Parser] = {}


def register(parser: Parser) -> None:
    _REGISTRY[parser.suffix] = parser


def section_rows(df: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Sections of every row by the parser of its path's suffix; rows whose suffix no parser knows give none."""
    parts = [p.section_rows(df.where(F.endswith(F.col(path), F.lit(suffix))), keys) for suffix, p in _REGISTRY.items()]
    return reduce(DataFrame.unionByName, parts)


def parser_for(path: str) -> Parser:
    for suffix, parser in _REGISTRY.items():
        if path.endswith(suffix):
            return parser
    raise ValueError(f"no parser for {path}")


register(MarkupParser())
