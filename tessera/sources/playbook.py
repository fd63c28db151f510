"""YAML playbooks that list content sources, and JSON manifests of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import workers_find_package


def yaml_load(text: str | None):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    try:
        return yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None


def resolve_branch(value) -> str:
    """A branch name from what a playbook may hold: null, a name, a number, or a list whose first concrete name counts."""
    for b in value if isinstance(value, list) else [value]:
        name = "" if b is None else str(b).strip()
        if name and name != "HEAD" and not re.fullmatch("/.*/", name) and not re.search("[*?]", name):
            return name
    return "main"


def content_sources(text: str | None, host: str = "github.com") -> list[dict]:
    """name, owner, repo, branch, start_path of each source on the host; a malformed playbook has none."""
    data, out = yaml_load(text), []
    listed = ((data.get("content") or {}).get("sources") if isinstance(data, dict) and isinstance(data.get("content") or {}, dict) else None) or []
    for s in listed:
        url = s.get("url") if isinstance(s, dict) else None
        m = re.match(rf"https?://{re.escape(host)}/([^/]+)/([^/]+?)(?:\.git)?/?$", url or "")
        if m:
            out.append({"name": m[2], "owner": m[1], "repo": m[2], "branch": resolve_branch(s.get("branches")), "start_path": str(s.get("start_path") or "")})
    return out


def sources_table(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([tuple(s.values()) for s in content_sources(text)], SOURCE)


SOURCE = "name string, owner string, repo string, branch string, start_path string"


def _parsed(df: DataFrame, id_col: str, text_col: str, parse: Callable[[str | None], list[tuple]], fields: str) -> DataFrame:
    """id and fields: what parse finds in each row's text, on the executors."""
    workers_find_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, text in zip(pdf["id"], pdf["text"], strict=True) for row in parse(text)], columns=["id", *names])

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, {fields}").withColumnRenamed("id", id_col)


def sources_of(playbooks: DataFrame, id_col: str, text_col: str, host: str = "github.com") -> DataFrame:
    """id, name, owner, repo, branch, start_path of every source of many playbooks, a row each; malformed ones have none."""
    return _parsed(playbooks, id_col, text_col, lambda text: [tuple(s.values()) for s in content_sources(text, host)], SOURCE)


def title_of(text: str | None) -> str | None:
    """The title in a component's descriptor; blank or malformed ones don't count."""
    data = yaml_load(text)
    title = data.get("title") if isinstance(data, dict) else None
    return title.strip() if isinstance(title, str) and title.strip() else None


def titles_of(descriptors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, title of each descriptor, null where there is none."""
    return _parsed(descriptors, id_col, text_col, lambda text: [(title_of(text),)], "title string")


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """name, path, sha of JSON arrays of files, an array a file, or of an object a line; unknown fields are ignored."""
    return spark.read.schema("name string, path string, sha string").option("multiLine", not lines).json(path)


def manifest_paths(manifest: DataFrame, prefix: str = "", suffix: str = ".adoc") -> DataFrame:
    """path (without the prefix), sha of the files with the suffix under the prefix."""
    some = manifest.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))
    return some.select(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")).alias("path"), "sha")
