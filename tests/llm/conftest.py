import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and clashing names."""
    long = "ab cd " * 20_000
    rows = [(1, "one two three four five six seven", "en", "s", 3), (1, "one two three four five six seven", "en", "s", 3), (2, "", "en", None, 0), (3, None, None, "s", None), (None, "x y", "en", "s", 3), (None, None, None, None, None), (4, long, "en", "s", 9), (5, " \n\t ", "en", "s", 4), (6, "one", "en", "s", 3), (7, "Été 漢字 \U0001f600 ▁", "fr", "s", 5), (8, "One TWO three four five six seven", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: docs.text for c in ("n", "sid", "gid", "start", "th", "tie", "score", "kind", "path", "toxic_score", "dir")}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
