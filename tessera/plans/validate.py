"""Validation of requests and the errors it raises."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from ..functions.text import STOP_WORDS

MAX_QUERY, MAX_FILTER, MAX_LIMIT, MAX_BATCH = 500, 200, 100, 10


class RequestError(ValueError):
    status, title = 500, "Internal Server Error"

    def problem(self, instance: str = "") -> dict:
        """The error as a problem detail."""
        return {"type": "about:blank", "title": self.title, "status": self.status, "detail": str(self), "instance": instance, "timestamp": datetime.now(timezone.utc).isoformat()}


class InvalidInput(RequestError):
    status, title = 400, "Bad Request"


class NotFound(RequestError):
    status, title = 404, "Not Found"


class MethodNotAllowed(RequestError):
    status, title = 405, "Method Not Allowed"


class NotAcceptable(RequestError):
    status, title = 406, "Not Acceptable"


class UnsupportedMedia(RequestError):
    status, title = 415, "Unsupported Media Type"


class UpstreamError(RequestError):
    status, title = 502, "Bad Gateway"


def required(value: str | None, name: str) -> str:
    if value is None or not value.strip():
        raise InvalidInput(f"{name} is required")
    return value.strip()


def query(value: str | None) -> str:
    q = required(value, "q")
    if len(q) > MAX_QUERY:
        raise InvalidInput(f"q must be at most {MAX_QUERY} characters")
    return q


def number(value: int | str | None, name: str, default: int) -> int:
    """An integer from what a request holds; what isn't one is bad input, not a page that isn't there."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return default
    try:
        return int(value)
    except (TypeError, ValueError) as e:
        raise InvalidInput(f"{name} must be an integer") from e


def limit(value: int | str | None, default: int = 20, most: int = MAX_LIMIT) -> int:
    n = number(value, "limit", default)
    if not 1 <= n <= most:
        raise InvalidInput(f"limit must be between 1 and {most}")
    return n


def offset(value: int | str | None) -> int:
    n = number(value, "offset", 0)
    if n < 0:
        raise InvalidInput("offset must not be negative")
    return n


def filter_value(value: str | None, name: str) -> str | None:
    if value is None or not value.strip():
        return None
    if len(value) > MAX_FILTER or not re.fullmatch(r"[a-zA-Z0-9.:_-]+", value):
        raise InvalidInput(f"{name} holds characters that aren't allowed")
    return value


def version(value: str | None, known: list[str] | None = None) -> str:
    v = "main" if value is None or not value.strip() else value
    if ".." in v or not re.fullmatch(r"[a-zA-Z0-9._/-]+", v):
        raise InvalidInput("version holds characters that aren't allowed")
    if known is not None and v != "main" and v not in known:
        raise InvalidInput(f"Unknown version: {v}. Available: {', '.join(sorted(known))}")
    return v


def path(value: str | None) -> str:
    p = required(value, "path")
    if p.startswith("/") or ".." in p or "\\" in p:
        raise InvalidInput("path must be relative")
    return p


def subject(value: str | None, known: list[str]) -> str | None:
    s = filter_value(value, "subject")
    if s is not None and s not in known:
        raise InvalidInput(f"Unknown subject: {s}. Available: {', '.join(sorted(known))}")
    return s


def batch_paths(values: list[str] | None) -> list[str]:
    """At most ten before repeats go; order is kept."""
    if not values:
        raise InvalidInput("paths is required")
    if len(values) > MAX_BATCH:
        raise InvalidInput(f"At most {MAX_BATCH} paths")
    return list(dict.fromkeys(path(v) for v in values))


def keywords(raw: str | None) -> list[str]:
    words = [w for w in required(raw, "keywords").lower().split() if w not in STOP_WORDS]
    if not words:
        raise InvalidInput("All keywords are stop words")
    return words
