"""Text building blocks: trimming, hashing, first matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Stripped, inner white space collapsed to one space."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def first_match(x: Column, pattern: str, group: int = 0, flags: str = "(?iu)") -> Column:
    """Stripped text of the first match, null if there is none."""
    return blank_to_null(strip(F.regexp_extract(x, flags + pattern, group)))


def content_hash(x: Column) -> Column:
    """SHA-256 of the stripped text with line ends as \\n."""
    return F.sha2(F.regexp_replace(strip(x), "\r\n?", "\n").cast("binary"), 256)


def query_hash(x: Column) -> Column:
    """SHA-256 of the lower-cased query with white space collapsed."""
    return F.sha2(F.lower(squeeze(x)).cast("binary"), 256)


def job_key(content: Column) -> Column:
    """The first 16 digits of a content hash name a raw slot."""
    return F.substring(content, 1, 16)


def safe_name(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, r"(?U)[^\w\-.]", "_"), 1, 128)


def llm_cache_key(content: Column, version: str, model: str) -> Column:
    return F.sha2(F.concat_ws("|", content, F.lit(version), F.lit(model)).cast("binary"), 256)


def flatten(x: Column) -> Column:
    """An array in comparable form: its elements as sorted strings, in JSON."""
    return F.to_json(F.array_sort(F.transform(x, lambda v: v.cast("string"))))
