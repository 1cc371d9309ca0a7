"""Column expressions on vectors, texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of zeros or of different lengths."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def title(text: Column) -> Column:
    """The first 80 characters of the first line."""
    return F.substring(F.substring_index(text, "\n", 1), 1, 80)


def text_hash(text: Column) -> Column:
    """Equal for texts that differ only in case and white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def verdict(severity: Column, concern_at: Column, fail_at: Column) -> Column:
    return F.when(severity.isNull(), "insufficient").when(severity >= fail_at, "fail").when(severity >= concern_at, "concern").otherwise("pass")
