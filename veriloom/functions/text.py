"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Lower case, runs of white space to one space, none at the ends; null to the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"(?U)\s+", " "))


def normalize_value(text: Column) -> Column:
    """The same for values in keys, where null reads as the word none."""
    return normalize(F.coalesce(text.cast("string"), F.lit("none")))


def tokens(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text.cast("string")), F.lit(""))


def clean_claim(text: Column) -> Column:
    """Without white space at the ends, then without spaces and full stops at the end."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[ .]+$", "")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
