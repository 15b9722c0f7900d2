"""Text expressions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as blank between words (Unicode blanks and separators).
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def words(text: Column) -> Column:
    """Words of a text in order; null and '' give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Search tokens: lower case, split at blanks, longer than one character."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: F.length(w) > 1)


def normalized_title(title: Column) -> Column:
    """Lower case letters and digits with single blanks: the key of exact title matching."""
    kept = F.regexp_replace(F.trim(F.lower(title)), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def sanitized_name(name: Column) -> Column:
    """A section name as part of an id: up to 50 of [a-z0-9_]."""
    kept = F.regexp_replace(name, r"[^a-zA-Z0-9\s]", "")
    return F.substring(F.lower(F.regexp_replace(F.trim(kept), r"\s+", "_")), 1, 50)


def clean_title(title: Column) -> Column:
    """A title without arXiv stamps."""
    stripped = F.regexp_replace(title, r"(?i)arxiv:\s*\d{4}\.\d{4,5}(v\d+)?(\s*\[[^\]]*\])?", "")
    return F.trim(F.regexp_replace(stripped, r"\s+", " "))


def snippet(text: Column, size: int = 300) -> Column:
    """A short extract: no dot leaders, table cells named, cut at a word boundary."""
    flat = F.regexp_replace(text, r"\.{3,}", " ")
    flat = F.regexp_replace(flat, r"(\d+(\.\d+)?±\d+(\.\d+)?\s*)+", "[table data] ")
    flat = F.trim(F.regexp_replace(flat, r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, size), r"\s+\S*$", "")
    return F.when(F.length(flat) > size, F.concat(cut, F.lit("..."))).otherwise(flat)


def base_id(arxiv_id: Column) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(arxiv_id, r"v\d+$", "")
