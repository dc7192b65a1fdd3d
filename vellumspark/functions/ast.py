"""Index and display text of block contents stored as JSON trees.

A tree's values are read in document order at any depth by one pattern that consumes every
JSON string whole, so text inside strings is never taken for a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON string; the possessive form matches long texts without backtracking.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _values(content: Column, keys: str) -> Column:
    """JSON values of the named keys in document order, as an array of strings."""
    found = F.regexp_extract_all(content, F.lit(rf'"(?:{keys})"\s*:\s*({_STRING}|true|false|-?[0-9][0-9.eE+-]*)|{_STRING}'), 1)
    kept = F.filter(found, lambda v: v != "")
    plain = F.transform(kept, lambda v: F.when(v == "true", '"1"').when(v == "false", '"0"').otherwise(v))
    return F.from_json(F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]")), "array<string>")


def index_text(content: Column) -> Column:
    """Values under text, code, alt and caption joined by spaces; null if a tree has none; other content as it is."""
    values = _values(content, "text|code|alt|caption")
    return F.when(F.try_parse_json(content).isNull(), content).when(F.size(values) > 0, F.array_join(values, " "))


def display_text(content: Column) -> Column:
    """Text nodes joined by spaces with white space collapsed; content that is no JSON as it is."""
    joined = F.trim(F.regexp_replace(F.array_join(_values(content, "text"), " "), r"\s+", " "))
    return F.when(F.try_parse_json(content).isNull(), content).otherwise(joined)
