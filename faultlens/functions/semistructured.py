"""JSON pieces of free text, and a strict gate for validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(c: Column) -> Column:
    """Whether the text is exactly one JSON value.

    Spark's own parsers accept trailing text; inside a list of one, it can't hide.
    """
    boxed = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(boxed) == 1) & (F.trim(c) != ""), F.lit(False))


def braced(c: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def fenced(c: Column, language: str = "python") -> Column:
    """The text of the first fenced block of a language, else of the first fenced block; stripped."""
    named = F.regexp_extract(c, rf"(?s)```{language}[^\n]*\n(.*?)```", 1)
    plain = F.regexp_extract(c, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(named != "", named).otherwise(plain), r"^\s+|\s+$", "")


def json_field(c: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))
