"""Small text expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def first_line_with(c: Column, needle: str) -> Column:
    """First line that contains needle, or null."""
    return F.get(F.filter(lines(c), lambda x: x.contains(needle)), F.lit(0))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(n) for n in needles))


def preview(c: Column, n: int) -> Column:
    """The first n characters and three dots, always."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def round_even(c: Column, digits: int) -> Column:
    """Rounded in doubles, as SQL's round_even does it: bround goes by the shortest decimal and loses the sign of zero."""
    c, unit = c.cast("double"), F.lit(float(10**digits))
    return F.when(F.abs(c * unit) < float("inf"), F.rint(c * unit) / unit).otherwise(c)


def percent(c: Column) -> Column:
    """A share as whole percent, halves to even."""
    return round_even(c * 100, 0)


def percent_text(c: Column, digits: int = 0) -> Column:
    """A share as percent with some digits, halves to even; null stays null."""
    x = round_even(c * 100, digits)
    text = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", x))
    return F.when(x.isNotNull(), F.concat(text, F.lit("%")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    """A dictionary lookup with a default; null takes the default too."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), c), F.lit(default))


def get(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def listed(*items: Column) -> Column:
    """The items that are not null, in order."""
    return F.array_compact(F.array(*items))


def hex_escapes(c: Column) -> Column:
    r"""Bytes as \xNN escapes, lower-case."""
    return F.regexp_replace(F.lower(F.hex(c)), "(..)", r"\\x$1")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def first_index(c: Column, needle: str) -> Column:
    """Place of the first needle from 0, -1 if there is none."""
    return F.locate(needle, c) - 1


def last_index(c: Column, needle: str) -> Column:
    """Place of the last needle from 0, -1 if there is none."""
    back = F.locate(needle[::-1], F.reverse(c))
    return F.when(back == 0, -1).otherwise(F.length(c) - back - len(needle) + 1)


def seconds(c: Column) -> Column:
    """Rounded to hundredths, halves to even."""
    return round_even(c, 2)


def with_extension(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, rf"\{old}$", new)
