"""A set of keys as a bounded bitmap: rows that surely aren't in it need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Words of 64 bits, whatever the number of keys: what is broadcast has at most so many rows.
WORDS = 1 << 17


def places(key: Column) -> tuple[Column, Column]:
    """The word of a key and its bit there, as a long."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): a written table of WORDS rows at most."""
    word, bit = places(F.col(key))
    return store.materialize(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bits")


def maybe(rows: DataFrame, key: Column, bits: DataFrame) -> tuple[DataFrame, Column]:
    """rows with two more columns, and whether a row's key may be in the set; false is sure.

    The more keys there are to the bitmap, the more rows of other keys look like them; an
    exact join decides about those, so only the work grows.
    """
    word, bit = places(key)
    at, held = store.unused(rows, "__word"), store.unused(rows, "__bits")
    found = rows.withColumn(at, word).join(F.broadcast(bits.toDF(at, held)), at, "left")
    return found, F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False))
