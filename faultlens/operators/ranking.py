"""Places in groups of any size, numbered by range partitions.

One range exchange puts the rows in the order of (group, order); every task numbers its own
rows as they come, from 1 in each group.  In that order only the first group of a partition can have begun in
earlier ones, where it is then the last group.  So one row per partition (its first group,
its last one, and how many rows that has there) gives each partition what to add to the
places of its first group.  Nothing is sampled by hand, no value reaches the driver, and no
task gets more of a hot group than its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.sources import shared

SCHEMA = "{}, __part int, __index long, __head boolean, __inside long"


def changes(batch: pa.RecordBatch, last: list[pa.Array], n: int) -> np.ndarray:
    """Which rows differ from the one before in the first n columns; last: the row before the batch (null equals null)."""
    out = np.zeros(batch.num_rows, bool)
    for k in range(n):
        now = batch.column(k)
        before = pa.concat_arrays([last[k], now.slice(0, len(now) - 1)])
        out |= np.asarray(pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before))))
    return out


def numbered(n: int):
    """Rows of a sorted partition with their place among its rows of their group; the first n columns are the group."""

    def run(batches):
        from pyspark import TaskContext

        part, index, head, inside, last = TaskContext.get().partitionId(), 0, True, 0, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = changes(batch, last or [c.slice(0, 1) for c in batch.columns[:n]], n)
            at = np.arange(size)
            begun = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(begun < 0, inside + at + 1, at - begun + 1)
            first = head & (begun < 0)
            more = [pa.array(np.full(size, part, np.int32)), pa.array(index + at), pa.array(first), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__part", "__index", "__head", "__inside"])
            index, head, inside, last = index + size, bool(first[-1]), int(place[-1]), [c.slice(size - 1, 1) for c in batch.columns[:n]]

    return run


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds name: the place from 1 of each row in its group by order, which should have no ties.

    group: names of plain columns, none for a place among all rows.  Null is a group of its
    own; floating-point groups should hold no NaN.  An empty table stays empty.
    """
    rows = rows.select(*group, *(c for c in rows.columns if c not in group))
    schema = SCHEMA.format(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    keys = [*(F.col(c) for c in group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = shared.written(ranged.mapInArrow(numbered(len(group)), schema), "placed")
    key = F.struct(*group, F.lit(0).alias("__one"))
    ends = cut.groupBy("__part").agg(F.min_by(key, "__index").alias("first"), F.max_by(F.struct(key.alias("key"), "__inside"), "__index").alias("last"))
    one = lambda k, n, turn: F.struct(k.alias("key"), n.cast("long").alias("n"), F.lit(turn).alias("turn"))
    events = ends.select("__part", F.inline(F.array(one(F.col("first"), F.lit(0), 0), one(F.col("last.key"), F.col("last.__inside"), 1))))
    earlier = Window.partitionBy("key").orderBy("__part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    before = events.select("__part", "turn", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")).where("turn = 0").drop("turn")
    joined = cut.join(F.broadcast(before), "__part")  # a row per partition
    place = F.col("__inside") + F.when(F.col("__head"), F.col("__before")).otherwise(0)
    return joined.select(*rows.columns, place.cast("long").alias(name))
