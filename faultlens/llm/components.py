"""Connected components of a link table, by alternating star contractions.

Tasks make stars of some links each, by union and find.  A node that has several centers so
ties them; these ties are links of centers alone, and fewer.  Where they stay many, as in
chains whose links all lie in tasks of their own, rounds hook each node to the least neighbour
of itself, first its larger neighbours, then its smaller ones; stars are left after about
log(n) rounds, and end them.  Nodes are any ordered type.  All else is joins and aggregates,
which combine before they shuffle; a node has one center a task, so one that has a third
of all links costs no task more than others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Links of a task, about, and types of nodes that Python orders as Spark does.
LINKS, PLAIN = 100_000, ("binary", "string", "int", "bigint")


def stars(batches):
    """(node, center) of each node of some links: the least node that it is connected to there."""
    up, kind = {}, None

    def center(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([center(x) for x in up], kind)], ["a", "b"])

    seen = 0
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = center(a), center(b)
            up[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen > 4 * LINKS:  # a task that got more, in parts
            yield flush()
            up.clear()
            seen = 0
    if up:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): the least node of each node's component.

    Nodes without links don't appear.  Loops and repeated links change nothing.
    """
    both = links.where("a <> b").select("a", "b")
    kind = both.schema["a"].dataType.simpleString()
    return joined(both, f"a {kind}, b {kind}") if kind in PLAIN else rounds(both)


def joined(links: DataFrame, schema: str) -> DataFrame:
    many = links.count()
    found = links.coalesce(-(-many // LINKS) or 1).mapInArrow(stars, schema)
    if many <= LINKS:
        return store.materialize(found, "stars").toDF("node", "root")
    found = store.materialize(found, "stars")
    per = store.materialize(found.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("b")), "centers")
    store.drop(links.sparkSession, found)
    ties = per.where(F.size("b") > 1).select(F.explode(F.slice("b", 2, F.size("b") - 1)).alias("a"), F.element_at("b", 1).alias("b"))
    ties = store.materialize(ties.distinct(), "ties")
    n = ties.count()
    label = (joined(ties, schema) if 2 * n <= many else rounds(ties)).toDF("center", "top")
    least = per.select(F.col("a").alias("node"), F.element_at("b", 1).alias("center"))
    return least.join(label, "center", "left").select("node", F.coalesce("top", "center").alias("root"))


def rounds(links: DataFrame) -> DataFrame:
    """components() by rounds alone."""
    edges = store.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not are_stars(edges):
        either = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that both sides of the join are plain exchanges and a hub's can be split
        least = store.materialize(either.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = either.where("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(down.select("a", F.col("m").alias("b"))).distinct()
        new = store.materialize(small, "links")
        store.drop(edges.sparkSession, edges, least)
        edges = new
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a lesser one (a > b), or only links of greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down + up > 1").agg(F.count("*")).first()[0]
