"""How filters interact: what every order of them removes, from joint-failure counts alone.

One aggregate counts, for each part and each of the 2**k sets of filters, the documents
that fail all of the set: sums of products of 0/1 flags, which combine before they shuffle.
Everything else is arithmetic on those counts.  Möbius inversion turns them into the counts of
documents that fail exactly a set: the survivors, the failures of one filter only, and what a
filter removes behind any others.  The documents that a set of filters removes are a game
whose Harsanyi dividend of a set is its joint count with alternating sign, and a
filter's Shapley value is its share of the dividends of the sets that hold it.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MEASURES = ("docs", "good", "toxic")
STEPS = "array<struct<filter_order:string,step:int,bit:int,before:int>>"


def steps(names: str) -> list[dict]:
    """Every step of every order: the filter's bit and those of the filters before it."""
    bit = {c: 1 << k for k, c in enumerate(names)}
    return [
        {"filter_order": "".join(order), "step": k + 1, "bit": bit[c], "before": sum(bit[x] for x in order[:k])}
        for order in permutations(names) for k, c in enumerate(order)
    ]


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def joint_counts(flagged: DataFrame, names: str, part: str = "part") -> DataFrame:
    """One row per part: for each measure an array with the joint count of every set of filters, at the set's bits."""
    flag = {c: F.col(c).cast("long") for c in names}
    size = {"docs": F.lit(1).cast("long")} | {m: F.col(m).cast("long") for m in MEASURES[1:]}

    def failing(bits: int, measure: str) -> Column:
        return F.sum(reduce(lambda a, b: a * b, (flag[c] for k, c in enumerate(names) if bits >> k & 1), size[measure]))

    return flagged.groupBy(part).agg(*(F.array(*(failing(bits, m) for bits in range(1 << len(names)))).alias(m) for m in MEASURES))


def exact_counts(joint: Column, k: int) -> Column:
    """Documents that fail exactly a set: its Möbius inversion over the larger sets."""
    def of(bits: int) -> Column:
        larger = (s for s in range(1 << k) if s & bits == bits)
        return reduce(lambda a, b: a + b, (F.get(joint, F.lit(s)) * (-1) ** (s ^ bits).bit_count() for s in larger))

    return F.array(*map(of, range(1 << k)))


def dividends(joint: Column, k: int) -> Column:
    """Harsanyi dividends of sets of filters, each cut into its members' shares of all k! orders."""
    share = [F.lit(0).cast("long")] + [F.get(joint, F.lit(s)) * ((-1) ** (s.bit_count() + 1) * factorial(k) // s.bit_count()) for s in range(1, 1 << k)]
    return F.array(*share)


def interactions(flagged: DataFrame, names: str, part: str = "part") -> DataFrame:
    """What each filter does at each step of each order, for each part.

    flagged: part, one boolean column per letter of names (true: the document fails that
    filter), and the booleans good and toxic.  Returns part, filter_order, step, and the
    longs kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  A part
    has all its k! * k rows; a table without rows has none.
    """
    k = len(names)
    counts = joint_counts(flagged, names, part)
    exact = {m: exact_counts(F.col(m), k) for m in MEASURES}
    cells = counts.select(part, F.col("docs").alias("joint"), dividends(F.col("docs"), k).alias("shares"), *(v.alias(m) for m, v in exact.items()))
    each = F.inline(F.from_json(F.lit(json.dumps(steps(names))), STEPS))
    rows = cells.select("*", each)
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: total(F.filter(F.col(m), lambda _, i: (i.bitwiseAND(before) == 0) & (i.bitwiseAND(bit) != 0)))
    removed = here("docs")
    return rows.select(
        part, "filter_order", "step", total(F.filter(F.col("docs"), lambda _, i: i.bitwiseAND(before.bitwiseOR(bit)) == 0)).alias("kept"), removed.alias("removed"),
        (F.get("joint", bit) - removed).alias("redundant"), F.get("docs", bit).alias("unique_fails"), here("good").alias("good_lost"), here("toxic").alias("toxic_lost"),
        total(F.filter(F.col("shares"), lambda _, i: i.bitwiseAND(bit) != 0)).alias("shapley"),
    )


def text_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, the failures A to E, good and toxic of every row of docs.

    A: under 50 words.  B: under 65 % of the words are distinct.  C: over 5 % of the
    characters are capital A-Z.  D: holds one of # $ % & * |.  E: a smaller id has the same
    text.  Null text is empty; a null source is the empty one.  A row without an id is no
    copy and makes none; repeated rows of one id are judged alike.  An id is good or toxic
    if one of its label rows says so.  Copies are found by 256-bit digests; they meet
    again by digest and id, so a text that a third of all rows have is no hot key.  A very
    long text costs one task the list of its words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(store.WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    judged = rows.select(
        "id", "part", (n < 50).alias("A"), (F.lit(100).cast("long") * F.size(F.array_distinct("words")) < F.lit(65).cast("long") * n).alias("B"),
        (F.lit(100).cast("long") * F.regexp_count("text", F.lit("[A-Z]")) > F.lit(5).cast("long") * F.char_length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    judged = store.materialize(judged, "judged")
    first = judged.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(True).alias("first"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    out = judged.join(first, ["digest", "id"], "left").join(known, "id", "left")
    no = F.lit(False)
    return out.select("part", *"ABCD", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"), F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def query(spark, sf_dir: str) -> DataFrame:
    flagged = text_filters(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels"))
    return interactions(flagged, "ABCDE")


# The same by counting the documents of each exact set of failures, order by order.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text) AS c,
             regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d JOIN t ON t.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
n AS (SELECT part, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END, CASE WHEN c THEN ['C'] ELSE [] END, CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS fails,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x(v) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.v || q.v || r.v || s.v || t.v AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.v, q.v, r.v, s.v, t.v])) = 5),
k AS (SELECT filter_order, step, substr(filter_order, step, 1) AS v, string_split(substr(filter_order, 1, step - 1), '') AS earlier FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, v,
        coalesce(sum(n) FILTER (NOT list_contains(fails, v) AND NOT list_has_any(fails, earlier)), 0) AS kept, coalesce(sum(n) FILTER (list_contains(fails, v) AND NOT list_has_any(fails, earlier)), 0) AS removed,
        coalesce(sum(n) FILTER (list_contains(fails, v) AND list_has_any(fails, earlier)), 0) AS redundant, coalesce(sum(n) FILTER (fails = [v]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (list_contains(fails, v) AND NOT list_has_any(fails, earlier)), 0) AS good_lost, coalesce(sum(toxic) FILTER (list_contains(fails, v) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
      FROM n, k GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley FROM r
"""
