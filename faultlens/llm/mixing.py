"""Mixing sources to target weights, with DataFrame functions only.

Sources share a total by weight; none may take more than a multiple of its size, and what
it can't take goes to the others by weight.  That water level is found over one row per
source.  A document is then taken floor(rate) times, and once more if its hash says so,
with the fraction as probability.  A hash gives DRAWS such decisions; each source uses
the draw whose total comes nearest to its target, so small sources come near it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

DRAWS = 16
WEIGHTS = (5, 2, 1)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(store.WORD)), F.lit(0)).cast("long")


def draws(id_col: str) -> Column:
    """DRAWS hash-seeded numbers in [0, 1) of a row's id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    hashes = F.concat(*(F.sha2(F.concat(name, F.lit(f":{k}")), 256) for k in range(DRAWS // 8)))
    return F.array(*(F.conv(F.substring(hashes, 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32) for k in range(DRAWS)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source; sizes has source and size.

    The windows over all sources run in one task, on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1)
    one = per.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    one = one.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    best = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return one.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(best * F.col("weight")).alias("target"))


def plan(sizes: DataFrame, **how) -> DataFrame:
    """One row per source: source_size, target, copies, fraction and the draw to use.

    sizes has id, source and size of every row; it is read three times, so it should be a table.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets(sizes, **how).withColumn("rate", rate)
    rates = rates.select(F.col("source").alias("of"), "source_size", "target", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    rates = store.materialize(rates, "rates")
    joined = sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("u", draws("id"))
    took = [F.sum(F.col("size") * (F.col("copies") + F.when(F.col("u")[k] < F.col("fraction"), 1).otherwise(0))).alias(f"t{k}") for k in range(DRAWS)]
    tried = joined.groupBy("source").agg(F.first("target").alias("aim"), *took)
    miss = F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("aim")).alias("miss"), F.lit(k).alias("draw")) for k in range(DRAWS)))
    chosen = tried.select(F.col("source").alias("by"), F.array_min(miss)["draw"].alias("draw"))
    out = rates.join(chosen, F.col("of").eqNullSafe(F.col("by"))).drop("by")
    return store.materialize(out, "plan")


def copies(id_col: str) -> Column:
    """How often a row joined with its source's plan is taken."""
    return F.col("copies") + F.when(draws(id_col)[F.col("draw")] < F.col("fraction"), 1).otherwise(0)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return store.materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")), "sizes")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    Null text has size 0; a null source is a source of its own, the last one; a source of
    size 0 has target 0.  Rows of one id share their draws.  The same rows give the same mix.
    A very long text only has its words counted.
    """
    rows = sized(docs, id_col, text_col, source_col)
    mixed = rows.join(plan(rows, **how), F.col("source").eqNullSafe(F.col("of")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies("id")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns.

    Cases are those of mix_report; a text without words may be taken too, and adds nothing.
    """
    rates = plan(sized(docs, id_col, text_col, source_col), **how)
    names = docs.columns
    of, times, fraction, draw = own = [store.unused(docs, f"mix_{c}") for c in ("of", "copies", "fraction", "draw")]
    rates = rates.select(*(F.col(c).alias(name) for c, name in zip(("of", "copies", "fraction", "draw"), own, strict=True)))
    n = F.col(times) + F.when(draws(id_col)[F.col(draw)] < F.col(fraction), 1).otherwise(0)
    joined = docs.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(of)))
    return joined.where(n > 0).select(*names, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(times)).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_report(store.table(spark, sf_dir, "documents"))


def mix_sql(docs: str) -> str:
    """CTEs that end in `taken`: doc_id, size, source, source_size, target, n (copies)."""
    took = ", ".join(f"sum(size * (copies + CASE WHEN u[{k + 1}] < fraction THEN 1 ELSE 0 END)) AS t{k}" for k in range(DRAWS))
    miss = ", ".join(f"{{'miss': abs(t{k} - target), 'draw': {k}}}" for k in range(DRAWS))
    hashes = " || ".join(f"sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':{k}')" for k in range(DRAWS // 8))
    return rf"""
m_d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, {hashes} AS h FROM {docs}),
m_u AS (SELECT *, [CAST(('0x' || substr(h, 8 * k + 1, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE for k in range(0, {DRAWS})] AS u FROM m_d),
m_p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM m_d GROUP BY source),
m_w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM m_p),
m_l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM m_w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m_t AS (SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM m_l),
m_r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM m_t),
m_f AS (SELECT *, CAST(floor(rate) AS BIGINT) AS copies, rate - floor(rate) AS fraction FROM m_r),
m_j AS (SELECT m_u.doc_id, m_u.source, m_u.size, m_u.u, m_f.source_size, m_f.target, m_f.copies, m_f.fraction FROM m_u JOIN m_f ON m_u.source IS NOT DISTINCT FROM m_f.source),
m_k AS (SELECT source, any_value(target) AS target, {took} FROM m_j GROUP BY source),
m_c AS (SELECT source, list_min([{miss}]).draw AS draw FROM m_k),
taken AS (SELECT doc_id, size, m_j.source, source_size, target, copies + CASE WHEN u[draw + 1] < fraction THEN 1 ELSE 0 END AS n
          FROM m_j JOIN m_c ON m_j.source IS NOT DISTINCT FROM m_c.source)"""


SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken FROM taken"
