"""Metrics and report tables over triage, hardening and classification results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.text import get, listed, percent

# Report lines.
RISKS = ("**Critical:** Minimal binary protections detected", "**Critical:** High-severity vulnerability confirmed", "**High:** Exploitation likely feasible")
NO_RISK = "**Medium:** Standard vulnerability assessment findings"
CHECKS_SHOWN = 5


def metrics(targets: DataFrame, triage: DataFrame, hardening: DataFrame, records: DataFrame) -> DataFrame:
    """One row per target; whatever document is missing takes its defaults."""
    joined = targets.select("target_id").join(triage, "target_id", "left").join(hardening, "target_id", "left").join(records, "target_id", "left")
    return joined.select(
        "target_id", get(F.col("total_crashes"), 0).alias("total_crashes"), get(F.col("unique_crash_frames"), 0).alias("unique_frames"),
        get(F.col("vulnerability_type"), "Unknown").alias("vulnerability_type"), get(F.col("severity"), "Unknown").alias("severity"), percent(get(F.col("confidence"), 0.0)).alias("confidence"),
        get(F.col("protection_level"), "Unknown").alias("protection_level"), get(F.col("exploit_difficulty"), "Unknown").alias("exploit_difficulty"),
        get(F.col("generated"), False).alias("poc_generated"), get(F.col("has_strategy"), False).alias("strategy_available"),
    )


def stamped(rows: DataFrame) -> DataFrame:
    """Metrics rows with the time of the analysis, as text; it differs from run to run."""
    return rows.withColumn("analysis_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def series(rows: DataFrame) -> DataFrame:
    """Three chart values per metrics row; the third is constant."""
    return rows.select("target_id", F.expr(f"stack(3, 'Crashes Analyzed', total_crashes, 'Unique Frames', unique_frames, 'Protection Checks', CAST({CHECKS_SHOWN} AS BIGINT)) AS (label, value)"))


def risk_factors(rows: DataFrame, key: str) -> DataFrame:
    """key and its risk lines, joined by line ends; rows have protection_level, severity, likelihood."""
    found = listed(F.when(F.col("protection_level") == "Low", RISKS[0]), F.when(F.col("severity").isin("Critical", "High"), RISKS[1]), F.when(F.col("likelihood").isin("High", "Medium"), RISKS[2]))
    return rows.select(key, F.when(F.size(found) == 0, NO_RISK).otherwise(F.array_join(found, "\n")).alias("risk"))


def switches(rows: DataFrame, key: str) -> DataFrame:
    """Four on/off items per binary."""
    items = [F.struct(F.lit(n).alias("item"), F.when(get(F.col(c), False), "Enabled").otherwise("Disabled").alias("state")) for n, c in (("ASLR", "aslr"), ("NX Bit", "nx"), ("PIE", "pie"), ("Stack Canaries", "canary"))]
    return rows.select(key, F.inline(F.array(*items)))


def artifact_status(wanted: DataFrame, existing: DataFrame, key: str, ok: str = "Generated", bad: str = "Failed") -> DataFrame:
    """wanted with a status: whether existing has the key."""
    have = existing.select(F.col(key).alias("__have")).distinct()
    out = wanted.join(have, F.col(key) == F.col("__have"), "left")
    return out.withColumn("status", F.when(F.col("__have").isNull(), bad).otherwise(ok)).drop("__have")


def table_rows(*parts: DataFrame) -> DataFrame:
    """Tables put below one another."""
    return reduce(DataFrame.unionByName, parts)


def reduction(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many there are, how many differ, and how many a reduction drops."""
    per = rows.groupBy(column).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after"))
    return out.select("before", "after", (F.col("before") - F.col("after")).alias("dropped"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each metrics row as one JSON object, nulls left out."""
    return rows.select("target_id", F.to_json(F.struct(*(c for c in rows.columns if c != "target_id"))).alias("json"))


def score_lines(scores: DataFrame, key: str) -> DataFrame:
    """The printed summary of each binary as ordered rows: key, part, place, line."""
    part = lambda name, items: F.transform(items, lambda x, i: F.struct(F.lit(name).alias("part"), i.cast("long").alias("place"), x.alias("line")))
    one = lambda c: F.array(F.col(c).cast("string"))
    parts = (part("level", one("protection_level")), part("difficulty", one("exploit_difficulty")), part("required", F.col("required_techniques")), part("vulnerable", F.col("vulnerable_areas")))
    return scores.select(key, F.inline(F.concat(*parts)))
