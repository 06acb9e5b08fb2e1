"""The assessment report as ordered lines: section, line_no, line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.text import get, percent_text
from faultlens.operators import hardening, metrics

# Lines of the vulnerability details, their columns and what stands for a missing one.
DETAILS = (
    ("Type", "vulnerability_type", "Unknown"), ("Severity", "severity", "Unknown"), ("Attack Vector", "attack_vector", "Unknown"),
    ("Impact", "impact", "Unknown"), ("Technical Details", "technical_details", "Not available"),
)


def section(number: int, rows: DataFrame, key: str, *lines: Column) -> DataFrame:
    """Lines of each row as rows; null lines are left out."""
    return listing(number, rows, key, F.array(*lines))


def listing(number: int, rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """As section(), from arrays of lines; a null array has none."""
    items = F.posexplode(F.array_compact(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))))
    return rows.select(key, items).select(F.col(key).alias("target_id"), F.lit(number).alias("section"), F.col("pos").cast("long").alias("line_no"), F.col("col").alias("line"))


def headed(heading: str, items: Column, form) -> Column:
    """A heading and the formed items, or null if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(heading)), F.transform(items, form)))


def reviewed(reviews: DataFrame) -> DataFrame:
    """The source review: three lines, and the dangerous functions if there are any."""
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    lines = (F.concat(F.lit(f"**{name}:** "), value) for name, value in (("Vulnerable Function", tick(get(F.col("vulnerable_function"), "Unknown"))), ("Root Cause", get(F.col("root_cause"), "Unknown")), ("Attack Surface", get(F.col("attack_surface"), "Unknown"))))
    found = headed("**Dangerous Functions Detected:**", F.col("dangerous_functions"), lambda x: F.concat(F.lit("- "), tick(x)))
    return listing(7, reviews, "target_id", F.array(F.lit("### Source Code Analysis"), *lines), found)


def remediation(patches: DataFrame) -> DataFrame:
    """Fixes, corrected code and long-term recommendations, as far as there are any."""
    head = F.concat(F.array(F.lit("## Remediation Strategy"), F.lit("### Immediate Actions Required")), F.transform(F.coalesce(F.col("immediate_fixes"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("1. **"), x, F.lit("**"))))
    code = F.when(F.col("corrected_code_snippet") != "", F.array(F.lit("### Code Fix Example"), F.lit("```c"), F.col("corrected_code_snippet"), F.lit("```")))
    return listing(8, patches, "target_id", head, code, headed("### Long-term Security Improvements", F.col("long_term_recommendations"), lambda x: F.concat(F.lit("- "), x)))


def report(summary: DataFrame, groups: DataFrame, scores: DataFrame, records: DataFrame, files: DataFrame, reviews: DataFrame | None = None, patches: DataFrame | None = None) -> DataFrame:
    """All sections, numbered in their order; a section without data has no lines.

    summary: target_id, total_crashes, unique_crash_frames.  groups: target_id, rnk, frame,
    cnt, file, size.  scores: output of hardening.score with target_id.  records: target_id,
    vulnerability_type, severity, confidence, likelihood, attack_vector, impact,
    technical_details.  files: target_id, file, description, status.  reviews: target_id,
    vulnerable_function, root_cause, attack_surface, dangerous_functions.  patches: target_id,
    immediate_fixes, corrected_code_snippet, long_term_recommendations.  Lines of files are by
    name; one target's files are a short list.
    """
    c, text = F.col, lambda s: F.lit(s)
    bold = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    risk = metrics.risk_factors(scores.select("target_id", "protection_level").join(records, "target_id", "left"), "target_id")
    table = hardening.protection_rows(scores, "target_id")
    parts = [
        section(1, summary, "target_id", text("# Security Report"), bold("Total Crashes", c("total_crashes").cast("string")), bold("Unique Crash Frames", c("unique_crash_frames").cast("string"))),
        section(2, records, "target_id", text("## Executive Summary"), bold("Critical Finding", F.concat(get(c("vulnerability_type"), "Unknown"), F.lit(" vulnerability detected"))), bold("Risk Level", get(c("severity"), "Unknown")), bold("Exploitability", F.concat(percent_text(get(c("confidence"), 0.0)), F.lit(" confidence")))),
        section(3, scores, "target_id", bold("Defense Level", c("protection_level")), bold("Exploit Difficulty", c("exploit_difficulty"))),
        section(4, risk, "target_id", text("### Risk Assessment"), F.concat(F.lit("- "), F.replace(c("risk"), F.lit("\n"), F.lit("\n- ")))),
        section(5, records, "target_id", text("### Vulnerability Classification"), *(bold(name, get(c(column), default)) for name, column, default in DETAILS)),
        table.select("target_id", F.lit(6).alias("section"), F.when(c("protection") == "ASLR", 0).when(c("protection") == "NX Bit", 1).when(c("protection") == "Stack Canaries", 2).when(c("protection") == "PIE", 3).otherwise(4).cast("long").alias("line_no"), F.concat_ws(" | ", "protection", "status", "impact").alias("line")),
        groups.select("target_id", F.lit(9).alias("section"), c("rnk").cast("long").alias("line_no"), F.concat(F.lit("### Crash Group "), c("rnk").cast("string"), F.lit(": "), c("frame"), F.lit(" ("), c("cnt").cast("string"), F.lit(" crashes, "), c("file"), F.lit(")")).alias("line")),
        files.select("target_id", F.lit(10).alias("section"), F.row_number().over(Window.partitionBy("target_id").orderBy("file", "description")).cast("long").alias("line_no"), F.concat_ws(" | ", "file", "description", "status").alias("line")),
        *([] if reviews is None else [reviewed(reviews)]),
        *([] if patches is None else [remediation(patches)]),
    ]
    return reduce(DataFrame.unionByName, parts)
