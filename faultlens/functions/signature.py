"""Crash signatures from debugger output, as one CASE over built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame and address patterns, with ASCII classes so that the JVM and
# other engines agree.
FRAME = r"#([0-9]+)\s+0x([0-9a-f]+) in ([^\s]+) (?:\([^)]*\) )?(?:at ([^:]+):([0-9]+))?"
ADDRESS = r"0x([0-9a-f]+) in ([0-9A-Za-z_]+)"
FRAME_ALL = r"(#[0-9]+\s+0x[0-9a-f]+ in [^\s]+ )"


def part(stdout: Column, group: int) -> Column:
    return F.regexp_extract(stdout, FRAME, group)


def signature(stdout: Column) -> Column:
    """First hit of: timeout, frame with location, frame, SIGSEGV with and without address, SIGABRT, unknown.

    A null text is an unknown crash.
    """
    out = F.coalesce(stdout, F.lit(""))
    n, address, function, file, line = (part(out, k) for k in range(1, 6))
    frame = F.concat(F.lit("#"), n, F.lit(" 0x"), address, F.lit(" in "), function)
    fault = out.contains("SIGSEGV") | out.contains("Segmentation fault")
    return (
        F.when(out.contains("TIMEOUT"), "TIMEOUT")
        .when((n != "") & (file != ""), F.concat(frame, F.lit(" at "), file, F.lit(":"), line))
        .when(n != "", frame)
        .when(fault & out.rlike(ADDRESS), F.concat(F.lit("SIGSEGV at 0x"), F.regexp_extract(out, ADDRESS, 1), F.lit(" in "), F.regexp_extract(out, ADDRESS, 2)))
        .when(fault, "SIGSEGV (stack corruption)")
        .when(out.contains("SIGABRT"), "SIGABRT (abort signal)")
        .otherwise("UNKNOWN_CRASH")
    )


def stable_signature(stdout: Column) -> Column:
    """function@file:line of the first frame, without its address; else as signature()."""
    out = F.coalesce(stdout, F.lit(""))
    place = F.when(part(out, 4) != "", F.concat(F.lit("@"), part(out, 4), F.lit(":"), part(out, 5))).otherwise("")
    return F.when(~out.contains("TIMEOUT") & (part(out, 1) != ""), F.concat(part(out, 3), place)).otherwise(signature(stdout))


def frames(stdout: Column, depth: int = 10) -> Column:
    """All frames of a backtrace, at most `depth` of them, as an array."""
    return F.slice(F.regexp_extract_all(F.coalesce(stdout, F.lit("")), F.lit(FRAME_ALL), 1), 1, depth)
