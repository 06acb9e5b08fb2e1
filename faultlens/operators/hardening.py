"""Hardening facts of binaries from tool output, and the rule-based score.

Input has one row per binary with the tools' texts as columns; nothing is ever run.
`compat=True` repeats behaviour that looks unintended: "stripped" also matches "not
stripped", the stack segment's flags are read from its own line only, and imports need
three fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.text import contains_any, first_line_with, get, lines, listed, lookup, strip

# Words and labels that results must equal.
ASLR = {"0": "Disabled", "1": "Conservative (stack, heap, mmap, VDSO)", "2": "Full (includes data segments)"}
CANARY_SYMBOLS = ("__stack_chk_fail", "__stack_chk_guard")
DANGEROUS = ("strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "strncpy", "strncat", "snprintf", "vsnprintf")
#: check: label when it is on, label when it is off
CHECKS = {
    "aslr": ("ASLR bypass (info leak required)", "ASLR disabled - fixed addresses"),
    "nx": ("NX bypass (ROP/JOP required)", "NX disabled - shellcode execution possible"),
    "canary": ("Stack canary bypass (leak or bruteforce)", "No stack canaries - direct buffer overflow"),
    "pie": ("PIE bypass (code base leak required)", "No PIE - fixed code addresses"),
}
RELRO = {"Full RELRO": (1.0, "GOT overwrite not possible"), "Partial RELRO": (0.5, "Limited GOT overwrite possible")}
NO_RELRO = "No RELRO - GOT overwrite possible"
#: in this order, which is not the score's
APPROACH = {
    "nx": "Build ROP chain for code execution",
    "aslr": "Find information leak to defeat ASLR",
    "canary": "Leak or bruteforce stack canary",
    "pie": "Leak code base address for PIE bypass",
}
NO_TECHNIQUES, NO_APPROACH = "Direct exploitation possible - minimal protections", "Standard buffer overflow exploitation"


def file_info(out: Column, compat: bool = False) -> Column:
    arch = F.when(contains_any(out, ("x86-64", "x86_64")), "x86_64").when(contains_any(out, ("i386", "80386")), "i386").when(out.contains("ARM"), "ARM").otherwise("unknown")
    kind = F.when(out.contains("ELF"), "ELF").when(out.contains("PE32"), "PE").otherwise("unknown")
    if compat:
        stripped = F.when(out.contains("stripped"), True)
    else:
        stripped = F.when(out.contains("not stripped"), False).when(out.contains("stripped"), True)
    return F.struct(strip(out).alias("file_output"), arch.alias("architecture"), kind.alias("format"), stripped.alias("stripped"))


def aslr(value: Column) -> Column:
    return F.struct(value.alias("value"), lookup(value, ASLR, "Unknown").alias("status"), (value != "0").alias("enabled"))


def nx(readelf_l: Column, compat: bool = False) -> Column:
    """The stack segment without E is not executable; its flags may stand on the next line."""
    rows = lines(readelf_l)
    at = F.array_position(F.transform(rows, lambda x: x.contains("GNU_STACK")), True)
    own = F.get(rows, (at - 1).cast("int"))
    flags = own if compat else F.concat(own, F.lit(" "), F.coalesce(F.get(rows, at.cast("int")), F.lit("")))
    on = F.when(at == 0, False).when(flags.contains("RWE"), False).otherwise(flags.contains("RW"))
    return F.struct(F.coalesce(on, F.lit(False)).alias("enabled"), F.coalesce(F.when(at > 0, strip(own)), F.lit("")).alias("stack_info"))


def canaries(objdump_t: Column, strings_out: Column) -> Column:
    found = listed(*(F.when(objdump_t.contains(s), s) for s in CANARY_SYMBOLS))
    related = F.filter(lines(strings_out), lambda x: F.lower(x).contains("stack") & (F.lower(x).contains("smash") | F.lower(x).contains("guard")))
    return F.struct((F.size(found) > 0).alias("enabled"), found.alias("symbols_found"), F.transform(related, strip).alias("related_strings"))


def pie(readelf_h: Column) -> Column:
    line = first_line_with(readelf_h, "Type:")
    return F.struct(F.coalesce(line.contains("DYN"), F.lit(False)).alias("enabled"), F.coalesce(strip(line), F.lit("")).alias("file_type"))


def relro_status(gnu_relro: Column, bind_now: Column) -> Column:
    return F.when(gnu_relro & bind_now, "Full RELRO").when(gnu_relro, "Partial RELRO").otherwise("No RELRO")


def relro(readelf_l: Column, readelf_d: Column) -> Column:
    has, now = get(readelf_l.contains("GNU_RELRO"), False), get(readelf_d.contains("BIND_NOW"), False)
    return F.struct(relro_status(has, now).alias("status"), has.alias("gnu_relro"), now.alias("bind_now"))


def fortify(objdump_t: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(objdump_t, F.lit("")), F.lit("(__[0-9A-Za-z_]+_chk)"), 1)))
    return F.struct((F.size(found) > 0).alias("enabled"), found.alias("fortified_functions"))


def symbols(nm_d: Column, compat: bool = False) -> Column:
    parts = F.transform(F.filter(lines(nm_d), lambda x: strip(x) != ""), lambda x: F.split(strip(x), r"\s+"))
    if compat:
        names = F.transform(F.filter(parts, lambda p: (F.size(p) >= 3) & (F.get(p, F.lit(1)) == "U")), lambda p: F.get(p, F.lit(2)))
    else:
        used = F.filter(parts, lambda p: (F.get(p, F.lit(0)) == "U") | (F.get(p, F.lit(1)) == "U"))
        names = F.transform(used, lambda p: F.substring_index(F.element_at(p, -1), "@", 1))
    risky = F.filter(names, lambda n: n.isin(*DANGEROUS))
    return F.struct(risky.alias("dangerous_functions_found"), F.size(names).cast("long").alias("total_imported_functions"), F.slice(names, 1, 10).alias("sample_imports"))


def libraries(ldd_out: Column) -> Column:
    found = F.transform(F.filter(lines(ldd_out), lambda x: x.contains("=>")), strip)
    return F.struct(found.alias("libraries"), F.size(found).cast("long").alias("count"))


def facts(binaries: DataFrame, compat: bool = False) -> DataFrame:
    """All facts of every binary; a tool text that is null makes its check fail (not protected)."""
    c = F.col
    return binaries.select(
        "binary_id", file_info(c("file_out"), compat).alias("file_info"), aslr(c("aslr_value")).alias("aslr_system"), nx(c("readelf_l"), compat).alias("nx_bit"),
        canaries(c("objdump_t"), c("strings_out")).alias("stack_canaries"), pie(c("readelf_h")).alias("pie"), relro(c("readelf_l"), c("readelf_d")).alias("relro"),
        fortify(c("objdump_t")).alias("fortify"), symbols(c("nm_d"), compat).alias("symbols"), libraries(c("ldd_out")).alias("dynamic_libs"),
    )


def flags(found: DataFrame) -> DataFrame:
    """facts() as the flat columns that score() takes; a failed check is off."""
    on = {"aslr": "aslr_system", "nx": "nx_bit", "canary": "stack_canaries", "pie": "pie"}
    return found.select("binary_id", *(get(F.col(f"{v}.enabled"), False).alias(k) for k, v in on.items()), get(F.col("relro.status"), "").alias("relro"))


def score(rows: DataFrame) -> DataFrame:
    """Adds level, difficulty, count, technique and area lists and the approach to rows with
    aslr, nx, canary, pie (boolean) and relro (text).  Null is off."""
    on = {c: get(F.col(c), False) for c in CHECKS}
    status = get(F.col("relro"), "")
    full = [(status.contains(name), points, label) for name, (points, label) in RELRO.items()]
    count = sum((F.when(v, 1.0).otherwise(0.0) for v in on.values()), F.lit(0.0))
    count = count + F.when(full[0][0], full[0][1]).when(full[1][0], full[1][1]).otherwise(0.0)
    relro_on = F.when(full[0][0], full[0][2]).when(full[1][0], full[1][2])
    techniques = listed(*(F.when(v, CHECKS[c][0]) for c, v in on.items()), relro_on)
    areas = listed(*(F.when(~v, CHECKS[c][1]) for c, v in on.items()), F.when(relro_on.isNull(), NO_RELRO))
    picks = listed(*(F.when(on[c], label) for c, label in APPROACH.items()))
    approach = F.when(F.size(techniques) == 0, NO_TECHNIQUES).when(F.size(picks) == 0, NO_APPROACH).otherwise(F.array_join(picks, " -> "))
    level = lambda high, medium, low: F.when(F.col("protection_count") >= 4, high).when(F.col("protection_count") >= 2, medium).otherwise(low)
    out = rows.withColumn("protection_count", count)
    return out.select("*", level("High", "Medium", "Low").alias("protection_level"), level("Hard", "Medium", "Easy").alias("exploit_difficulty"), techniques.alias("required_techniques"), areas.alias("vulnerable_areas"), approach.alias("recommended_approach"))


# Name of a protection, its column, its impact when it is on and when it is off.
PROTECTION_TABLE = (
    ("ASLR", "aslr", "Mitigated", "High risk - fixed addresses"),
    ("NX Bit", "nx", "ROP required", "High risk - shellcode execution"),
    ("Stack Canaries", "canary", "Leak required", "High risk - direct overflow"),
    ("PIE", "pie", "Code leak required", "Medium risk - fixed code base"),
)


def protection_rows(rows: DataFrame, key: str) -> DataFrame:
    """Five rows per binary: protection, status and impact."""
    entry = lambda n, s, i: F.struct(F.lit(n).alias("protection"), s.alias("status"), i.alias("impact"))
    items = [entry(n, F.when(get(F.col(c), False), "Enabled").otherwise("Disabled"), F.when(get(F.col(c), False), on).otherwise(off)) for n, c, on, off in PROTECTION_TABLE]
    items.append(entry("RELRO", get(F.col("relro"), "Unknown"), F.when(get(F.col("relro"), "").contains("No RELRO"), "GOT overwrite possible").otherwise("GOT protected")))
    return rows.select(key, F.inline(F.array(*items)))
