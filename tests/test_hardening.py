from itertools import product

from pyspark.sql import functions as F

from faultlens.operators import hardening as h


def plain_score(aslr, nx, canary, pie, relro):
    n = aslr + nx + canary + pie + {"Full RELRO": 1, "Partial RELRO": 0.5}.get(relro, 0)
    return n, "High" if n >= 4 else "Medium" if n >= 2 else "Low"


def test_score_over_every_combination(spark):
    rows = [(*c, r) for c in product([True, False], repeat=4) for r in ("Full RELRO", "Partial RELRO", "No RELRO")]
    df = h.score(spark.createDataFrame(rows, "aslr boolean, nx boolean, canary boolean, pie boolean, relro string"))
    got = df.collect()
    assert len(got) == 48
    for r in got:
        key = (r["aslr"], r["nx"], r["canary"], r["pie"], r["relro"])
        assert (r["protection_count"], r["protection_level"]) == plain_score(*key)
        assert len(r["required_techniques"]) + len(r["vulnerable_areas"]) == 5
        want = h.NO_TECHNIQUES if not r["required_techniques"] else " -> ".join(t for c, t in h.APPROACH.items() if r[c]) or h.NO_APPROACH
        assert r["recommended_approach"] == want


def test_failed_checks_are_off(spark):
    r = h.score(spark.createDataFrame([(None,) * 5], "aslr boolean, nx boolean, canary boolean, pie boolean, relro string")).first()
    assert r["protection_count"] == 0 and len(r["vulnerable_areas"]) == 5


NAMES = ("binary_id", "file_out", "readelf_l", "readelf_h", "readelf_d", "objdump_t", "strings_out", "nm_d", "ldd_out", "aslr_value")
FULL = (
    "a", " /bin/a: ELF 64-bit LSB, x86-64, not stripped\n", "  LOAD\n  GNU_STACK 0x0\n   0x0 0x0  RW  0x10\n  GNU_RELRO", "Class: ELF64\n  Type:  DYN (Shared)\n Type: EXEC", "(FLAGS) BIND_NOW",
    "__stack_chk_fail x __strcpy_chk __memcpy_chk __strcpy_chk", "*** stack smashing detected\n other\nStack Guard on", "                 U strcpy@GLIBC_2.2\n 0001 T main\n U puts\n w x\n", "\tlibc.so.6 => /lib/libc.so.6\n\tstatic", "2",
)


def facts(spark, *rows, compat=False):
    return h.facts(spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in NAMES)), compat).collect()


def test_facts(spark):
    (r,) = facts(spark, FULL)
    assert (r["file_info"]["architecture"], r["file_info"]["format"], r["file_info"]["stripped"]) == ("x86_64", "ELF", False)
    assert r["aslr_system"]["status"].startswith("Full") and r["aslr_system"]["enabled"]
    assert r["nx_bit"]["enabled"] and r["nx_bit"]["stack_info"] == "GNU_STACK 0x0"
    assert r["stack_canaries"]["symbols_found"] == ["__stack_chk_fail"] and len(r["stack_canaries"]["related_strings"]) == 2
    assert r["pie"]["enabled"] and r["relro"]["status"] == "Full RELRO"
    assert r["fortify"]["fortified_functions"] == ["__memcpy_chk", "__stack_chk", "__strcpy_chk"]
    assert r["symbols"]["dangerous_functions_found"] == ["strcpy"] and r["symbols"]["total_imported_functions"] == 2 and r["symbols"]["sample_imports"] == ["strcpy", "puts"]
    assert r["dynamic_libs"]["libraries"] == ["libc.so.6 => /lib/libc.so.6"] and r["dynamic_libs"]["count"] == 1


def test_compat_repeats_the_quirks(spark):
    (r,) = facts(spark, FULL, compat=True)
    assert r["file_info"]["stripped"] is True and not r["nx_bit"]["enabled"] and r["symbols"]["total_imported_functions"] == 0


def test_missing_texts_and_flags(spark):
    empty = facts(spark, ("b", *(None,) * 9), ("c", *("",) * 9))
    assert not any(r["nx_bit"]["enabled"] or r["pie"]["enabled"] or r["fortify"]["enabled"] for r in empty)
    df = h.facts(spark.createDataFrame([FULL, ("b", *(None,) * 9)], ", ".join(f"{n} string" for n in NAMES)))
    scored = {r["binary_id"]: r for r in h.score(h.flags(df)).collect()}
    assert scored["a"]["protection_count"] == 5 and scored["b"]["protection_count"] == 0


def test_executable_stack(spark):
    (r,) = facts(spark, (*FULL[:2], "  GNU_STACK  0x0  RWE 0x10", *FULL[3:]))
    assert not r["nx_bit"]["enabled"]


def test_protection_rows(spark):
    df = spark.createDataFrame([(1, True, None, False, True, None)], "id long, aslr boolean, nx boolean, canary boolean, pie boolean, relro string")
    rows = {r["protection"]: (r["status"], r["impact"]) for r in h.protection_rows(df, "id").collect()}
    assert rows["ASLR"] == ("Enabled", "Mitigated") and rows["NX Bit"][0] == "Disabled" and rows["RELRO"] == ("Unknown", "GOT protected")
    assert df.select(F.lit(1)).count() == 1
