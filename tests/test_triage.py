import pytest
from pyspark.sql import functions as F

from faultlens.functions.signature import signature, stable_signature
from faultlens.operators import byteprofile, ranking, triage
from faultlens.sources import shared

CASES = {
    "Program TIMEOUT #0  0x1 in f () ": "TIMEOUT",
    "#0  0x40119b in vuln (input=0x7f) at vuln.c:8": "#0 0x40119b in vuln at vuln.c:8",
    "#0  0x41 in ?? ()": "#0 0x41 in ??",
    "#0  vuln () at v.c:1\n#1  0x42 in main () at v.c:9": "#1 0x42 in main at v.c:9",
    "SIGSEGV\n0x42 in handler": "SIGSEGV at 0x42 in handler",
    "Segmentation fault": "SIGSEGV (stack corruption)",
    "got SIGABRT": "SIGABRT (abort signal)",
    "fine": "UNKNOWN_CRASH",
    "": "UNKNOWN_CRASH",
    None: "UNKNOWN_CRASH",
    "#0  0x4A in f ()": "UNKNOWN_CRASH",
    "#0  0x4a in f (g(1)) at a.c:1": "#0 0x4a in f",
}


def crashes(spark, rows):
    return spark.createDataFrame(rows, "file string, path string, size long, stdout string, stderr string")


def test_signature_branches(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "stdout string").select("stdout", signature(F.col("stdout")).alias("s"))
    assert {r[0]: r[1] for r in df.collect()} == CASES


def test_stable_signature_joins_addresses(spark):
    df = spark.createDataFrame([("#0  0x1 in f () at a.c:3",), ("#2  0x9 in f () at a.c:3",), ("got SIGABRT",)], "t string")
    assert [r[0] for r in df.select(stable_signature(F.col("t"))).collect()] == ["f@a.c:3", "f@a.c:3", "SIGABRT (abort signal)"]


def test_groups_ranks_and_members(spark):
    rows = [(f"id:{k:03}", f"/c/id:{k:03}", 10 - k % 3, "got SIGABRT" if k % 2 else "Segmentation fault" if k % 3 else "fine", "") for k in range(12)]
    df = crashes(spark, rows)
    ranked = triage.ranked(triage.groups(df)).orderBy("rnk").collect()
    assert [r["rnk"] for r in ranked] == [1, 2, 3] and sum(r["cnt"] for r in ranked) == 12
    assert ranked[0]["frame"] == "SIGABRT (abort signal)" and (ranked[0]["size"], ranked[0]["file"]) == (8, "id:005")
    assert [tuple(r) for r in triage.top(df, 2).select("rnk", "frame", "cnt").collect()] == [(r["rnk"], r["frame"], r["cnt"]) for r in ranked[:2]]
    assert triage.summary(df).first().asDict() == {"total_crashes": 12, "unique_crash_frames": 3}
    assert triage.members(df).where("place = 1").count() == 3
    assert [r["status"].split()[0] for r in triage.status(df).orderBy("rnk").collect()] == ["Primary", "Secondary", "Secondary"]


def test_no_crashes(spark):
    df = crashes(spark, [])
    assert triage.ranked(triage.groups(df)).collect() == [] and triage.top(df).collect() == []
    assert triage.summary(df).first().asDict() == {"total_crashes": 0, "unique_crash_frames": 0}


def test_backtraces(spark):
    df = crashes(spark, [("a", "/a", 1, "#0  0x1 in f () \n#1  0x2 in g () at x.c:2\n#2  0x3 in main () ", "")])
    assert [(r["depth"], r["frame"]) for r in triage.backtraces(df, 2).collect()] == [(0, "#0  0x1 in f"), (1, "#1  0x2 in g")]


@pytest.mark.parametrize("content", [b"", b"abc", b"AAAABBBBAAAA", b"\x00\xff" * 7, bytes(range(256)), b"A" * 51, b"\t" * 5])
def test_chunks_and_printable_share(spark, content):
    df = spark.createDataFrame([(1, bytearray(content))], "id long, content binary")
    whole = {content[i : i + 4]: 0 for i in range(0, len(content) - 3, 4)}
    for i in range(0, len(content) - 3, 4):
        whole[content[i : i + 4]] += 1
    assert {bytes(r["chunk"]): r["n"] for r in byteprofile.chunk_counts(df).collect()} == whole
    best = sorted(whole.items(), key=lambda x: (-x[1], [-b for b in x[0]]))[:3]
    assert [(r["chunk"], r["n"]) for r in byteprofile.top_chunks(df).orderBy("rnk").collect()] == [(c.hex(), n) for c, n in best if n > 1]
    if content.isascii():
        size, count, pct = byteprofile.nonprintable(F.decode("content", "UTF-8"))
        got = df.select(size, count, pct).first()
        bad = sum(not 32 <= b <= 126 for b in content)
        assert tuple(got) == (len(content), bad, (bad * 1000 // len(content)) / 10 if content else None)


def test_byte_matches_are_true_and_hex_matches_are_not(spark):
    df = spark.createDataFrame([(bytearray(b"\t" * 5),), (bytearray(b"x\x90\x90\x90\x90"),)], "content binary")
    c, needle = F.col("content"), b"\x90" * 4
    assert [tuple(r) for r in df.select(byteprofile.has_bytes(c, needle), byteprofile.has_hex(c, needle)).collect()] == [(False, True), (True, True)]
    assert [r[0] for r in df.select(byteprofile.looks_textual(c)).collect()] == [True, False]


@pytest.mark.parametrize("kind", ["one frame", "singletons", "nulls"])
def test_places_of_hot_groups(spark, kind, monkeypatch):
    """Nine rows in ten in one frame, or frames of one crash each: places as by plain sorting, and no partition holds much more than its share."""
    rows = [(f"f{k:05}", None if kind == "nulls" and k % 7 == 0 else k * 7919 % 101, "hot" if kind == "one frame" and k % 10 else f"g{k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "file string, size long, g string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    tables, real = [], shared.written
    monkeypatch.setattr(ranking.shared, "written", lambda d, name: tables.append(real(d, name)) or tables[-1])
    try:
        got = {(r["g"], r["file"]): r["place"] for r in ranking.placed(df, ["g"], [F.col("size"), F.col("file")]).collect()}
        counted = df.groupBy(F.col("g").alias("frame")).agg(F.count("*").alias("cnt"))
        ranks = sorted((r["rnk"], r["cnt"], r["frame"]) for r in triage.ranked(counted).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, seen = {}, {}
    for file, _, g in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[0])):
        seen[g] = want[g, file] = seen.get(g, 0) + 1
    assert got == want
    per = [r["count"] for r in tables[0].groupBy("__part").count().collect()]
    assert len(per) >= 12 and max(per) < 3 * 4000 / 16
    assert [r[0] for r in ranks] == list(range(1, len(ranks) + 1)) and ranks == sorted(ranks, key=lambda r: (-r[1], r[2]))


def test_places_of_nothing_and_of_null_groups(spark):
    assert ranking.placed(spark.createDataFrame([], "g string, x long"), ["g"], [F.col("x")]).collect() == []
    rows = [(None, 3), (None, 1), ("a", 2), ("", 5), ("", 4)]
    got = ranking.placed(spark.createDataFrame(rows, "g string, x long"), ["g"], [F.col("x")]).collect()
    assert sorted((r["g"] or "-", r["x"], r["place"]) for r in got if r["g"] != "") == [("-", 1, 1), ("-", 3, 2), ("a", 2, 1)]
    assert sorted((r["x"], r["place"]) for r in got if r["g"] == "") == [(4, 1), (5, 2)]
