import json

import pytest
from pyspark.sql import functions as F

from faultlens.functions import semistructured as js
from faultlens.functions import text as tx
from faultlens.operators import hardening, metrics, records, triage
from faultlens.plans import report
from faultlens.sources import corpus, files
from faultlens.streaming import incremental

ANSWERS = ['{"a": 1}', 'text {"a": {"b": 2}} more', '{"a":1} {"b":2}', "{ open", "} {", "none", '{"a":1} x }', "{'a':1}", "", None, '{"vulnerability_type": "format_string", "confidence": 1}', '{"a":1}{']


def loads(text):
    body = text[text.find("{") : text.rfind("}") + 1] if text and 0 <= text.find("{") < text.rfind("}") else ""
    try:
        return json.loads(body) is not None
    except ValueError:
        return False


def test_only_strict_json_is_a_record(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "id long, response string")
    for r in records.extract(df).collect():
        assert (r["json"] is not None) == loads(ANSWERS[r["id"]]) == (r["error"] is None)
        if r["id"] == 10:
            assert r["record"]["vulnerability_type"] == "format_string" and r["record"]["confidence"] == 1.0


@pytest.mark.parametrize("text", ['{"a":1}', '{"a":1}{', "{'a':1}", "", " ", "1", "[1,2]", '{"a":', "null"])
def test_gate(spark, text):
    try:
        want = bool(text.strip()) and (json.loads(text), True)[1]
    except ValueError:
        want = False
    assert spark.createDataFrame([(text,)], "t string").select(js.is_json(F.col("t"))).first()[0] == want


def test_fenced_blocks(spark):
    cases = ["x\n```python\na = 1\n```\n", "```\nfirst\n```\n```python\nsecond\n```", "```\n only \n```", "no block", "```python no end"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(js.fenced(F.col("t"))).collect()] == ["a = 1", "second", "only", "", ""]


def test_labels_and_classes(spark):
    df = spark.createDataFrame([("format_string", "Low"), ("other", "Unknown"), (None, None)], "k string, l string")
    got = df.select(records.valid_label(F.col("k")), records.delivery(F.col("k")), records.strategy(F.col("l"))).collect()
    assert [r[0] for r in got] == ["format_string", "unknown", "unknown"]
    assert [r[1] for r in got] == ["format_string_exploitation", "file_based", "file_based"] and got[2][2] == records.NO_STRATEGY


def test_text_functions(spark):
    df = spark.createDataFrame([(" \tab\n", 0.955, "/x/y.c")], "t string, p double, f string")
    got = df.select(tx.strip(F.col("t")), tx.percent(F.lit(0.125)), tx.percent_text(F.col("p"), 1), tx.basename(F.col("f")), tx.hex_escapes(F.lit(b"A\xff")), tx.preview(F.lit("abc"), 2), tx.title(F.lit("use_after_free"))).first()
    assert tuple(got) == ("ab", 12.0, "95.5%", "y.c", "\\x41\\xff", "ab...", "Use After Free")


def test_corpus_and_documents(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in {"id:000000,sig:11": b"AAAA", "id:000001": b"", "README.txt": b"no", "seed1": b"TEST\n", "sub/id:9": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    path = f"{tmp_path}/in"
    assert {(r["file"], r["size"]) for r in corpus.corpus(spark, path, content=False).collect()} == {("id:000000,sig:11", 4), ("id:000001", 0), ("seed1", 5)}
    assert corpus.corpus(spark, path, recursive=True).count() == 4
    assert files.latest(corpus.corpus(spark, path, glob="id*")).first()["file"] == "id:000001"
    assert files.first_directory(spark, [f"{tmp_path}/absent", path]).first()["file"] == "id:000001"
    assert files.first_directory(spark, [f"{tmp_path}/absent"]).count() == 0
    (tmp_path / "d.json").write_text('{"confidence": 0.5,\n "severity": "High"}')
    (tmp_path / "bad.json").write_text("{'x': 1}")
    read = lambda p: files.json_document(spark, f"{tmp_path}/{p}", records.CLASSIFICATION).first()
    assert (read("d.json")["confidence"], read("d.json")["severity"]) == (0.5, "High")
    assert set(read("bad.json")) == {None} and set(read("absent.json")) == {None}
    assert files.whole_text(spark, f"{tmp_path}/bad.json").first()[0] == "{'x': 1}"


def test_report_lines_and_metrics(spark, tmp_path):
    crashes = spark.createDataFrame([("a", 3, "got SIGABRT"), ("b", 1, "got SIGABRT"), ("c", 2, "fine")], "file string, size long, stdout string")
    groups = triage.ranked(triage.groups(crashes)).withColumn("target_id", F.lit(1))
    summary = triage.summary(crashes).withColumn("target_id", F.lit(1))
    scores = hardening.score(spark.createDataFrame([(1, True, False, False, False, "No RELRO")], "target_id int, aslr boolean, nx boolean, canary boolean, pie boolean, relro string"))
    found = spark.createDataFrame([(1, "format_string", "High", 0.95, None)], "target_id int, vulnerability_type string, severity string, confidence double, likelihood string").withColumns({"attack_vector": F.lit("file"), "impact": F.lit(None).cast("string"), "technical_details": F.lit(None).cast("string")})
    made = metrics.artifact_status(spark.createDataFrame([(1, "x.json", "Crash triage results")], "target_id int, file string, description string"), spark.createDataFrame([("x.json",)], "file string"), "file")
    lines = report.report(summary, groups, scores, found, made)
    files.write_lines(lines.select("section", "line_no", "line"), f"{tmp_path}/r")
    (part,) = list((tmp_path / "r").glob("part-*"))
    text = part.read_text().split("\n")
    assert text[:3] == ["# Security Report", "**Total Crashes:** 3", "**Unique Crash Frames:** 2"]
    assert "**Exploitability:** 95% confidence" in text and "### Crash Group 1: SIGABRT (abort signal) (2 crashes, b)" in text and "x.json | Crash triage results | Generated" in text
    assert [x for x in text if x.startswith("**Attack Vector") or x.startswith("**Impact") or x.startswith("**Technical")] == ["**Attack Vector:** file", "**Impact:** Unknown", "**Technical Details:** Not available"]
    two = lines.unionByName(lines.withColumn("target_id", F.lit(2)))
    files.write_lines(two, f"{tmp_path}/two")
    assert all((next((tmp_path / "two" / f"target_id={k}").glob("part-*"))).read_text().split("\n") == text for k in (1, 2))
    assert report.report(summary, groups, scores, found.limit(0), made).where("section = 2").count() == 0
    row = metrics.metrics(summary.select("target_id"), summary, scores, found.withColumns({"generated": F.lit(None).cast("boolean"), "has_strategy": F.lit(True)})).first()
    assert (row["confidence"], row["protection_level"], row["poc_generated"], row["strategy_available"]) == (95.0, "Low", False, True)
    assert len(metrics.stamped(summary.select("target_id")).first()["analysis_timestamp"]) == 19
    assert [r["value"] for r in metrics.series(spark.createDataFrame([row])).collect()] == [3, 2, 5]


def test_streaming_counts_go_on_from_the_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"file":"a","stdout":"got SIGABRT"}\n{"file":"b","stdout":"fine"}\n')

    def run():
        counts = incremental.running_counts(incremental.crash_stream(spark, f"{tmp_path}/in", "file string, stdout string"))
        incremental.start(counts, f"{tmp_path}/ck", f"{tmp_path}/out").awaitTermination()
        return {r["frame"]: r["cnt"] for r in incremental.current(spark, f"{tmp_path}/out").collect()}

    assert run() == {"SIGABRT (abort signal)": 1, "UNKNOWN_CRASH": 1}
    (tmp_path / "in" / "2.json").write_text('{"file":"c","stdout":"got SIGABRT"}\n')
    assert run() == {"SIGABRT (abort signal)": 2, "UNKNOWN_CRASH": 1}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"file":"a","stdout":"fine"}')
    for k in range(2):  # a lost checkpoint makes the same batch run twice
        counts = incremental.crash_stream(spark, f"{tmp_path}/in", "file string, stdout string")
        incremental.start(counts, f"{tmp_path}/ck{k}", f"{tmp_path}/out", "append").awaitTermination()
    assert incremental.current(spark, f"{tmp_path}/out", "append").count() == 1


def test_a_callers_model_and_json_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "yy")], "id long, context string")
    got = records.classify(df, lambda texts: [f'{{"n": {len(t)}}}' for t in texts]).collect()
    assert {r["id"]: (r["response"], r["error"]) for r in got} == {1: ('{"n": 1}', None), 2: ('{"n": 2}', None)}
    rows = spark.createDataFrame([(1, 5, None)], "target_id long, total_crashes long, severity string")
    assert metrics.as_json(rows).first()["json"] == '{"total_crashes":5}'
    assert tuple(df.select(tx.first_index(F.lit("a{b{"), "{"), tx.last_index(F.lit("a{b{c"), "{"), tx.last_index(F.lit("abc"), "{"), tx.last_index(F.lit("xabcabcx"), "abc"), tx.with_extension(F.lit("r.json"), ".json", ".md")).first()) == (1, 3, -1, 4, "r.md")


def test_windows_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, stdout string"

    def run():
        counts = incremental.windowed_counts(incremental.crash_stream(spark, f"{tmp_path}/in", schema), "ts")
        incremental.start(counts, f"{tmp_path}/ck", f"{tmp_path}/out", "append").awaitTermination()
        return sorted((r["start"].minute, r["frame"], r["cnt"]) for r in spark.read.schema("start timestamp, frame string, cnt long").parquet(f"{tmp_path}/out").collect())

    rows = [("10:01", "fine"), ("10:02", "got SIGABRT"), ("10:03", "fine"), ("11:30", "fine")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t}:00.000Z", "stdout": s}) for t, s in rows))
    run()
    (tmp_path / "in" / "2.json").write_text(json.dumps({"ts": "2024-01-01T10:04:00.000Z", "stdout": "fine"}))  # too late
    assert run() == [(0, "SIGABRT (abort signal)", 1), (0, "UNKNOWN_CRASH", 2)]


def test_answers_stay_and_errors_are_rows(spark, tmp_path):
    """A second call asks for what failed alone; equal prompts are asked once; a batch that raises or miscounts has errors."""
    df = spark.createDataFrame([(1, "x"), (2, "yy"), (3, "x"), (4, None), (5, "bad")], "id long, context string").coalesce(1)
    log = f"{tmp_path}/log"

    def answer(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    def asked():
        with open(log) as f:
            return sorted(f.read().split("\n")[:-1])

    cache = f"{tmp_path}/cache"
    rows = lambda out: {r["id"]: (r["response"], r["error"]) for r in out.collect()}
    first = rows(records.classify(df, answer, batch=1, cache=cache))
    assert first == {1: ("X", None), 2: ("YY", None), 3: ("X", None), 4: ("", None), 5: (None, "ValueError: no")}
    assert asked() == ["", "bad", "x", "yy"]
    assert rows(records.classify(df, answer, batch=1, cache=cache)) == first and asked() == ["", "bad", "bad", "x", "yy"]
    short = rows(records.classify(df, lambda texts: texts[:1], batch=64))
    assert all(r == (None, "ValueError: 1 answers to 4 prompts") for r in short.values())


def test_fields_that_no_schema_has(spark):
    texts = ['ok {"severity": "High", "extra": {"a": [1, null, {"b": "c"}]}, "n": 1.5, "z": null} end', '{"n": 1, "n": 2}', "{broken", None, '{"confidence": 1}']
    found = records.extract(spark.createDataFrame(list(enumerate(texts)), "id long, response string"))
    got = sorted(tuple(r) for r in records.other_fields(found).collect())
    assert got == [(0, "extra", "object", '{"a":[1,null,{"b":"c"}]}'), (0, "n", "number", "1.5"), (0, "z", "null", "null")]
    j = F.col("json")
    typed = found.select("id", records.field(j, "$.extra.a[2].b", "string", "-").alias("b"), records.field(j, "$.n", "double", 0.0).alias("n")).collect()
    assert {r["id"]: (r["b"], r["n"]) for r in typed} == {0: ("c", 1.5), 1: ("-", 0.0), 2: ("-", 0.0), 3: ("-", 0.0), 4: ("-", 0.0)}


def test_groups_grow_batch_by_batch_and_a_replay_changes_nothing(spark, tmp_path):
    schema, rows = "file string, size long, stdout string", [("a", 5, "got SIGABRT"), ("b", 3, "fine"), ("c", 2, "got SIGABRT"), ("d", 2, "got SIGABRT"), ("e", 1, "fine")]
    (tmp_path / "in").mkdir()

    def run(checkpoint):
        groups = incremental.running_groups(incremental.crash_stream(spark, f"{tmp_path}/in", schema))
        incremental.start(groups, f"{tmp_path}/{checkpoint}", f"{tmp_path}/out", "update").awaitTermination()
        return sorted(tuple(r) for r in incremental.current(spark, f"{tmp_path}/out", "update").select("frame", "cnt", "file", "size").collect())

    for k in range(1, 4):
        part = rows[: 2 * k][2 * k - 2 :]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("file", "size", "stdout"), r, strict=True))) for r in part))
        so_far = spark.createDataFrame(rows[: 2 * k], schema)
        want = sorted(tuple(r) for r in triage.groups(so_far).select("frame", "cnt", "file", "size").collect())
        assert run("ck") == want
    assert run("ck") == want  # nothing new
    assert run("other") == want  # all once more, as the first batch


def test_reports_by_many_tasks(spark, tmp_path):
    """Lines over several files, targets over several files and several targets in one; bytes are read by offset."""
    lines = [(t, s, n, f"{t}-{s}-{n} é" + ("\nmore" if n == 3 else "")) for t in (1, 2, 3) for s in (2, 1) for n in range(1 if t == 2 else 400)]
    df = spark.createDataFrame(lines, "target_id long, section int, line_no long, line string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = files.write_report(df, f"file://{tmp_path}/r")
        got = sorted((r["target_id"], r["n"], r["line"]) for r in files.read_report(index).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, n = [], {}
    for t, _, _, line in sorted(lines):
        for x in line.split("\n"):
            n[t] = n.get(t, 0) + 1
            want.append((t, n[t], x))
    assert got == want
    written = sorted((tmp_path / "r").glob("part-*.md"))
    assert len(written) >= 4 and "".join(f.read_text() for f in written) == "".join(f"{x}\n" for _, _, x in want)
    assert index.where("target_id = 1").count() > 1


def test_sections_that_are_guarded(spark):
    """Reviews and remediation stand between protections and groups, and only the lines whose fields are there."""
    reviews = spark.createDataFrame([(1, "f", None, None, ["gets"]), (2, None, "r", "s", None)], "target_id int, vulnerable_function string, root_cause string, attack_surface string, dangerous_functions array<string>")
    patches = spark.createDataFrame([(1, ["a", "b"], "x;", []), (2, None, None, ["l"])], "target_id int, immediate_fixes array<string>, corrected_code_snippet string, long_term_recommendations array<string>")
    lines = lambda df, k: [r["line"] for r in df.where(f"target_id = {k}").orderBy("line_no").collect()]
    assert lines(report.reviewed(reviews), 1) == ["### Source Code Analysis", "**Vulnerable Function:** `f`", "**Root Cause:** Unknown", "**Attack Surface:** Unknown", "**Dangerous Functions Detected:**", "- `gets`"]
    assert lines(report.reviewed(reviews), 2)[1:] == ["**Vulnerable Function:** `Unknown`", "**Root Cause:** r", "**Attack Surface:** s"]
    assert lines(report.remediation(patches), 1) == ["## Remediation Strategy", "### Immediate Actions Required", "1. **a**", "1. **b**", "### Code Fix Example", "```c", "x;", "```"]
    assert lines(report.remediation(patches), 2) == ["## Remediation Strategy", "### Immediate Actions Required", "### Long-term Security Improvements", "- l"]
