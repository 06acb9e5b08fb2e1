"""Queries over the driver's tables, each with its SQL.

The tables hold no crash logs, so inputs of the operators are projections of them, made by
one SQL expression that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions import semistructured as js
from faultlens.functions import text as tx
from faultlens.functions.signature import ADDRESS, FRAME
from faultlens.operators import byteprofile, byteranges, elf, hardening, metrics, records, triage
from faultlens.plans import report
from faultlens.sources import corpus, documents, files, shared
from faultlens.streaming import incremental

# One row per event; the text is what a debugger would have printed for its type.
CRASHES = """
SELECT concat('id:', CAST(event_id AS STRING)) AS file, CAST(floor(value * 10) AS BIGINT) AS size,
  CASE WHEN user_id % 50 = 7 THEN 'TIMEOUT'
       WHEN event_type = 'error' THEN concat('#0  0x', lower(hex(4096 + event_id % 31)), ' in fn_', CAST(event_id % 13 AS STRING), ' (n=1) at mod_', CAST(event_id % 3 AS STRING), '.c:', CAST(event_id % 17 AS STRING), ' x', repeat(concat(chr(10), '#1  0x2a in caller (m=2) at main.c:5'), CAST(event_id % 14 AS INT)))
       WHEN event_type = 'view' THEN concat('#1  0x', lower(hex(8192 + event_id % 11)), ' in main () ')
       WHEN event_type = 'click' THEN concat('received SIGSEGV, 0x', lower(hex(64 + user_id % 5)), ' in handler')
       WHEN event_type = 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'Segmentation fault' ELSE 'SIGABRT' END
       ELSE 'exited' END AS stdout
FROM events
"""
FLAGS = "SELECT p_partkey, p_size % 2 = 0 AS aslr, p_partkey % 3 = 0 AS nx, p_size % 5 < 2 AS canary, p_partkey % 7 < 3 AS pie, CASE p_partkey % 4 WHEN 0 THEN 'Full RELRO' WHEN 1 THEN 'Partial RELRO' ELSE 'No RELRO' END AS relro FROM part"
RISKY = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS protection_level, CASE p_partkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Low' END AS severity, CASE p_size % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS likelihood FROM part"
ANSWERS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN concat('Answer: ', props, ' done') WHEN 1 THEN concat(props, props) WHEN 2 THEN replace(props, '}', '') WHEN 3 THEN 'none' WHEN 4 THEN concat('{''k'': ', CAST(event_id AS STRING), '}') ELSE props END AS response FROM events"


class Tables:
    """The driver's tables as views of a session, and projections of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        table = query.rsplit("FROM", 1)[1].split()[0]
        plain = query.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(plain.replace(f"FROM {table}", "FROM {t}"), t=getattr(self, table))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[name] = sql
        return f

    return keep


# The signature cascade once more, as SQL.
_X = f"regexp_extract(stdout, '{FRAME}', {{}})"
_P = [_X.format(k) for k in range(6)]
_A = f"regexp_extract(stdout, '{ADDRESS}', {{}})"
FRAMES_SQL = rf"""c AS ({CRASHES.replace('AS STRING', 'AS VARCHAR')}),
f AS (SELECT *, CASE WHEN contains(stdout, 'TIMEOUT') THEN 'TIMEOUT'
  WHEN {_P[1]} <> '' AND {_P[4]} <> '' THEN concat('#', {_P[1]}, ' 0x', {_P[2]}, ' in ', {_P[3]}, ' at ', {_P[4]}, ':', {_P[5]})
  WHEN {_P[1]} <> '' THEN concat('#', {_P[1]}, ' 0x', {_P[2]}, ' in ', {_P[3]})
  WHEN contains(stdout, 'SIGSEGV') OR contains(stdout, 'Segmentation fault') THEN CASE WHEN {_A.format(1)} <> '' THEN concat('SIGSEGV at 0x', {_A.format(1)}, ' in ', {_A.format(2)}) ELSE 'SIGSEGV (stack corruption)' END
  WHEN contains(stdout, 'SIGABRT') THEN 'SIGABRT (abort signal)' ELSE 'UNKNOWN_CRASH' END AS frame FROM c),
g AS (SELECT frame, count(*) AS cnt, arg_min({{'file': file, 'size': size}}, {{'a': size, 'b': file}}) AS m FROM f GROUP BY frame),
r AS (SELECT frame, cnt, m.file AS file, m.size AS size, row_number() OVER (ORDER BY cnt DESC, frame) AS rnk FROM g)"""
FLAGS_SQL, RISKY_SQL, ANSWERS_SQL = FLAGS, RISKY, ANSWERS.replace("AS STRING", "AS VARCHAR")


@query(f"WITH {FRAMES_SQL} SELECT rnk, frame, cnt, file, size FROM r")
def triage_groups(t: Tables) -> DataFrame:
    return triage.ranked(triage.groups(t.sql(CRASHES))).select("rnk", "frame", "cnt", "file", "size")


@query(f"WITH {FRAMES_SQL} SELECT CAST(sum(cnt) AS BIGINT) AS total_crashes, count(*) AS unique_crash_frames FROM g")
def triage_summary(t: Tables) -> DataFrame:
    return triage.summary(t.sql(CRASHES))


@query(f"WITH {FRAMES_SQL} SELECT rnk, frame, cnt, file, size FROM r WHERE rnk <= 5")
def triage_top5(t: Tables) -> DataFrame:
    return triage.top(t.sql(CRASHES), 5).select("rnk", "frame", "cnt", "file", "size")


@query(f"WITH {FRAMES_SQL} SELECT concat(substr(frame, 1, 50), '...') AS label, cnt FROM r WHERE rnk <= 3")
def triage_top3_labels(t: Tables) -> DataFrame:
    return triage.top(t.sql(CRASHES), 3).select(tx.preview(F.col("frame"), 50).alias("label"), "cnt")


@query(f"WITH {FRAMES_SQL} SELECT frame, cnt, file FROM r WHERE rnk = 1")
def primary_group(t: Tables) -> DataFrame:
    return triage.top(t.sql(CRASHES), 1).select("frame", "cnt", "file")


@query(f"WITH {FRAMES_SQL} SELECT frame, file, size, row_number() OVER (PARTITION BY frame ORDER BY size, file) AS place FROM f")
def triage_members(t: Tables) -> DataFrame:
    return triage.members(t.sql(CRASHES))


@query(f"WITH {FRAMES_SQL} SELECT rnk, frame, cnt, file, size, CASE WHEN rnk = 1 THEN 'Primary crash analyzed' ELSE 'Secondary crash (not fully analyzed)' END AS status FROM r")
def group_status(t: Tables) -> DataFrame:
    return triage.status(t.sql(CRASHES))


@query(rf"""WITH {FRAMES_SQL} SELECT CASE WHEN NOT contains(stdout, 'TIMEOUT') AND {_P[1]} <> '' THEN concat({_P[3]}, CASE WHEN {_P[4]} <> '' THEN concat('@', {_P[4]}, ':', {_P[5]}) ELSE '' END) ELSE frame END AS frame, count(*) AS cnt FROM f GROUP BY 1""")
def stable_groups(t: Tables) -> DataFrame:
    return triage.groups(t.sql(CRASHES), stable=True).select("frame", "cnt")


@query(rf"""WITH {FRAMES_SQL}, a AS (SELECT file, regexp_extract_all(stdout, '(#[0-9]+\s+0x[0-9a-f]+ in [^\s]+ )', 1) AS fs FROM c)
SELECT file, CAST(unnest(range(0, len(fs[1:10]))) AS BIGINT) AS depth, rtrim(unnest(fs[1:10])) AS frame FROM a""")
def backtrace_frames(t: Tables) -> DataFrame:
    return triage.backtraces(t.sql(CRASHES))


def contents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 4),
k AS (SELECT doc_id, unnest([substr(h, CAST(i * 8 + 1 AS BIGINT), 8) for i in range(0, length(h) // 8)]) AS chunk FROM h),
n AS (SELECT doc_id, chunk, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, chunk DESC) AS rnk FROM n)
SELECT doc_id, rnk, lower(chunk) AS chunk, n FROM r WHERE rnk <= 3 AND n > 1""")
def byte_chunks_top3(t: Tables) -> DataFrame:
    return byteprofile.top_chunks(contents(t), "doc_id")


@query("""WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, octet_length(encode(text)) - length(regexp_replace(text, '[^ -~]', '', 'g')) AS np FROM documents)
SELECT doc_id, size, CAST(np AS BIGINT) AS nonprintable, CASE WHEN size > 0 THEN CAST(np * 1000 // size AS DOUBLE) / 10.0::DOUBLE END AS pct FROM s""")
def nonprintable_ratio(t: Tables) -> DataFrame:
    size, count, pct = byteprofile.nonprintable(F.col("text"))
    return t.documents.select("doc_id", size.alias("size"), count.alias("nonprintable"), pct.alias("pct"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines, array_to_string(string_split(text, chr(10))[1:10], '|') AS first_lines FROM documents")
def line_stats(t: Tables) -> DataFrame:
    head = F.array_join(F.slice(tx.lines(F.col("text")), 1, 10), "|")
    return t.documents.select("doc_id", tx.newlines(F.col("text")).cast("long").alias("newlines"), head.alias("first_lines"))


@query("SELECT doc_id, lower(substr(hex(encode(text)), 1, 320)) AS dump FROM documents")
def byte_preview(t: Tables) -> DataFrame:
    return contents(t).select("doc_id", byteprofile.dump(F.col("content")).alias("dump"))


@query("SELECT doc_id, contains(text, 'License') AS has_bytes, contains(hex(encode(text)), '4C6963656E7365') AS has_hex, doc_id % 5 <> 0 AND NOT contains(text, chr(0)) AS textual FROM documents")
def pattern_flags(t: Tables) -> DataFrame:
    """Every fifth content has half a character at its end, which no text has."""
    c = F.col("content")
    half = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\xe2\x82")).otherwise(F.lit(b""))
    return contents(t).select("doc_id", F.concat(c, half).alias("content")).select("doc_id", byteprofile.has_bytes(c, b"License").alias("has_bytes"), byteprofile.has_hex(c, b"License").alias("has_hex"), byteprofile.looks_textual(c).alias("textual"))


@query("WITH p AS (SELECT url, CASE WHEN contains(url, '/a') THEN 0 WHEN contains(url, '/b') THEN 1 ELSE 2 END AS prio FROM pages) SELECT max(url) AS url FROM p WHERE prio = (SELECT min(prio) FROM p)")
def largest_path_first_dir(t: Tables) -> DataFrame:
    prio = F.when(F.col("url").contains("/a"), 0).when(F.col("url").contains("/b"), 1).otherwise(2)
    return t.pages.agg(F.max_by("url", F.struct((-prio).alias("p"), "url")).alias("url"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, string_split(url, '/')[-1] AS base FROM pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), tx.basename(F.col("url")).alias("base"))


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))), ',') AS tags, CAST(len(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS BIGINT) AS n FROM pages")
def all_tags_distinct(t: Tables) -> DataFrame:
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)))
    return t.pages.select("page_id", F.array_join(tags, ",").alias("tags"), F.size(tags).cast("long").alias("n"))


_N = "CAST(CAST(aslr AS INT) + CAST(nx AS INT) + CAST(canary AS INT) + CAST(pie AS INT) AS DOUBLE) + CASE relro WHEN 'Full RELRO' THEN 1.0::DOUBLE WHEN 'Partial RELRO' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"""WITH f AS ({FLAGS_SQL}), s AS (SELECT *, {_N} AS n FROM f)
SELECT p_partkey, n AS protection_count, CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END AS protection_level, CASE WHEN n >= 4 THEN 'Hard' WHEN n >= 2 THEN 'Medium' ELSE 'Easy' END AS exploit_difficulty FROM s""")
def hardening_score(t: Tables) -> DataFrame:
    return hardening.score(t.sql(FLAGS)).select("p_partkey", "protection_count", "protection_level", "exploit_difficulty")


def _labels(on: bool) -> str:
    cases = [f"CASE WHEN {'' if on else 'NOT '}{c} THEN '{labels[0 if on else 1]}' END" for c, labels in hardening.CHECKS.items()]
    full, part = (label for _, label in hardening.RELRO.values())
    cases.append(f"CASE relro WHEN 'Full RELRO' THEN '{full}' WHEN 'Partial RELRO' THEN '{part}' END" if on else f"CASE WHEN relro = 'No RELRO' THEN '{hardening.NO_RELRO}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_PICKS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for c, label in hardening.APPROACH.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH f AS ({FLAGS_SQL}), l AS (SELECT p_partkey, {_labels(True)} AS t, {_labels(False)} AS v, {_PICKS} AS p FROM f)
SELECT p_partkey, array_to_string(t, '; ') AS techniques, array_to_string(v, '; ') AS areas,
  CASE WHEN len(t) = 0 THEN '{hardening.NO_TECHNIQUES}' WHEN len(p) = 0 THEN '{hardening.NO_APPROACH}' ELSE array_to_string(p, ' -> ') END AS approach FROM l""")
def hardening_labels(t: Tables) -> DataFrame:
    out = hardening.score(t.sql(FLAGS))
    return out.select("p_partkey", F.array_join("required_techniques", "; ").alias("techniques"), F.array_join("vulnerable_areas", "; ").alias("areas"), F.col("recommended_approach").alias("approach"))


@query(f"WITH f AS ({FLAGS_SQL}), l AS (SELECT p_partkey, {_labels(False)} AS v FROM f) SELECT v AS area, count(*) AS n FROM (SELECT unnest(v) AS v FROM l) GROUP BY v")
def vulnerable_area_counts(t: Tables) -> DataFrame:
    out = hardening.score(t.sql(FLAGS)).select(F.explode("vulnerable_areas").alias("area"))
    return out.groupBy("area").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Full RELRO' WHEN l_returnflag = 'R' THEN 'Partial RELRO' ELSE 'No RELRO' END AS relro, count(*) AS n FROM lineitem GROUP BY 1")
def relro_case(t: Tables) -> DataFrame:
    status = hardening.relro_status(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    return t.lineitem.groupBy(status.alias("relro")).agg(F.count("*").alias("n"))


@query("SELECT CASE substr(o_orderpriority, 1, 1) WHEN '0' THEN 'Disabled' WHEN '1' THEN 'Conservative (stack, heap, mmap, VDSO)' WHEN '2' THEN 'Full (includes data segments)' ELSE 'Unknown' END AS status, count(*) AS n FROM orders GROUP BY 1")
def lookup_default(t: Tables) -> DataFrame:
    status = tx.lookup(F.substring("o_orderpriority", 1, 1), hardening.ASLR, "Unknown")
    return t.orders.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def dangerous_semi(t: Tables) -> DataFrame:
    used = t.lineitem.where(F.col("l_quantity") >= 49).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def missing_anti(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Failed' ELSE 'Generated' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def artifact_status(t: Tables) -> DataFrame:
    return metrics.artifact_status(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k, coalesce(json_extract_string(props, '$.absent'), 'Unknown') AS absent FROM events")
def json_default(t: Tables) -> DataFrame:
    return t.events.select("event_id", js.json_field(F.col("props"), "$.k", "Unknown").alias("k"), js.json_field(F.col("props"), "$.absent", "Unknown").alias("absent"))


@query(rf"""WITH a AS ({ANSWERS_SQL}), b AS (SELECT id, response, regexp_extract(response, '(?s)(\{{.*\}})', 1) AS j FROM a), v AS (SELECT *, j <> '' AND json_valid(j) AS ok FROM b)
SELECT id, CASE WHEN ok THEN j END AS json, CASE WHEN ok THEN NULL ELSE 'Failed to parse JSON response' END AS error, CASE WHEN ok THEN NULL ELSE response END AS raw_response FROM v""")
def json_error_record(t: Tables) -> DataFrame:
    return records.extract(t.sql(ANSWERS)).drop("record")


@query(r"SELECT page_id, regexp_extract(html, '(?s)(\{.*\})', 1) AS body FROM pages")
def first_brace_last_brace(t: Tables) -> DataFrame:
    return t.pages.select("page_id", js.braced(F.col("html")).alias("body"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN contains(text, '```') THEN text ELSE concat('Here:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'and') END AS t FROM conversations),
f AS (SELECT conv_id, turn, regexp_extract(t, '(?s)```python[^\n]*\n(.*?)```', 1) AS named, regexp_extract(t, '(?s)```[^\n]*\n(.*?)```', 1) AS plain FROM c)
SELECT conv_id, turn, regexp_replace(CASE WHEN named <> '' THEN named ELSE plain END, '^\s+|\s+$', '', 'g') AS code FROM f""")
def fenced_block(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\nand\n```\nrest\n```"))
    own = F.col("text").contains("```")
    return t.conversations.select("conv_id", "turn", js.fenced(F.when(own, F.col("text")).otherwise(text)).alias("code"))


@query("SELECT o_orderkey, round_even(o_totalprice / 1000000 * 100, 0) AS confidence FROM orders")
def confidence_pct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.percent(F.col("o_totalprice") / 1000000).alias("confidence"))


@query(f"""WITH r AS ({RISKY_SQL}), l AS (SELECT p_partkey, list_filter([CASE WHEN protection_level = 'Low' THEN '{metrics.RISKS[0]}' END, CASE WHEN severity IN ('Critical', 'High') THEN '{metrics.RISKS[1]}' END, CASE WHEN likelihood IN ('High', 'Medium') THEN '{metrics.RISKS[2]}' END], lambda x: x IS NOT NULL) AS f FROM r)
SELECT p_partkey, CASE WHEN len(f) = 0 THEN '{metrics.NO_RISK}' ELSE array_to_string(f, chr(10)) END AS risk FROM l""")
def risk_factors(t: Tables) -> DataFrame:
    return metrics.risk_factors(t.sql(RISKY), "p_partkey")


def _unpivot() -> str:
    rows = hardening.PROTECTION_TABLE
    parts = [f"SELECT p_partkey, '{n}' AS protection, CASE WHEN {c} THEN 'Enabled' ELSE 'Disabled' END AS status, CASE WHEN {c} THEN '{on}' ELSE '{off}' END AS impact FROM f" for n, c, on, off in rows]
    parts.append("SELECT p_partkey, 'RELRO', relro, CASE WHEN relro = 'No RELRO' THEN 'GOT overwrite possible' ELSE 'GOT protected' END FROM f")
    return f"WITH f AS ({FLAGS_SQL}) " + " UNION ALL ".join(parts)


@query(_unpivot())
def protection_unpivot(t: Tables) -> DataFrame:
    return hardening.protection_rows(t.sql(FLAGS), "p_partkey")


@query(f"WITH f AS ({FLAGS_SQL}) " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS item, CASE WHEN {c} THEN 'Enabled' ELSE 'Disabled' END AS state FROM f" for n, c in (("ASLR", "aslr"), ("NX Bit", "nx"), ("PIE", "pie"), ("Stack Canaries", "canary"))))
def protection_switches(t: Tables) -> DataFrame:
    return metrics.switches(t.sql(FLAGS), "p_partkey")


@query("""SELECT r_name AS file, 'Crash triage results' AS description, 'Generated' AS status FROM region
UNION ALL SELECT n_name, 'Binary protection analysis', CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) THEN 'Generated' ELSE 'Failed' END FROM nation""")
def files_table(t: Tables) -> DataFrame:
    first = t.region.select(F.col("r_name").alias("file"), F.lit("Crash triage results").alias("description"), F.lit("Generated").alias("status"))
    have = t.customer.where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    wanted = t.nation.select("n_nationkey", F.col("n_name").alias("file"), F.lit("Binary protection analysis").alias("description"))
    return metrics.table_rows(first, metrics.artifact_status(wanted, have, "n_nationkey").drop("n_nationkey"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS label, count(*) AS n FROM events GROUP BY 1")
def label_validate(t: Tables) -> DataFrame:
    return t.events.groupBy(records.valid_label(F.col("event_type"), ("click", "view")).alias("label")).agg(F.count("*").alias("n"))


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'stack_buffer_overflow' WHEN 2 THEN 'format_string' WHEN 3 THEN 'use_after_free' WHEN 4 THEN 'heap_buffer_overflow' END"
_LEVEL = "CASE p_size % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END"


@query(f"""WITH k AS (SELECT p_partkey, {_KIND} AS kind, {_LEVEL} AS lvl FROM part)
SELECT p_partkey, CASE WHEN kind IN ('sql_injection', 'command_injection') THEN 'injection_based' WHEN kind IN ('stack_buffer_overflow', 'heap_buffer_overflow') THEN 'memory_corruption' WHEN kind = 'format_string' THEN 'format_string_exploitation' ELSE 'file_based' END AS delivery,
  CASE WHEN lvl IS NULL THEN 'direct_exploitation' WHEN lvl = 'Low' THEN 'direct_shellcode' WHEN lvl = 'Medium' THEN 'rop_chain' ELSE 'advanced_bypass' END AS strategy FROM k""")
def class_lookups(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT p_partkey, {_KIND} AS kind, {_LEVEL} AS lvl FROM part")
    return rows.select("p_partkey", records.delivery(F.col("kind")).alias("delivery"), records.strategy(F.col("lvl")).alias("strategy"))


@query("SELECT doc_id, concat(substr(text, 1, 100), '...') AS preview FROM documents")
def truncate_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.preview(F.col("text"), 100).alias("preview"))


@query("SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS dropped FROM documents")
def reduction_counts(t: Tables) -> DataFrame:
    return metrics.reduction(t.documents, "text")


@query("SELECT o_orderkey, lower(hex(encode(o_orderpriority))) AS hex, regexp_replace(lower(hex(encode(o_orderpriority))), '(..)', '\\\\x\\1', 'g') AS escaped, printf('%.1f%%', round_even(o_totalprice / 1000000 * 100, 1)) AS share FROM orders")
def hex_and_format(t: Tables) -> DataFrame:
    raw = F.encode("o_orderpriority", "UTF-8")
    return t.orders.select("o_orderkey", F.lower(F.hex(raw)).alias("hex"), tx.hex_escapes(raw).alias("escaped"), tx.percent_text(F.col("o_totalprice") / 1000000, 1).alias("share"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT CAST(split_part(file, ':', 2) AS BIGINT) % 50 AS target_id, frame FROM f),
a AS (SELECT target_id, count(*) AS total, count(DISTINCT frame) AS uniq FROM n GROUP BY 1),
fl AS ({FLAGS_SQL}), h AS (SELECT p_partkey, {_N} AS n FROM fl),
d AS (SELECT CAST(doc_id AS BIGINT) AS target_id, source, quality FROM documents JOIN labels USING (doc_id))
SELECT u.target_id, coalesce(total, 0) AS total_crashes, coalesce(uniq, 0) AS unique_frames, coalesce(source, 'Unknown') AS vulnerability_type, CASE quality WHEN 1 THEN 'High' ELSE 'Unknown' END AS severity,
  round_even(coalesce(quality * 0.955::DOUBLE, 0.0::DOUBLE) * 100, 0) AS confidence, CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' WHEN n IS NULL THEN 'Unknown' ELSE 'Low' END AS protection_level,
  CASE WHEN n >= 4 THEN 'Hard' WHEN n >= 2 THEN 'Medium' WHEN n IS NULL THEN 'Unknown' ELSE 'Easy' END AS exploit_difficulty, coalesce(quality = 1, false) AS poc_generated, false AS strategy_available
FROM (SELECT CAST(p_partkey AS BIGINT) AS target_id FROM part) u LEFT JOIN a USING (target_id) LEFT JOIN h ON p_partkey = u.target_id LEFT JOIN d USING (target_id)""")
def metrics_row(t: Tables) -> DataFrame:
    targets = t.part.select(F.col("p_partkey").alias("target_id"))
    crashes = triage.with_frame(t.sql(CRASHES)).withColumn("target_id", F.substring_index("file", ":", -1).cast("long") % 50)
    per = crashes.groupBy("target_id", "frame").agg(F.count("*").alias("n")).groupBy("target_id").agg(F.sum("n").alias("total_crashes"), F.count("*").alias("unique_crash_frames"))
    scores = hardening.score(t.sql(FLAGS)).select(F.col("p_partkey").alias("target_id"), "protection_level", "exploit_difficulty")
    found = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("target_id"), F.col("source").alias("vulnerability_type"), F.when(F.col("quality") == 1, "High").alias("severity"),
        (F.col("quality") * F.lit(0.955)).alias("confidence"), (F.col("quality") == 1).alias("generated"), F.lit(None).cast("boolean").alias("has_strategy"),
    )
    return metrics.metrics(targets, per, scores, found)


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT CAST(sum(cnt) AS BIGINT) AS a, count(*) AS b FROM g)
SELECT 'Crashes Analyzed' AS label, a AS value FROM s UNION ALL SELECT 'Unique Frames', b FROM s UNION ALL SELECT 'Protection Checks', CAST(5 AS BIGINT)""")
def chart_series(t: Tables) -> DataFrame:
    row = triage.summary(t.sql(CRASHES)).withColumnRenamed("unique_crash_frames", "unique_frames").withColumn("target_id", F.lit(0))
    return metrics.series(row).drop("target_id")


@query(f"""WITH {FRAMES_SQL} SELECT rnk, concat('CRASH ANALYSIS DATA:', chr(10), '- Crash Frame: ', frame, chr(10), '- Number of crashes: ', cnt, chr(10), '- Sample crash file size: ', size, ' bytes') AS context FROM r""")
def prompt_context(t: Tables) -> DataFrame:
    return records.prompt(triage.ranked(triage.groups(t.sql(CRASHES)))).select("rnk", "context")


@query("SELECT file AS name, octet_length(encode(content)) AS size FROM (SELECT DISTINCT source AS file, source AS content FROM documents) WHERE file IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation)")
def existing_artifacts(t: Tables) -> DataFrame:
    wanted = t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    have = t.documents.select(F.col("source").alias("name")).distinct()
    return have.join(wanted, "name", "left_semi").select("name", F.octet_length("name").cast("long").alias("size"))


@query(f"""WITH f AS ({FLAGS_SQL}), s AS (SELECT *, {_N} AS n FROM f), l AS (SELECT p_partkey, n, {_labels(True)} AS t, {_labels(False)} AS v FROM s),
a AS (SELECT p_partkey, 'level' AS part, [CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END] AS x FROM l UNION ALL SELECT p_partkey, 'difficulty', [CASE WHEN n >= 4 THEN 'Hard' WHEN n >= 2 THEN 'Medium' ELSE 'Easy' END] FROM l
  UNION ALL SELECT p_partkey, 'required', t FROM l UNION ALL SELECT p_partkey, 'vulnerable', v FROM l)
SELECT p_partkey, part, CAST(unnest(range(0, len(x))) AS BIGINT) AS place, unnest(x) AS line FROM a""")
def score_summary_lines(t: Tables) -> DataFrame:
    return metrics.score_lines(hardening.score(t.sql(FLAGS)), "p_partkey")


@query("SELECT doc_id, CAST(instr(text, 'e') - 1 AS BIGINT) AS first, CAST(CASE WHEN contains(text, 'e') THEN length(text) - instr(reverse(text), 'e') ELSE -1 END AS BIGINT) AS last FROM documents")
def index_functions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.first_index(F.col("text"), "e").cast("long").alias("first"), tx.last_index(F.col("text"), "e").cast("long").alias("last"))


@query("SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS seconds FROM orders")
def rounded_seconds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.seconds(F.col("o_totalprice") / 7).alias("seconds"))


@query("SELECT p_partkey, concat(replace(p_type, ' ', '_'), '_', p_brand) AS name, replace(p_type, ' ', '_') AS vulnerability_type, p_brand AS target, 0.0::DOUBLE AS confidence, 'Unknown' AS severity FROM part")
def record_metadata(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("vulnerability_type"), F.concat(F.lit("/bin/"), "p_brand").alias("binary_path"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("severity"))
    return records.metadata(rows, "p_partkey")


@query("SELECT s_suppkey, CASE WHEN contains(s_name, '1') THEN 'x86_64' WHEN contains(s_name, '2') OR contains(s_name, '3') THEN 'i386' ELSE 'unknown' END AS architecture, NOT contains(s_name, '4') AS stripped FROM supplier")
def file_facts(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_name").contains("1"), "x86-64").when(F.col("s_name").contains("2"), "i386").when(F.col("s_name").contains("3"), "80386").otherwise("MIPS")
    text = F.concat(F.lit("ELF, "), kind, F.when(F.col("s_name").contains("4"), ", not stripped").otherwise(", stripped"))
    info = hardening.file_info(text)
    return t.supplier.select("s_suppkey", info["architecture"].alias("architecture"), info["stripped"].alias("stripped"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '__memcpy_chk,__strcpy_chk' WHEN p_size % 3 = 1 THEN '__printf_chk' ELSE '' END AS fortified, p_size % 3 < 2 AS enabled FROM part")
def fortify_facts(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, "x __strcpy_chk y __memcpy_chk __strcpy_chk").when(F.col("p_size") % 3 == 1, "a __printf_chk@b").otherwise("none _chk")
    found = hardening.fortify(text)
    return t.part.select("p_partkey", F.array_join(found["fortified_functions"], ",").alias("fortified"), found["enabled"].alias("enabled"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'strcpy,gets' ELSE '' END AS dangerous, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS imported FROM part")
def symbol_facts(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, "   U strcpy@GLIBC_2\n  U puts\n0001 U gets\n0002 T main").otherwise("  U exit\n\n")
    found = hardening.symbols(text)
    return t.part.select("p_partkey", F.array_join(found["dangerous_functions_found"], ",").alias("dangerous"), found["total_imported_functions"].alias("imported"))


@query("SELECT p_partkey, p_size % 3 = 1 AS nx, p_size % 2 = 0 AS pie, CAST(p_size % 4 AS BIGINT) AS libraries, CASE WHEN p_size % 5 = 0 THEN '__stack_chk_fail' ELSE '' END AS canary FROM part")
def tool_facts(t: Tables) -> DataFrame:
    stack = F.when(F.col("p_size") % 3 == 0, "  GNU_STACK\n  0x0 RWE 0x10").when(F.col("p_size") % 3 == 1, " GNU_STACK\n 0x0 RW  0x10").otherwise("LOAD RW")
    kind = F.when(F.col("p_size") % 2 == 0, "ELF Header\n  Type: DYN (x)").otherwise("  Type: EXEC\n  Type: DYN")
    libs = F.concat(F.repeat(F.lit("\tlibx.so => /lib/x\n"), (F.col("p_size") % 4).cast("int")), F.lit("\tstatic"))
    symbols = F.when(F.col("p_size") % 5 == 0, "x __stack_chk_fail y").otherwise("main")
    return t.part.select("p_partkey", hardening.nx(stack)["enabled"].alias("nx"), hardening.pie(kind)["enabled"].alias("pie"), hardening.libraries(libs)["count"].alias("libraries"), F.array_join(hardening.canaries(symbols, F.lit(""))["symbols_found"], ",").alias("canary"))


def saved(t: Tables, rows: DataFrame, key: str, value: str) -> str:
    """A corpus with one text file a row, in a folder named key=..."""
    path = shared.scratch(t.spark, "corpus")
    rows.select(key, value).write.partitionBy(key).text(path)
    return path


@query("SELECT n_nationkey, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS size, concat(n_name, chr(10)) AS content FROM nation")
def corpus_scan(t: Tables) -> DataFrame:
    found = corpus.corpus(t.spark, saved(t, t.nation, "n_nationkey", "n_name"), recursive=True, glob="part-*")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "size", F.decode("content", "UTF-8").alias("content"))


_NAME = """CASE s_suppkey % 5 WHEN 0 THEN concat('_', s_suppkey) WHEN 1 THEN concat('.', s_suppkey) WHEN 2 THEN 'README.txt' WHEN 3 THEN concat('id:', s_suppkey, ' %20') ELSE concat('id', s_suppkey) END"""
CORPUS = f"SELECT concat(s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('/.n/_', s_suppkey) WHEN s_suppkey % 5 = 2 THEN concat('/', s_suppkey) ELSE '' END, '/', {_NAME}) AS name, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS content FROM supplier"


@query(f"WITH c AS ({CORPUS}) SELECT name, string_split(name, '/')[-1] AS file, CAST(coalesce(octet_length(encode(content)), 0) AS BIGINT) AS size, coalesce(content, '') AS content FROM c WHERE string_split(name, '/')[-1] <> 'README.txt'")
def corpus_complete(t: Tables) -> DataFrame:
    """Files with plain, hidden and odd names, empty ones and README.txt, at several depths, written and listed."""
    root = shared.scratch(t.spark, "corpus")
    corpus.write_files(t.sql(CORPUS), root)
    found = corpus.corpus(t.spark, root, recursive=True)
    return found.select(F.substring(F.col("path"), len(root) + 2, 1 << 20).alias("name"), "file", "size", F.decode("content", "UTF-8").alias("content"))


@query("SELECT r_regionkey, CAST(octet_length(encode(r_name)) + 1 AS BIGINT) AS size FROM region WHERE r_regionkey = 3")
def first_directory(t: Tables) -> DataFrame:
    path = saved(t, t.region, "r_regionkey", "r_name")
    found = files.first_directory(t.spark, [f"{path}/absent", f"{path}/r_regionkey=3", f"{path}/r_regionkey=1"], glob="part-*")
    return found.select(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("int").alias("r_regionkey"), "size")


@query("SELECT n_nationkey, concat(n_name, chr(10)) AS latest FROM nation WHERE n_nationkey = (SELECT arg_max(n_nationkey, CAST(n_nationkey AS VARCHAR)) FROM nation)")
def latest_file(t: Tables) -> DataFrame:
    last = files.latest(corpus.corpus(t.spark, saved(t, t.nation, "n_nationkey", "n_name"), recursive=True))
    return last.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.decode("content", "UTF-8").alias("latest"))


@query("SELECT CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def json_documents(t: Tables) -> DataFrame:
    """Documents of one region have text behind their JSON."""
    body = F.to_json(F.struct("n_name", "n_regionkey"))
    rows = t.nation.select("n_nationkey", F.concat(body, F.when(F.col("n_regionkey") == 2, " }").otherwise("")).alias("body"))
    schema = T.StructType([T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return files.json_document(t.spark, saved(t, rows, "n_nationkey", "body"), schema)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_written(t: Tables) -> DataFrame:
    path = shared.scratch(t.spark, "json")
    files.write_json(t.supplier, path)
    return t.spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(path)


@query("SELECT concat(n_name, chr(10)) AS source_code FROM nation")
def whole_texts(t: Tables) -> DataFrame:
    return files.whole_text(t.spark, saved(t, t.nation, "n_nationkey", "n_name")).select("source_code")


# Tool output of a binary for each part; what the rules find in it is worked out once more in SQL.
TOOLS = """
SELECT p_partkey AS binary_id, p_name AS name,
  concat('/bin/', p_brand, ': ', CASE p_size % 3 WHEN 0 THEN 'ELF 64-bit x86-64' WHEN 1 THEN 'PE32 80386' ELSE 'ELF ARM' END, CASE p_partkey % 3 WHEN 0 THEN ', not stripped' WHEN 1 THEN ', stripped' ELSE '' END) AS file_out,
  concat('  LOAD RW', chr(10), CASE WHEN p_partkey % 5 < 4 THEN concat('  GNU_STACK 0x0', chr(10), CASE WHEN p_size % 4 = 0 THEN '    0x0 RWE' ELSE '    0x0 RW ' END) ELSE '  NOTE' END, CASE WHEN p_partkey % 4 < 2 THEN concat(chr(10), '  GNU_RELRO') ELSE '' END) AS readelf_l,
  concat('  Class: ELF64', chr(10), '  Type: ', CASE WHEN p_size % 2 = 0 THEN 'DYN' ELSE 'EXEC' END, chr(10), '  Type: DYN') AS readelf_h,
  CASE WHEN p_size % 3 = 1 THEN concat('FLAGS BIND_NOW ', p_name) ELSE p_name END AS readelf_d,
  concat(CASE WHEN p_partkey % 6 < 3 THEN concat('0 __stack_chk_fail', chr(10)) ELSE '' END, CASE p_size % 3 WHEN 0 THEN '__strcpy_chk __memcpy_chk __strcpy_chk' WHEN 1 THEN concat('__', p_brand, '_chk') ELSE '_chk' END) AS objdump_t,
  concat('Stack Smashing ', p_name, chr(10), 'stack', chr(10), ' guard of the STACK') AS strings_out,
  concat('   U puts', chr(10), CASE WHEN p_size % 2 = 0 THEN concat('  U strcpy@GLIBC_2', chr(10)) ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN concat('0001 U gets', chr(10)) ELSE '' END, '0002 T main', chr(10), '  U ', replace(p_brand, '#', '_')) AS nm_d,
  concat(CASE WHEN p_partkey % 2 = 0 THEN concat(chr(9), 'libc.so.6 => /lib/libc.so.6', chr(10)) ELSE '' END, chr(9), p_brand, ' => ', p_name, chr(10), 'static') AS ldd_out,
  CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS aslr_value
FROM part
"""
FACTS_SQL = rf"""tools AS ({TOOLS}),
cut AS (SELECT *, string_split(readelf_l, chr(10)) AS seg, string_split(readelf_h, chr(10)) AS head, string_split(nm_d, chr(10)) AS sym FROM tools),
at_ AS (SELECT *, coalesce(list_position(list_transform(seg, lambda x: contains(x, 'GNU_STACK')), true), 0) AS s,
  list_transform(list_filter(list_transform(list_filter(sym, lambda x: trim(x) <> ''), lambda x: string_split_regex(trim(x), '\s+')), lambda p: p[1] = 'U' OR (len(p) > 1 AND p[2] = 'U')), lambda p: string_split(p[-1], '@')[1]) AS names FROM cut),
facts AS (SELECT binary_id,
  CASE WHEN contains(file_out, 'x86-64') THEN 'x86_64' WHEN contains(file_out, '80386') THEN 'i386' WHEN contains(file_out, 'ARM') THEN 'ARM' ELSE 'unknown' END AS architecture,
  CASE WHEN contains(file_out, 'ELF') THEN 'ELF' ELSE 'PE' END AS format, CASE WHEN contains(file_out, 'not stripped') THEN false WHEN contains(file_out, 'stripped') THEN true END AS stripped,
  CASE aslr_value WHEN '0' THEN 'Disabled' WHEN '1' THEN '{hardening.ASLR["1"]}' WHEN '2' THEN '{hardening.ASLR["2"]}' ELSE 'Unknown' END AS aslr_status, coalesce(aslr_value <> '0', false) AS aslr,
  CASE WHEN s = 0 THEN false WHEN contains(concat(seg[s], ' ', seg[s + 1]), 'RWE') THEN false ELSE contains(concat(seg[s], ' ', seg[s + 1]), 'RW') END AS nx,
  contains(objdump_t, '__stack_chk_fail') AS canary,
  CAST(len(list_filter(string_split(lower(strings_out), chr(10)), lambda x: contains(x, 'stack') AND (contains(x, 'smash') OR contains(x, 'guard')))) AS BIGINT) AS related,
  contains(list_filter(head, lambda x: contains(x, 'Type:'))[1], 'DYN') AS pie,
  CASE WHEN contains(readelf_l, 'GNU_RELRO') AND contains(readelf_d, 'BIND_NOW') THEN 'Full RELRO' WHEN contains(readelf_l, 'GNU_RELRO') THEN 'Partial RELRO' ELSE 'No RELRO' END AS relro,
  array_to_string(list_sort(list_distinct(regexp_extract_all(objdump_t, '(__[0-9A-Za-z_]+_chk)', 1))), ',') AS fortified,
  array_to_string(list_filter(names, lambda x: x IN ('strcpy', 'gets')), ',') AS dangerous, CAST(len(names) AS BIGINT) AS imported, array_to_string(names[1:10], ',') AS sample,
  CAST(len(list_filter(string_split(ldd_out, chr(10)), lambda x: contains(x, '=>'))) AS BIGINT) AS libraries FROM at_)"""
_COUNTED = f"WITH {FACTS_SQL}, s AS (SELECT *, {_N} AS n FROM facts)"


@query(f"{_COUNTED} SELECT * EXCLUDE (n), n AS protection_count, CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END AS protection_level FROM s")
def binary_facts(t: Tables) -> DataFrame:
    """Facts of every binary, their flags and the score, in one go."""
    found = hardening.facts(t.sql(TOOLS))
    scored = hardening.score(hardening.flags(found))
    c = F.col
    plain = found.select(
        c("binary_id").alias("id"), c("file_info.architecture"), c("file_info.format"), c("file_info.stripped"), c("aslr_system.status").alias("aslr_status"),
        F.size("stack_canaries.related_strings").cast("long").alias("related"), F.array_join("fortify.fortified_functions", ",").alias("fortified"), F.array_join("symbols.dangerous_functions_found", ",").alias("dangerous"),
        c("symbols.total_imported_functions").alias("imported"), F.array_join("symbols.sample_imports", ",").alias("sample"), c("dynamic_libs.count").alias("libraries"),
    )
    return scored.select("binary_id", "aslr", "nx", "canary", "pie", "relro", "protection_count", "protection_level").join(plain, c("binary_id") == c("id")).drop("id")


_STATES = ", ".join(f"chr(10), '- {name}: ', CASE WHEN {c} THEN 'Enabled' ELSE 'Disabled' END" for name, c in records.PROTECTIONS.items())


@query(f"""WITH f AS ({FLAGS_SQL}), s AS (SELECT *, {_N} AS n FROM f), k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)
SELECT p.p_partkey, concat('CRASH ANALYSIS DATA:', chr(10), '- Crash Frame: ', p_name, chr(10), '- Number of crashes: ', p_size, chr(10), '- Sample crash file size: ', p.p_partkey, ' bytes',
  CASE WHEN l_partkey IS NOT NULL THEN concat(chr(10), chr(10), 'SOURCE CODE:', chr(10), p_type) ELSE '' END,
  CASE WHEN p_size > 10 THEN concat(chr(10), chr(10), 'BINARY PROTECTIONS:', chr(10), '- Protection Level: ', CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END, {_STATES}) ELSE '' END) AS context
FROM part p JOIN s ON s.p_partkey = p.p_partkey LEFT JOIN k ON l_partkey = p.p_partkey""")
def prompt_with_sides(t: Tables) -> DataFrame:
    """Source where a line item is large, protections where a part is: either side may be missing."""
    groups = t.part.select("p_partkey", F.col("p_partkey").alias("target_id"), F.col("p_name").alias("frame"), F.col("p_size").alias("cnt"), F.col("p_partkey").alias("size"))
    large = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    sources = t.part.join(large, "p_partkey", "left_semi").select(F.col("p_partkey").alias("target_id"), F.col("p_type").alias("source_code"))
    scores = hardening.score(t.sql(FLAGS).join(t.part.where("p_size > 10").select("p_partkey"), "p_partkey")).withColumnRenamed("p_partkey", "target_id")
    return records.prompt(groups, sources, scores).select("p_partkey", "context")


_BOLD = "concat('**{}:** ', {})".format
_LEVELS = "CASE WHEN n >= 4 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END AS protection_level, CASE WHEN n >= 4 THEN 'Hard' WHEN n >= 2 THEN 'Medium' ELSE 'Easy' END AS exploit_difficulty"
_DETAILS = "[" + ", ".join(["'### Vulnerability Classification'", *(_BOLD(name, f"coalesce({c}, '{default}')") for name, c, default in report.DETAILS)]) + "]"
_TABLE = "[" + ", ".join([f"concat('{n} | ', CASE WHEN {c} THEN 'Enabled | {on}' ELSE 'Disabled | {off}' END)" for n, c, on, off in hardening.PROTECTION_TABLE] + ["concat('RELRO | ', relro, ' | ', CASE WHEN relro = 'No RELRO' THEN 'GOT overwrite possible' ELSE 'GOT protected' END)"]) + "]"
RECORDS = f"SELECT p_partkey, {_KIND} AS vulnerability_type, CASE p_partkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Low' END AS severity, CAST(p_size AS DOUBLE) / 64 AS confidence, CASE p_size % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS likelihood, p_type AS attack_vector, CASE WHEN p_size > 20 THEN p_brand END AS impact, CASE WHEN p_size > 30 THEN p_name END AS technical_details FROM part WHERE p_size > 5"


REVIEWS = "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS vulnerable_function, p_type AS root_cause, CASE WHEN p_size > 25 THEN p_brand END AS attack_surface, CASE WHEN p_size % 2 = 0 THEN split(concat('strcpy,', p_brand), ',') END AS dangerous_functions FROM part WHERE p_size > 12"
PATCHES = "SELECT p_partkey, split(concat('bound copies in ', p_name, ',', p_type), ',') AS immediate_fixes, CASE WHEN p_size % 4 = 0 THEN concat('f(', p_brand, ');', chr(10), 'return;') END AS corrected_code_snippet, CASE WHEN p_size % 5 < 2 THEN split(concat(p_type, ',fuzz'), ',') END AS long_term_recommendations FROM part WHERE p_size > 30"
_REVIEW = "list_concat(['### Source Code Analysis', concat('**Vulnerable Function:** `', coalesce(vulnerable_function, 'Unknown'), '`'), concat('**Root Cause:** ', root_cause), concat('**Attack Surface:** ', coalesce(attack_surface, 'Unknown'))], CASE WHEN len(dangerous_functions) > 0 THEN list_concat(['**Dangerous Functions Detected:**'], list_transform(dangerous_functions, lambda x: concat('- `', x, '`'))) ELSE [] END)"
_PATCH = "list_concat(list_concat(['## Remediation Strategy', '### Immediate Actions Required'], list_transform(immediate_fixes, lambda x: concat('1. **', x, '**'))), list_concat(CASE WHEN corrected_code_snippet <> '' THEN ['### Code Fix Example', '```c', corrected_code_snippet, '```'] ELSE [] END, CASE WHEN len(long_term_recommendations) > 0 THEN list_concat(['### Long-term Security Improvements'], list_transform(long_term_recommendations, lambda x: concat('- ', x))) ELSE [] END))"
REPORT_SQL = f"""WITH fl AS ({FLAGS_SQL}), s AS (SELECT *, {_N} AS n FROM fl), h AS (SELECT *, {_LEVELS} FROM s), r AS ({RECORDS}), {FRAMES_SQL.replace("r AS (SELECT frame", "rg AS (SELECT frame")},
k AS (SELECT h.*, list_filter([CASE WHEN protection_level = 'Low' THEN '{metrics.RISKS[0]}' END, CASE WHEN severity IN ('Critical', 'High') THEN '{metrics.RISKS[1]}' END, CASE WHEN likelihood IN ('High', 'Medium') THEN '{metrics.RISKS[2]}' END], lambda x: x IS NOT NULL) AS risks FROM h LEFT JOIN r ON r.p_partkey = h.p_partkey),
o AS (SELECT CAST(1 AS BIGINT) AS target_id, 1 AS section, ['# Security Report', {_BOLD('Total Crashes', 'CAST(sum(cnt) AS BIGINT)')}, {_BOLD('Unique Crash Frames', 'count(*)')}] AS x FROM g
 UNION ALL SELECT p_partkey, 2, ['## Executive Summary', concat('**Critical Finding:** ', coalesce(vulnerability_type, 'Unknown'), ' vulnerability detected'), {_BOLD('Risk Level', "coalesce(severity, 'Unknown')")}, concat('**Exploitability:** ', printf('%.0f%%', round_even(confidence * 100, 0)), ' confidence')] FROM r
 UNION ALL SELECT p_partkey, 3, [{_BOLD('Defense Level', 'protection_level')}, {_BOLD('Exploit Difficulty', 'exploit_difficulty')}] FROM h
 UNION ALL SELECT p_partkey, 4, ['### Risk Assessment', concat('- ', CASE WHEN len(risks) = 0 THEN '{metrics.NO_RISK}' ELSE array_to_string(risks, concat(chr(10), '- ')) END)] FROM k
 UNION ALL SELECT p_partkey, 5, {_DETAILS} FROM r UNION ALL SELECT p_partkey, 6, {_TABLE} FROM h UNION ALL SELECT p_partkey, 7, {_REVIEW} FROM ({REVIEWS}) UNION ALL SELECT p_partkey, 8, {_PATCH} FROM ({PATCHES})),
report AS (SELECT target_id, section, CAST(unnest(range(0, len(x))) AS BIGINT) AS line_no, unnest(x) AS line FROM o
UNION ALL SELECT 1, 9, rnk, concat('### Crash Group ', rnk, ': ', frame, ' (', cnt, ' crashes, ', file, ')') FROM rg
UNION ALL SELECT 1, 10, row_number() OVER (ORDER BY n_name), concat(n_name, ' | Binary protection analysis | Generated') FROM nation)"""


@query(f"{REPORT_SQL} SELECT target_id, section, line_no, line FROM report")
def report_lines(t: Tables) -> DataFrame:
    """The report of every part; crash groups and files belong to the first."""
    first = F.lit(1).cast("long").alias("target_id")
    crashes = t.sql(CRASHES)
    found = t.sql(RECORDS).withColumnRenamed("p_partkey", "target_id")
    scores = hardening.score(t.sql(FLAGS)).withColumnRenamed("p_partkey", "target_id")
    made = t.nation.select(first, F.col("n_name").alias("file"), F.lit("Binary protection analysis").alias("description"), F.lit("Generated").alias("status"))
    reviews, patches = (t.sql(q).withColumnRenamed("p_partkey", "target_id") for q in (REVIEWS, PATCHES))
    return report.report(triage.summary(crashes).select(first, "*"), triage.ranked(triage.groups(crashes)).select(first, "*"), scores, found, made, reviews, patches)


@query(f"""{REPORT_SQL}, x AS (SELECT target_id, section, line_no, string_split(line, chr(10)) AS ls FROM report),
y AS (SELECT target_id, section, line_no, unnest(range(0, len(ls))) AS k, unnest(ls) AS line FROM x)
SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY section, line_no, k) AS n, line FROM y""")
def report_files(t: Tables) -> DataFrame:
    """The report written by many tasks, and read back by its index, line by line."""
    return files.read_report(files.write_report(report_lines(t), shared.scratch(t.spark, "report")))


@query("SELECT p_partkey AS target_id, CASE WHEN p_size > 10 THEN concat('{\"total_crashes\":', p_size, ',\"severity\":\"', p_brand, '\"}') ELSE concat('{\"total_crashes\":', p_size, '}') END AS json FROM part")
def metrics_json(t: Tables) -> DataFrame:
    return metrics.as_json(t.part.select(F.col("p_partkey").alias("target_id"), F.col("p_size").alias("total_crashes"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("severity")))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_type, '_', ' ')), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS title, concat(p_brand, '.md') AS report FROM part")
def titles_and_extensions(t: Tables) -> DataFrame:
    kind = F.replace("p_type", F.lit(" "), F.lit("_"))
    return t.part.select("p_partkey", tx.title(kind).alias("title"), tx.with_extension(F.concat("p_brand", F.lit(".json")), ".json", ".md").alias("report"))


_MEMBER = "concat('        {', chr(10), '          \"file\": \"', file, '\",', chr(10), '          \"path\": \"/crashes/', file, '\",', chr(10), '          \"size\": ', size, chr(10), '        }')"


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT *, CAST(split_part(file, ':', 2) AS BIGINT) % 20 AS target_id FROM f),
m AS (SELECT target_id, frame, count(*) AS cnt, string_agg({_MEMBER}, concat(',', chr(10)) ORDER BY size, file) AS members FROM n GROUP BY ALL),
d AS (SELECT target_id, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS frames, string_agg(concat('    "', frame, '": {{', chr(10), '      "count": ', cnt, ',', chr(10), '      "crashes": [', chr(10), members, chr(10), '      ]', chr(10), '    }}'), concat(',', chr(10)) ORDER BY cnt DESC, frame) AS groups FROM m GROUP BY target_id)
SELECT concat(target_id, '.json') AS file, concat('{{', chr(10), '  "total_crashes": ', total, ',', chr(10), '  "unique_crash_frames": ', frames, ',', chr(10), '  "groups": {{', chr(10), groups, chr(10), '  }}', chr(10), '}}') AS document FROM d""")
def triage_documents(t: Tables) -> DataFrame:
    """The indented triage document of each of twenty targets, written and read back as text."""
    crashes = t.sql(CRASHES).select(F.substring_index("file", ":", -1).cast("long").alias("id"), "*")
    rows = triage.document_rows(crashes.select((F.col("id") % 20).alias("target_id"), "file", F.concat(F.lit("/crashes/"), "file").alias("path"), "size", "stdout"))
    path = shared.scratch(t.spark, "documents")
    documents.write_documents(rows, path, "rnk", "part", "size", "file")
    return corpus.corpus(t.spark, path).select("file", F.decode("content", "UTF-8").alias("document"))


def split_files(t: Tables) -> tuple[str, DataFrame]:
    """The documents' texts as files of their own, and their listing."""
    root = shared.scratch(t.spark, "texts")
    corpus.write_files(t.documents.select(F.concat(F.lit("_"), F.col("doc_id").cast("string")).alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    return root, corpus.listing(t.spark, [root])


_BYTES = "list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INT))"


@query(f"""WITH d AS (SELECT doc_id, text, encode(text) AS b, hex(encode(text)) AS h FROM documents), s AS (SELECT *, CAST(octet_length(b) AS BIGINT) AS size, CAST(len(list_filter({_BYTES}, lambda x: x < 32 OR x > 126)) AS BIGINT) AS np FROM d)
SELECT concat('_', doc_id) AS file, size, np AS nonprintable, CASE WHEN size > 0 THEN CAST(np * 1000 // size AS DOUBLE) / 10.0::DOUBLE END AS pct, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines,
  NOT contains(text, chr(0)) AS textual, lower(substr(h, 1, 320)) AS dump, contains(text, 'tion') AS has_word, contains(h, '74696F6E') AS hex_word, contains(text, ' the ') AS has_the, contains(h, '2074686520') AS hex_the FROM s""")
def file_profiles(t: Tables) -> DataFrame:
    """Files in ranges of 777 bytes, which cut characters and patterns."""
    _, found = split_files(t)
    out = byteranges.profile(found, {"word": b"tion", "the": b" the "}, width=777)
    return out.withColumn("path", tx.basename(F.col("path"))).withColumnRenamed("path", "file")


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 4),
k AS (SELECT doc_id, unnest([substr(h, CAST(i * 8 + 1 AS BIGINT), 8) for i in range(0, length(h) // 8)]) AS chunk FROM h),
n AS (SELECT doc_id, chunk, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, chunk DESC) AS rnk FROM n)
SELECT concat('_', doc_id) AS file, rnk, lower(chunk) AS chunk, n FROM r WHERE rnk <= 3 AND n > 1""")
def file_chunks_top3(t: Tables) -> DataFrame:
    """Files in ranges of 4 kB that send 64 chunks each."""
    _, found = split_files(t)
    return byteranges.top_chunks(found, share=4096, kept=64).withColumn("path", tx.basename(F.col("path"))).withColumnRenamed("path", "file")


@query(f"WITH {FRAMES_SQL} SELECT frame, cnt, file, size FROM r")
def streamed_groups(t: Tables) -> DataFrame:
    """Groups with their smallest members, as they are after four micro-batches of a file stream."""
    root = shared.scratch(t.spark, "stream")
    t.sql(CRASHES).repartition(8).write.parquet(f"{root}/in")
    arriving = t.spark.readStream.schema("file string, size long, stdout string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    incremental.start(incremental.running_groups(arriving), f"{root}/checkpoint", f"{root}/out", "update").awaitTermination()
    return incremental.current(t.spark, f"{root}/out", "update")


# Answers with fields of the model's own; some aren't valid.
OWN_FIELDS = """SELECT event_id AS id, concat('Found: {"severity": "High", "', event_type, '": ', CAST(user_id AS STRING), ', "notes": {"deep": {"k": [', CAST(event_id AS STRING), ', null]}, "type": "', event_type, '"}, "tags": ["a", "', event_type, '"], "sure": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END, CASE WHEN event_id % 9 = 4 THEN '' ELSE '}' END, ' done') AS response FROM events"""
_OWN_SQL = OWN_FIELDS.replace("AS STRING", "AS VARCHAR")


@query(rf"""WITH a AS ({_OWN_SQL}), b AS (SELECT id, regexp_extract(response, '(?s)(\{{.*\}})', 1) AS j FROM a), v AS (SELECT id, j FROM b WHERE json_valid(j)), k AS (SELECT id, j, unnest(json_keys(j)) AS name FROM v)
SELECT id, name, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, replace(CAST(x AS VARCHAR), ' ', '') AS value
FROM (SELECT id, name, json_extract(j, '$."' || name || '"') AS x FROM k WHERE name <> 'severity')""")
def answers_own_fields(t: Tables) -> DataFrame:
    """Fields that the schema doesn't have, with their nested values."""
    return records.other_fields(records.extract(t.sql(OWN_FIELDS)))


@query(rf"""WITH a AS ({_OWN_SQL}), b AS (SELECT id, regexp_extract(response, '(?s)(\{{.*\}})', 1) AS j FROM a)
SELECT id, CASE WHEN json_valid(j) THEN coalesce(json_extract_string(j, '$.notes.type'), 'none') ELSE 'none' END AS note, CASE WHEN json_valid(j) THEN coalesce(TRY_CAST(json_extract(j, '$.notes.deep.k[0]') AS BIGINT), -1) ELSE -1 END AS k, CASE WHEN json_valid(j) THEN coalesce(TRY_CAST(json_extract(j, '$.click') AS BIGINT), 0) ELSE 0 END AS clicks FROM b""")
def answers_typed_fields(t: Tables) -> DataFrame:
    """Typed values at paths of answers, with defaults."""
    j = F.col("json")
    found = records.extract(t.sql(OWN_FIELDS))
    return found.select("id", records.field(j, "$.notes.type", "string", "none").alias("note"), records.field(j, "$.notes.deep.k[0]", "long", -1).alias("k"), records.field(j, "$.click", "long", 0).alias("clicks"))


@query("""SELECT d.doc_id, CASE WHEN length(d.text) % 10 = 3 THEN NULL ELSE concat('{"n": ', length(d.text), '}') END AS response, length(d.text) % 10 = 3 AS failed FROM documents d""")
def answers_from_cache(t: Tables) -> DataFrame:
    """A caller's function asked once per text; where it raises, the rows have errors, and later calls ask again for those alone."""

    def answer(texts: list[str]) -> list[str]:
        if any(len(x) % 10 == 3 for x in texts):
            raise ValueError("a length that it can't do")
        return [f'{{"n": {len(x)}}}' for x in texts]

    def never(texts: list[str]) -> list[str]:
        raise RuntimeError("asked again")

    cache = shared.scratch(t.spark, "answers")
    records.classify(t.documents, answer, "doc_id", "text", batch=1, cache=cache)
    again = records.classify(t.documents, never, "doc_id", "text", batch=1, cache=cache)
    return again.select("doc_id", "response", F.coalesce(F.col("error").contains("asked again"), F.lit(False)).alias("failed"))


def elf_file(wide: bool) -> str:
    """SQL for the hex text of an ELF file of a part: 64-bit with the low byte first, or 32-bit with the high byte first."""

    def word(value: int, size: int) -> str:
        return value.to_bytes(size, "little" if wide else "big").hex()

    n = 8 if wide else 4

    def program(kind: int, flags: int, offset: int = 0, held: int = 0) -> str:
        places = [word(offset, n), word(0, n), word(0, n), word(held, n), word(held, n)]
        return "".join([word(kind, 4), word(flags, 4), *places, word(8, n)] if wide else [word(kind, 4), *places, word(flags, 4), word(8, n)])

    head, each = (64, 56) if wide else (52, 32)
    begin = "7f454c46" + ("0201" if wide else "0102") + "01" + "00" * 9
    machine = word(62, 2) if wide else word(3, 2)
    rest = "".join([machine, word(1, 4), word(0, n), word(head, n), word(0, n), word(0, 4), word(head, 2), word(each, 2), word(3, 2), word(0, 2), word(0, 2), word(0, 2)])
    stack = f"CASE WHEN p_partkey % 5 < 4 THEN CASE WHEN p_size % 4 = 0 THEN '{program(elf.STACK, 7)}' ELSE '{program(elf.STACK, 6)}' END ELSE '{program(4, 4)}' END"
    relro = f"CASE WHEN p_partkey % 4 < 2 THEN '{program(elf.RELRO, 4)}' ELSE '{program(1, 5)}' END"
    now = f"CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN '{word(elf.BIND_NOW, n) + word(0, n)}' ELSE '{word(elf.FLAGS, n) + word(elf.NOW_FLAG, n)}' END ELSE '{word(21, n) + word(0, n)}' END"
    dynamic = program(elf.DYNAMIC, 6, head + 3 * each, 4 * n)
    return f"concat('{begin}', CASE WHEN p_size % 2 = 0 THEN '{word(3, 2)}' ELSE '{word(2, 2)}' END, '{rest}', {stack}, {relro}, '{dynamic}', {now}, '{word(0, n) * 2}')"


@query(f"WITH {FACTS_SQL} SELECT binary_id, nx, pie, relro, CAST(CASE WHEN p_brand < 'Brand#3' THEN 64 ELSE 32 END AS INT) AS bits FROM facts JOIN part ON p_partkey = binary_id")
def elf_facts(t: Tables) -> DataFrame:
    """Facts of a file's bytes for each part; the SQL has them from the tools' texts."""
    content = F.unhex(F.expr(f"CASE WHEN p_brand < 'Brand#3' THEN {elf_file(True)} ELSE {elf_file(False)} END"))
    found = elf.facts(t.part.select(F.col("p_partkey").alias("binary_id"), content.alias("content")))
    return found.select("binary_id", "nx", "pie", elf.relro(F.col("gnu_relro"), F.col("bind_now")).alias("relro"), "bits")


@query("SELECT concat('_', item_id) AS file, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def copied_artifacts(t: Tables) -> DataFrame:
    """Benchmark items as files; those that good documents' numbers name are copied to another folder."""
    root = shared.scratch(t.spark, "artifacts")
    corpus.write_files(t.benchmark.select(F.concat(F.lit("_"), F.col("item_id").cast("string")).alias("name"), F.encode("text", "UTF-8").alias("content")), f"{root}/in")
    wanted = t.labels.where("quality = 1").select(F.concat(F.lit("_"), F.col("doc_id").cast("string")).alias("file"))
    corpus.copy_existing(wanted, corpus.listing(t.spark, [f"{root}/in"]), f"{root}/out")
    return corpus.listing(t.spark, [f"{root}/out"], missing_ok=True).select("file", "size")


@query(rf"""WITH a AS ({_OWN_SQL}), b AS (SELECT id, regexp_extract(response, '(?s)(\{{.*\}})', 1) AS j FROM a), v AS (SELECT id, j FROM b WHERE json_valid(j)), k AS (SELECT id, j, unnest(json_keys(j)) AS name FROM v)
SELECT name, count(*) AS n, count(DISTINCT json_type(j, '$."' || name || '"')) AS kinds FROM k WHERE name <> 'severity' GROUP BY name""")
def answers_field_counts(t: Tables) -> DataFrame:
    """How many answers have each field that the schema doesn't have, and of how many kinds."""
    found = records.other_fields(records.extract(t.sql(OWN_FIELDS)))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"))
