"""Classification records: JSON out of answers, label validation, class lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.semistructured import braced, is_json
from faultlens.functions.text import get, lookup
from faultlens.sources import shared

# The closed label set and the class tables.
LABELS = (
    "stack_buffer_overflow", "heap_buffer_overflow", "format_string", "use_after_free", "double_free", "command_injection",
    "sql_injection", "path_traversal", "integer_overflow", "logic_bug", "memory_corruption_generic", "unknown",
)
DELIVERY = {
    "command_injection": "injection_based",
    "sql_injection": "injection_based",
    "stack_buffer_overflow": "memory_corruption",
    "heap_buffer_overflow": "memory_corruption",
    "format_string": "format_string_exploitation",
}
OTHER_DELIVERY = "file_based"
STRATEGY = {"Low": "direct_shellcode", "Medium": "rop_chain"}
OTHER_STRATEGY, NO_STRATEGY = "advanced_bypass", "direct_exploitation"

#: Protections of the prompt, in its order, and their columns.
PROTECTIONS = {"ASLR": "aslr", "NX": "nx", "PIE": "pie", "Stack Canaries": "canary"}

CLASSIFICATION = T.StructType(
    [T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in ("vulnerability_type", "confidence", "reasoning", "severity", "attack_vector", "impact", "technical_details")]
)


def extract(responses: DataFrame, key: str = "id", text: str = "response", schema: T.StructType = CLASSIFICATION) -> DataFrame:
    """key, json (null if invalid), record, error and raw_response of every answer.

    The text from the first { to the last } must be one JSON value; else the row has an
    error and the raw answer, and no record.
    """
    body = braced(get(F.col(text), ""))
    valid = is_json(body) & (body != "")
    out = responses.select(key, F.col(text), F.when(valid, body).alias("json"))
    error = F.when(F.col("json").isNull(), "Failed to parse JSON response")
    return out.select(key, "json", F.from_json("json", schema).alias("record"), error.alias("error"), F.when(error.isNotNull(), F.col(text)).alias("raw_response"))


def other_fields(found: DataFrame, key: str = "id", schema: T.StructType = CLASSIFICATION) -> DataFrame:
    """key, name, kind and value (JSON) of every field of an answer that the schema doesn't have.

    found: what extract() gives.  Answers are parsed as variants, so fields that a model made up
    are kept with their nested values, whose keys come by name.  kind: string, number, boolean, null, list or object.
    An answer that isn't valid has no fields, nor has one that names a field twice.
    """
    known = ", ".join(f"'{f.name}'" for f in schema.fields)
    rows = found.sparkSession.sql(
        f"SELECT t.`{key}`, v.key AS name, schema_of_variant(v.value) AS kind, to_json(v.value) AS value FROM {{t}} AS t, LATERAL variant_explode(try_parse_json(t.json)) AS v WHERE v.key NOT IN ({known})", t=found.select(key, "json")
    )
    kinds = F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "list").when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "VOID", "null").otherwise("number")
    return rows.select(key, "name", kinds.alias("kind"), F.when(F.col("kind") == "VOID", "null").otherwise(F.col("value")).alias("value"))


def field(json: Column, path: str, kind: str, default) -> Column:
    """A typed value at a path of an answer, or the default if it isn't there or of another type."""
    return get(F.try_variant_get(F.try_parse_json(json), path, kind), default)


def classify(rows: DataFrame, answer: Callable[[list[str]], list[str]], key: str = "id", text: str = "context", batch: int = 64, cache: str | None = None) -> DataFrame:
    """key, response and error of a caller's own model for each prompt.

    The one place where Python sees rows: answer takes up to `batch` texts and returns as
    many.  Equal prompts are asked once.  If answer raises, or returns another number of
    texts, the rows of that batch have its message as error, and no response.

    cache: a folder where responses stay by the digest of their prompt; what is there isn't
    asked again, in later calls too.  Errors don't stay.  A null prompt is asked as an empty one.
    """
    spark = rows.sparkSession
    asked = rows.select(key, get(F.col(text), "").alias("prompt")).withColumn("digest", F.sha2("prompt", 256))
    todo = asked.groupBy("digest").agg(F.first("prompt").alias("prompt"))
    held = None
    if cache is not None:
        try:
            held = spark.read.schema("digest string, response string").parquet(cache)
            todo = todo.join(held, "digest", "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise

    def run(frames):
        for b in frames:
            for k in range(0, len(b), batch):
                part = b[k : k + batch]
                prompts = part["prompt"].tolist()
                try:
                    got = list(answer(prompts))
                    if len(got) != len(prompts):
                        raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
                    yield part[["digest"]].assign(response=got, error=None)
                except Exception as e:  # noqa: BLE001  one batch's failure is its rows' error
                    yield part[["digest"]].assign(response=None, error=f"{type(e).__name__}: {e}")

    new = shared.written(todo.mapInPandas(run, "digest string, response string, error string"), "answers")
    if cache is not None:
        new.where("error IS NULL").select("digest", "response").write.mode("append").parquet(cache)
    known = new if held is None else new.unionByName(held.withColumn("error", F.lit(None).cast("string")))
    answers = known.groupBy("digest").agg(F.max("response").alias("response"), F.max("error").alias("error"))
    return asked.join(answers, "digest", "left").select(key, "response", "error")


def valid_label(c: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.when(c.isin(*labels), c).otherwise("unknown")


def delivery(c: Column) -> Column:
    return lookup(c, DELIVERY, OTHER_DELIVERY)


def strategy(level: Column) -> Column:
    """A class for a protection level; a missing document has its own."""
    return F.when(level.isNull(), NO_STRATEGY).otherwise(lookup(level, STRATEGY, OTHER_STRATEGY))


# Headings and labels of the prompt, which answers are asked by.
def prompt(groups: DataFrame, sources: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The context text of each group: its facts, and source and protections where there are any.

    sources: target_id, source_code.  scores: target_id and what hardening.score returns.
    """
    head = F.concat(F.lit("CRASH ANALYSIS DATA:\n- Crash Frame: "), "frame", F.lit("\n- Number of crashes: "), F.col("cnt").cast("string"), F.lit("\n- Sample crash file size: "), F.col("size").cast("string"), F.lit(" bytes"))
    out, parts = groups, [head]
    if sources is not None:
        out = out.join(sources.select("target_id", "source_code"), "target_id", "left")
        parts.append(F.when(F.col("source_code").isNotNull(), F.concat(F.lit("SOURCE CODE:\n"), "source_code")))
    if scores is not None:
        have = scores.select("target_id", F.lit(True).alias("scored"), "protection_level", *PROTECTIONS.values())
        out = out.join(have, "target_id", "left")
        states = [F.concat(F.lit(f"\n- {name}: "), F.when(get(F.col(c), False), "Enabled").otherwise("Disabled")) for name, c in PROTECTIONS.items()]
        parts.append(F.when(F.col("scored"), F.concat(F.lit("BINARY PROTECTIONS:\n- Protection Level: "), get(F.col("protection_level"), "Unknown"), *states)))
    return out.select(*groups.columns, F.concat_ws("\n\n", *parts).alias("context"))


def metadata(records: DataFrame, *keys: str) -> DataFrame:
    """A descriptive record of each classification: name, type, basename, confidence, severity, after keys."""
    base = F.element_at(F.split("binary_path", "/"), -1)
    kind = get(F.col("vulnerability_type"), "unknown")
    return records.select(*keys, F.concat_ws("_", kind, base).alias("name"), kind.alias("vulnerability_type"), base.alias("target"), get(F.col("confidence"), 0.0).alias("confidence"), get(F.col("severity"), "Unknown").alias("severity"))
