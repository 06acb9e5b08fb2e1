"""The corpus pipeline: stages over `documents`, each a whole table in and out.

Every stage works on what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import jaccard_join, language_id, line_dedup, mixing, packing, store

#: What the latest call of each stage has left in the shared folder, by thread, input and stage.
_left: dict[tuple[int, str, int], set[str]] = {}


def stage(number: int):
    """A stage that, called by itself, first deletes what the one before it left: its result has been written.

    What it deletes was made by the same thread for the same input; run() keeps its own account.
    """

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            store.bound_batches(spark)
            mine = threading.get_ident(), sf_dir
            store.clear(spark, _left.pop((*mine, number - 1), set()), docs)
            with store.recording(_left.setdefault((*mine, number), set())):
                return f(spark, docs, sf_dir)

        return run_stage

    return wrap


@stage(1)
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the language they are said to be in stay; a null language is filled in.

    A document goes if its text has no letter, looks like no language that was learned, or is
    surely in another one than its own.
    """
    return language_id.known_languages(docs)


@stage(2)
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines, of one line too, are deleted; a document without a word left goes.

    n_chars is the length of what is left.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup.line_dedup(docs, min_lines=1, carry=rest).where(F.col("n_removed") < F.col("n_lines"))
    return out.select("doc_id", F.col("kept_text").alias("text"), *(F.col(f"__{c}").alias(c) for c in rest), F.length("kept_text").cast("long").alias("n_chars")).select(*docs.columns)


@stage(3)
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles, the one with the smallest id stays.

    Repeated rows stay once; a document without an id stays if none in its group has one.
    """
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


@stage(4)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mix(docs)


@stage(5)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document taken twice has its pieces twice."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Language ID and packing are beyond SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, in order."""
    store.bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, f in STAGES[:-1]:
        left: set[str] = set()
        with store.recording(left):
            docs = store.materialize(f.__wrapped__(spark, docs, sf_dir), name.replace(" ", "-"))
        store.clear(spark, left, docs)
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
