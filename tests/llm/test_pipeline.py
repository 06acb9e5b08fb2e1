"""The pipeline against brute force, stage by stage on the same rows."""

import random
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
from faultlens.llm import language_id, mixing

from .helpers import cut_lines, edge_rows, link_groups, passage, shingles, words
from .test_packing_mixing import brute_pieces, check_places


def brute_until_mixing(rows):
    """From the rows that language ID keeps: line dedup, one document of each group."""
    kept = {(d, i): k for i, (d, n, gone, k) in enumerate(cut_lines(rows, 1)) if gone < n}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    rows = [(rows[i][0], kept[rows[i][0], k], rows[i][2], rows[i][3], len(kept[rows[i][0], k])) for k, i in enumerate(order) if (rows[i][0], k) in kept]
    lead = [r for r, (d, _, c) in zip(rows, link_groups(rows, 80, 100, 5), strict=True) if d == c]
    return list({(r[0], r[1]): r for r in lead}.values())


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_match_brute_force(spark, tmp_path):
    rows = [*edge_rows(), *((60 + k, f"a long text {c * 1_200_000} {passage(k, 30)}", "en", "s0", None) for k, c in enumerate(" \t\n"))]
    sf_dir = write(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
    assert all(set(r[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for r in out[:4])
    assert not {(r["doc_id"], r["text"]) for r in out[0]} - {(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")}
    want = brute_until_mixing([tuple(r) for r in out[0]])
    assert Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in out[2]) == Counter((r[0], r[1], r[3], r[4]) for r in want)
    took = Counter((r["doc_id"], r["text"]) for r in out[3])
    report = {(r["doc_id"], r["size"]): r for r in mixing.mix_report(spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert all(took[r[0], r[1]] * len(words(r[1])) == report[r[0], len(words(r[1]))]["taken"] for r in want)
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out[4])
    assert pieces == Counter(brute_pieces([(r["doc_id"], r["text"]) for r in out[3]]))
    check_places(out[4])
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in ran) == pieces


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, [], tmp_path)).collect() == []


def test_language_id_rejects_what_is_in_another_language(spark):
    r, words_of = random.Random(4), {"de": "der und die nicht ein schön wird auch", "en": "the and with that from this which"}
    text = lambda v: " ".join(r.choice(words_of[v].split()) for _ in range(40))
    rows = [(d, text("de" if d % 2 else "en"), "de" if d % 2 else "en", f"own{d}") for d in range(200)] + [(303, text("de"), "en", "x"), (301, text("en"), None, "x"), (302, "12 34", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `__lang_pred` string")
    kept = language_id.known_languages(docs).collect()
    assert sorted(x["doc_id"] for x in kept) == [*range(200), 301] and {x["doc_id"]: x["lang"] for x in kept}[301] == "en"
    assert all(x["__lang_pred"] == f"own{x['doc_id']}" for x in kept if x["doc_id"] < 200)


def test_near_copies_by_five_words_are_linked(spark):
    """Pairs at 0.8 or more of five words and under 0.9 of three words, and one under both."""
    p, q = passage(1, 300).split(), passage(2, 300).split()
    rows = [(1, " ".join(p)), (2, " ".join([*p[:100], "zz", *p[101:200], "yy", *p[201:], *passage(3, 30).split()])), (3, " ".join(q)), (4, " ".join([*q[:200], *passage(4, 100).split()]))]
    near = lambda x, y, n: len(shingles(x, n) & shingles(y, n)) / len(shingles(x, n) | shingles(y, n))
    assert near(rows[0][1], rows[1][1], 5) >= 0.8 and near(rows[0][1], rows[1][1], 3) < 0.9 and near(rows[2][1], rows[3][1], 5) < 0.8
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 3, 4]


def test_clean_documents_pass_the_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert language_id.known_languages(docs).count() == docs.count()


def test_texts_with_letters_stay_when_nothing_could_be_learned(spark):
    docs = spark.createDataFrame([(1, "clean words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.known_languages(docs).collect()] == [(1, "clean words", None)]
    assert {r["lang_pred"] for r in language_id.language_id(docs).collect()} == {"und"}


def test_the_entry_lists_every_operator():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    per = defaultdict(list)
    for n in names:
        if n.startswith("op"):
            per[int(n[2:].split("_")[0])].append(n)
    assert sorted(per) == list(range(1, 11)) and all(len(v) == 1 for v in per.values())
    assert {"op1_line_dedup", "op3_substring_dedup", "op4_quality_rules", "op5_mix_sources", "op10_jaccard_join"} <= set(entry.oracle_sql())
