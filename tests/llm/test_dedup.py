import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultlens.llm import jaccard_join, keybits, line_dedup, quality_rules, store, substring_dedup
from faultlens.llm import textarrays as ta

from .helpers import SCHEMA, cut_lines, cut_windows, edge_docs, edge_rows, link_groups, passage, sha, words


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_substring_dedup_matches_brute_force(spark):
    got = collected(substring_dedup.substring_dedup(edge_docs(spark)), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(cut_windows(edge_rows()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_small_alphabets(spark, seed):
    r = random.Random(seed)
    rows = [(d, " ".join(r.choice("ab" if d % 2 else "abcdefgh") for _ in range(r.randint(0, 120))), None, None, None) for d in range(40)]
    got = collected(substring_dedup.substring_dedup(edge_docs(spark, rows)), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(cut_windows(rows), key=repr)


def test_equal_windows_have_equal_anchors():
    """What the candidate search rests on, over texts with runs and repeats."""
    r = random.Random(5)
    for _ in range(60):
        core = [r.choice("abc") for _ in range(13)]
        keys = set()
        for _ in range(6):
            w = [r.choice("abcx") for _ in range(r.randint(0, 9))] + core + [r.choice("abcx") for _ in range(r.randint(0, 9))]
            h = ta.mix(np.array([ord(c) for c in w], np.uint64))
            at, key = substring_dedup.anchors(h, np.array([0, len(w)]), 13)
            keys |= {int(key[i]) for i in range(len(at)) if w[at[i] : at[i] + 13] == core}
        assert len(keys) == 1


def test_line_dedup_matches_brute_force(spark):
    rows = edge_rows()
    got = collected(line_dedup.line_dedup(edge_docs(spark)), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == sorted(cut_lines(rows), key=repr)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_line_dedup_on_few_distinct_lines(spark, k):
    r = random.Random(k)
    rows = [(d, "\n".join(r.choice(["a", "b", "c c", "", "d", "  "]) for _ in range(r.randint(0, 40))), None, None, None) for d in range(30)]
    got = collected(line_dedup.line_dedup(edge_docs(spark, rows), min_lines=k), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == sorted(cut_lines(rows, k), key=repr)


def test_longest_run_is_the_longest_common_prefix_of_neighbours(spark):
    lines = [passage(k, 5) for k in range(9)]
    rows = [(1, "\n".join(lines), None, None, None), (2, "\n".join(["x", *lines[2:8], "y"]), None, None, None)]
    got = collected(line_dedup.line_dedup(edge_docs(spark, rows)), "doc_id", "n_removed", "n_runs", "longest_run")
    assert [g[:3] for g in got] == [(1, 0, 0), (2, 6, 1)] and max(g[3] for g in got) == 6


def test_op1_and_the_stage_delete_runs_of_one_line(spark, tmp_path):
    """Copies of one-line documents, and a long line between other neighbours."""
    p, q = passage(1, 60), passage(2, 60)
    rows = [(1, p, None, "s", None), (2, p, None, "s", None), (3, f"a b\n{q}\nc d", None, "s", None), (4, f"e f\n{q}\ng h", None, "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = cut_lines(rows, 1)
    got = collected(line_dedup.query(spark, str(tmp_path)), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted((d, n, gone, sha(k)) for d, n, gone, k in want)
    stage = collected(corpus_pipeline.without_repeated_lines(spark, docs, str(tmp_path)), "doc_id", "text")
    assert stage == sorted((d, k) for d, n, gone, k in want if gone < n) and [d for d, _ in stage] == [1, 3, 4]


def brute_runs(rows, k):
    """op1's n_runs and longest_run by brute force: stretches of removed lines, and the longest shared run."""
    seqs = [[x for x in (t or "").split("\n") if words(x)] if d is not None else [] for d, t, *_ in rows]
    places = [(i, j) for i, s in enumerate(seqs) for j in range(len(s))]
    longest = [0] * len(rows)
    for i, j in places:
        for x, y in places:
            if (i, j) != (x, y):
                n = 0
                while j + n < len(seqs[i]) and y + n < len(seqs[x]) and seqs[i][j + n] == seqs[x][y + n]:
                    n += 1
                longest[i] = max(longest[i], n if n >= k else 0)
    return longest


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_longest_run_matches_brute_force(spark, k):
    r = random.Random(40 + k)
    copied = [f"line {x}" for x in range(45)]
    rows = [(d, "\n".join(r.choice(["a", "b", "c c", "", "d", f"u{r.random()}"]) for _ in range(r.randint(0, 14))), None, None, None) for d in range(16)]
    rows += [(20, "\n".join(copied), None, None, None), (21, "\n".join(["q", *copied[:33], "r", *copied[20:], "a"]), None, None, None), (22, "\n".join(["a"] * 30), None, None, None)]
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(edge_docs(spark, rows), min_lines=k).collect()}
    assert [got[d]["longest_run"] for d, *_ in rows] == brute_runs(rows, k)
    cut = {d: (n, gone, kept) for d, n, gone, kept in cut_lines(rows, k)}
    assert all((x["n_lines"], x["n_removed"], x["kept_text"]) == cut[d] for d, x in got.items())


def test_common_prefixes_decide_what_is_deleted(spark, monkeypatch):
    """Without the prefixes no interval is left, so nothing is deleted."""
    real = line_dedup.common_prefixes
    monkeypatch.setattr(line_dedup, "common_prefixes", lambda array, table: real(array, table).withColumn("lcp", F.lit(0)))
    rows = [(1, "a\nb\nc", None, None, None), (2, "a\nb\nc", None, None, None)]
    assert [r["n_removed"] for r in line_dedup.line_dedup(edge_docs(spark, rows)).collect()] == [0, 0]


def test_line_dedup_wants_a_positive_length(spark):
    with pytest.raises(ValueError):
        line_dedup.line_dedup(edge_docs(spark), min_lines=0)


def test_jaccard_join_matches_brute_force(spark):
    rows = edge_rows()
    got = collected(jaccard_join.jaccard_join(edge_docs(spark)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(link_groups(rows), key=repr)


@pytest.mark.parametrize(("n", "edits"), [(40, 1), (120, 3), (300, 7)])
def test_jaccard_join_near_the_threshold(spark, n, edits, monkeypatch):
    """Many near copies of one text, large groups, blocks of few sets: no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)
    monkeypatch.setattr(jaccard_join, "FEW", 5)
    monkeypatch.setattr(jaccard_join, "SHARES", (0.2, 1.0))
    r, base, rows = random.Random(n), passage(n, n).split(), []
    for d in range(60):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n)] = r.choice(["zz", "yy", f"n{r.randint(0, 9)}"])
        rows.append((d, " ".join(w), None, None, None))
    got = collected(jaccard_join.jaccard_join(edge_docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(link_groups(rows), key=repr)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (60, 100)])
def test_similar_sets_share_a_signature(num, den):
    """Pairs just above the threshold, of all small sizes and some large ones, equal or not in size; empty signatures are rare."""
    r = np.random.default_rng(num)
    bands, empty = jaccard_join.Bands(num, den), 0
    for size in [*range(1, 60)] * 8 + [100, 250, 700, 2000] * 4:
        shared = size
        spare = shared * (den - num) // num  # so many elements may be in one set only
        left = int(r.integers(0, spare + 1))
        new = r.integers(0, 1 << 63, shared + spare, np.uint64)
        x, y = np.unique(new[: shared + left]), np.unique(np.concatenate([new[:shared], new[shared + left :]]))
        assert den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))
        first = np.array([0, len(x), len(x) + len(y)])
        sig, row = jaccard_join.signatures(np.concatenate([x, y]), first, bands)
        assert np.intersect1d(sig[row == 0], sig[row == 1]).size
        z = np.unique(r.integers(0, 1 << 63, len(x), np.uint64))
        other, _ = jaccard_join.signatures(z, np.array([0, len(z)]), bands)
        empty += size >= 100 and np.intersect1d(sig, other).size > 0
    assert num < 80 or empty <= 1  # there, large sets can drop their empty signatures


def test_rows_that_repeat_and_rows_without_an_id_stay_once(spark, monkeypatch):
    """Also when the bitmap takes every key for one of those that go."""
    rows = [(d, passage(d, 30), "en", "s", None) for d in (1, 2, 3)] * 3 + [(4, passage(1, 30), "en", "s", None)] * 2
    rows += [(None, passage(k, 30), None, None, None) for k in (1, 8, 8, 9)] + [(5, None, None, None, None)] * 2
    for words in (keybits.WORDS, 1):
        monkeypatch.setattr(keybits, "WORDS", words)
        got = collected(jaccard_join.one_of_each(edge_docs(spark, rows)), "doc_id", "text")
        assert got == sorted([(d, passage(d, 30)) for d in (1, 2, 3)] + [(None, passage(k, 30)) for k in (8, 9)] + [(5, None)], key=repr)


def test_one_of_each_keeps_one_row_of_a_group(spark):
    rows = edge_rows()
    kept = jaccard_join.one_of_each(edge_docs(spark)).collect()
    ids = [r["doc_id"] for r in kept]
    comps = {c for d, n, c in link_groups(rows) if d is not None}
    assert sorted(i for i in ids if i is not None) == sorted(comps)
    assert {r["cid"] for r in kept} == {"clash"}


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, line_dedup.line_dedup, jaccard_join.jaccard_join, jaccard_join.one_of_each])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_no_link_is_lost_between_chunks(spark, seed):
    """Small groups of near copies dealt over many chunks, where those met in a chunk needn't be similar."""
    r, rows = random.Random(100 + seed), []
    for g in range(25):
        base = passage(1000 * seed + g, 60).split()
        for _ in range(r.randint(2, 7)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(60)] = r.choice(["zz", "yy", "xx"])
            rows.append((len(rows), " ".join(w), None, None, None))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = collected(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(link_groups(rows), key=repr)


def twins(n):
    """Two complementary words of n letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [256, 1024, 4096, 65536])
def test_complementary_texts_are_different(spark, n):
    """As words, as lines, and as sequences of words, in all operators that compare names."""
    a, b = twins(n)
    spread = lambda t: " ".join(t[:4096])
    tail = " ".join(f"w{k}" for k in range(12))
    texts = [f"{a}\nsame line", f"{b}\nsame line", f"{a} {tail}", f"{b} {tail}", f"{a} x", f"{b} x", f"{a}\n{b}", spread(a), spread(b), f"{spread(a)}\n{spread(b)}\n{spread(a)}"]
    rows = [(d, t, None, None, None) for d, t in enumerate(texts)]
    docs = edge_docs(spark, rows)
    assert collected(line_dedup.line_dedup(docs, min_lines=1), "doc_id", "n_lines", "n_removed", "kept_text") == sorted(cut_lines(rows, 1), key=repr)
    assert collected(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(cut_windows(rows), key=repr)
    assert collected(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == sorted(link_groups(rows), key=repr)
    assert collected(quality_rules.quality_rules(docs), "doc_id", "n_dup_lines") == [(d, len(t.split("\n")) - len(set(t.split("\n")))) for d, t in enumerate(texts)]


def test_names_are_exact_up_to_fifteen_bytes_and_see_every_byte():
    words = [x * n for n in (1, 7, 8, 9, 15, 16, 17, 40) for x in "ab"] + ["a\0", "a\0\0", "\0", "\0\0", "a" * 15 + "\0", "a" * 14 + "\0", "b" + "a" * 39, "a" * 39 + "b"]
    chunk = next(ta.chunks(pa.array([" ".join(words)])))
    assert len(set(zip(*(x.tolist() for x in chunk.word_names()), strict=True))) == len(set(words))
    a = np.arange(1000, dtype=np.uint64)
    assert len(set(zip(*(x.tolist() for x in ta.scramble(a, a[::-1].copy())), strict=True))) == 1000
    for k in range(1, 9):
        got = {}
        for i, h in enumerate(ta.windows(a[[0, 1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 1, 1, 0, 0, 1]], k).tolist()):
            got.setdefault(h, set()).add("0101100101011001"[i : i + k])
        assert all(len(v) == 1 for v in got.values()) and len(got) == len({"0101100101011001"[i : i + k] for i in range(17 - k)})


def test_a_block_counts_exactly_and_gives_no_more_links_than_it_joins(monkeypatch):
    """Near copies that are all alike gave a row per pair; now a row per class at most, and none is lost."""
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 60, 3000).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base[:200], 190, replace=False), r.choice(base, 5)])) for _ in range(90)]
    x, y = np.arange(30), np.arange(30, 90)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]
    assert jaccard_join.shared_counts(sets, x, y).tolist() == want
    names = [b"%02d" % k for k in range(90)]
    both = [(k, True) for k in range(90)] + [(k, False) for k in range(90)]
    table = pa.table({
        "class": [names[k] for k, _ in both], "root": [names[k] for k, _ in both], "size": [len(sets[k]) for k, _ in both], "items": [sets[k].tobytes() for k, _ in both],
        "guest": [g for _, g in both], "upper": [False] * 180, "main": [False] * 180,
    })
    found = jaccard_join.compare_blocks(80, 100)(table).to_pylist()
    root = list(range(90))
    for f in found:
        a, b = (root[names.index(f[c])] for c in "ab")
        assert a != b
        root = [a if k == b else k for k in root]
    linked = [(i, j) for i in range(90) for j in range(i) if jaccard_join.linked_sets(sets[i], sets[j], 80, 100)]
    assert len(linked) > 1000 and all(root[i] == root[j] for i, j in linked)


def test_a_block_of_near_copies_takes_little_memory(monkeypatch):
    """Pairs of a large group are worked on some rows at a time: 3,000 guests and 5,000 others, with links and without."""
    r = np.random.default_rng(1)
    rows, base = [], r.integers(0, 1 << 63, 60).astype(np.uint64)
    for k in range(8000):
        own = base.copy()
        own[r.choice(60, 8, False)] = r.integers(0, 1 << 63, 8).astype(np.uint64)
        own.sort()
        rows.append({"guest": k < 3000, "upper": False, "main": k >= 3000, "class": b"%05d" % k, "root": b"%05d" % k, "size": 60, "items": own.tobytes()})
    rows[0]["items"] = rows[7000]["items"]
    table = pa.Table.from_pylist(rows)
    got = []
    for cells in (jaccard_join.CELLS, 1 << 40):
        monkeypatch.setattr(jaccard_join, "CELLS", cells)
        tracemalloc.start()
        found = jaccard_join.compare_blocks(90, 100)(table).to_pylist()
        got.append((tracemalloc.get_traced_memory()[1] / 1e6, found))
        tracemalloc.stop()
    assert got[0][1] == got[1][1] == [{"a": b"00000", "b": b"07000"}]
    assert got[0][0] < 90 < got[1][0]


def test_the_pipeline_bounds_batches_but_keeps_what_the_session_says(spark):
    key, before = store.ROWS_KEY, spark.conf.get(store.ROWS_KEY, None)
    try:
        spark.conf.unset(key)
        store.bound_batches(spark)
        assert spark.conf.get(key) == str(store.ROWS)
        spark.conf.set(key, 77)
        store.bound_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
