import random
import time
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from faultlens.llm import mixing, packing, token_counts

from .helpers import SCHEMA, edge_docs, edge_rows, words


def brute_pieces(rows, limit=1024):
    t = Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        at, size, k = 0, len(ids) % limit or limit, 0
        while at < len(ids):
            out.append((d, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, k, size = at + size, k + 1, limit
    return out


def check_places(rows):
    """Sequences are filled without gaps and hold at most 1024 tokens; returns how many there are."""
    per = defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(per)


def test_packing_cuts_encodes_and_places_every_piece(spark):
    rows = [*edge_rows(), (40, "a <|endoftext|> b", None, None, None), (41, "it's  two\n\n lines'll \t do 123", None, None, None)]
    got = packing.pack(edge_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(brute_pieces(rows), key=repr)
    check_places(got)


def test_plans_use_every_piece_once_and_few_sequences():
    r = random.Random(3)
    for _ in range(20):
        count = np.zeros(1025, np.int64)
        for _ in range(r.randint(1, 60)):
            count[r.randint(1, 1024)] += r.randint(1, 500)
        plan = packing.plan(count, 1024)
        used = np.zeros(1025, np.int64)
        for times, content in plan:
            assert times > 0 and sum(n * k for n, k in content) <= 1024
            for n, k in content:
                used[n] += times * k
        assert (used == count).all()
    count = np.zeros(1025, np.int64)
    count[[600, 300, 124, 700, 324, 1024]] = 5
    assert sum(t for t, _ in packing.plan(count, 1024)) == 15


def test_exact_complements():
    have = np.zeros(1025, np.int64)
    have[[10, 20, 30]] = 1
    assert packing.exact(have, 30, 3) == (30,)
    assert packing.exact(have, 50, 3) == (30, 20)
    assert packing.exact(have, 60, 3) == (30, 20, 10)
    assert packing.exact(have, 60, 2) is None and packing.exact(have, 40, 3) == (30, 10) and packing.exact(have, 20, 3) == (20,)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_targets(sizes):
    """Shares by weight, capped at twice the source's size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    open_ = set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing_report(spark):
    rows = edge_rows()
    got = mixing.mix_report(edge_docs(spark)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    rounded = lambda d, n, s, t: (d, n, s, round(t, 6))
    assert sorted((rounded(r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got), key=repr) == sorted((rounded(r[0], len(words(r[1])), sizes[r[3]], want[r[3]]) for r in rows), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_report(edge_docs(spark)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_comes_near_its_targets_and_repeats_rows(spark):
    r = random.Random(1)
    rows = [(d, " ".join(["w"] * r.randint(1, 300)), None, "hot" if d % 3 == 0 else f"s{d % 7}", d) for d in range(3000)]
    docs = edge_docs(spark, rows)
    report = mixing.mix_report(docs).collect()
    source = {r[0]: r[3] for r in rows}
    took, aim = defaultdict(int), {}
    for x in report:
        took[source[x["doc_id"]]] += x["taken"]
        aim[source[x["doc_id"]]] = x["target"]
    assert all(abs(took[s] - aim[s]) <= 0.02 * aim[s] for s in aim)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {x["doc_id"]: x["n"] for x in mixed.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert all(n.get(x["doc_id"], 0) * x["size"] == x["taken"] for x in report)


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_token_counts_match_the_tokenizer(spark):
    vocabulary = token_counts.load_vocabulary(token_counts.default_vocabulary())
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    rows = [*edge_rows(), (50, "▁ ▁▁a b▁c", None, None, None), (51, "<0x0A> <s> 𝔘𝔙 x\n\n\ty  z ", None, None, None)]
    got = token_counts.token_counts(edge_docs(spark, rows)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(t.encode(r[1] or "").ids)) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got) == want


def test_token_scores_are_the_best_of_all_segmentations():
    vocabulary = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -3.5), ("aba", -6.0)]
    c = token_counts.Counter(vocabulary)
    scores = dict(vocabulary)

    def every(text):
        if not text:
            return [(0.0, 0)]
        return [(scores[text[:k]] + s, n + 1) for k in range(1, len(text) + 1) if text[:k] in scores for s, n in every(text[k:])]

    t = Tokenizer(models.Unigram([("<unk>", -99.0), *vocabulary], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    for text in ("a", "b", "ab", "aba", "abab", "bbaa", "ababab"):
        got = c.count(text)
        assert got.real == max(s for s, _ in every("▁" + text)) and int(got.imag) == len(t.encode(text).ids)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \r\n", "　"])
def test_two_million_blanks_have_the_tokenizers_ids(blank):
    t, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for text in (blank * (2_000_000 // len(blank)), f"a{blank * (packing.BLANKS // len(blank) - 1)}b", f"a {blank * packing.BLANKS}b"):
        assert np.array_equal(np.frombuffer(encode(text), "<u4"), t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("run", [1_000, 25_000, packing.BLANKS - 1])
def test_many_runs_of_blanks_take_linear_time(run):
    """10 MB of words between runs just too short for the tokenizer, of each kind and of all of them."""
    kinds = [" ", "\t", "\n", " \t\r\n", "\u00a0"]
    encode, n = packing.encoder(packing.default_tokenizer()), 10_000_000 // len(kinds) // run
    text = "".join(f"w{(blank * run)[:run]}" for blank in kinds for _ in range(n))
    begun = time.process_time()
    ids = encode(text)
    assert time.process_time() - begun < 30 and len(ids) > 4 * n
    short = text[: 3 * run]
    assert encode(short) == np.array(Tokenizer.from_file(packing.default_tokenizer()).encode(short, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = packing.pack(docs).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(brute_pieces([tuple(r) for r in docs.collect()]))
    tokens = sum(r["length"] for r in got)
    assert -(-tokens // 1024) <= check_places(got) <= 1.01 * tokens / 1024


def test_the_index_of_sums_finds_what_brute_force_finds():
    r = random.Random(11)
    for _ in range(30):
        have = np.zeros(65, np.int64)
        for _ in range(r.randint(1, 12)):
            have[r.randint(1, 64)] += r.randint(1, 2)
        sums = packing.Sums(have)
        while have.any():
            for gap in range(1, 65):
                pool = [x for x in range(1, 65) for _ in range(min(3, have[x]))]
                ways = [w for k in (1, 2, 3) for w in combinations(pool, k) if sum(w) == gap]
                fill = sums.exact(gap)
                assert (fill is not None) == bool(ways) and (not fill or (sum(fill) == gap and tuple(sorted(fill)) in ways and len(fill) == min(map(len, ways))))
            have[r.choice(np.flatnonzero(have).tolist())] -= 1


def test_token_counts_of_a_whole_table(spark):
    t = Tokenizer(models.Unigram(token_counts.load_vocabulary(token_counts.default_vocabulary()), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert got == {d: len(t.encode(x or "").ids) for d, x in docs.collect()}


def test_long_stretches_are_counted_in_bounded_memory():
    """A stretch of a million letters, with characters of no piece in it, against the tokenizer."""
    import tracemalloc

    vocabulary = token_counts.load_vocabulary(token_counts.default_vocabulary())
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh𝔘") for _ in range(300_000))
    c = token_counts.Counter(vocabulary)
    tracemalloc.start()
    n = c.count(text).imag
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(t.encode(text).ids) and peak < 20e6


def test_token_counts_of_nothing(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []
    got = token_counts.token_counts(spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], SCHEMA)).collect()
    assert [(r["n_tokens"], r["score"]) for r in got] == [(0, 0.0)] * 2


def test_short_and_long_stretches_have_the_same_counts():
    c = token_counts.Counter(token_counts.load_vocabulary(token_counts.default_vocabulary()))
    r = random.Random(9)
    for _ in range(500):
        stretch = "▁" + "".join(r.choice("etaoinsrh.,𝔘é日\n") for _ in range(r.randint(0, token_counts.LONG - 1)))
        assert c.best(stretch) == c.best_of_long(stretch)
