import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from faultlens.llm import attention, lm_scoring

from .helpers import SCHEMA, edge_docs, edge_rows, passage, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by counting tokens."""
    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    tokens = [[*words(lower(t)), "\n"] for _, t, *_ in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for (d, *_), h, t in zip(rows, held, tokens, strict=True)]


def scores(spark, docs):
    return lm_scoring.lm_scores(docs, trained=20_000).collect()


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 3))
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_base_counts_and_scores_equal_brute_force(spark):
    rows = edge_rows() + [(50, "Tokens TOKENS tokens x   y   z \x85", None, None, None), (51, "q" * 300 + " " + "é日" * 90, None, None, None)]
    got = scores(spark, edge_docs(spark, rows))
    same(got, brute_base(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 4))
    assert by[1] == by[2] and len(by[8] | by[6] | by[7]) == 1 and len(by[1]) == 1


def test_nothing_to_learn_from(spark):
    assert scores(spark, spark.createDataFrame([], SCHEMA)) == []
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    rows = [(held[0], "a b", None, None, None), (held[1], None, None, None, None), (None, "a", None, None, None)]
    got = scores(spark, spark.createDataFrame(rows, SCHEMA))
    same(got, brute_base(rows))
    assert all(math.isfinite(r["score"]) for r in got)


def small_model(texts=3000, epochs=4, seed=1):
    """A model of texts that count on by 1 or by 5 modulo 12: of two kinds, which only earlier ids tell."""
    r = random.Random(seed)
    counts = np.zeros(60)
    flat = []
    for _ in range(texts):
        step = r.choice((1, 5))
        at, text = r.randrange(12), [59]
        for _ in range(attention.WINDOW):
            text.append(at)
            at = (at + step) % 12
        flat.append(text)
    np.add.at(counts, np.array(flat).ravel(), 1)
    counts[58] = texts
    return attention.Model(counts).train(np.array(flat), epochs=epochs), np.array(flat)


def test_the_model_learns_what_it_must_attend_to():
    """Whoever sees the last id alone has an even chance at best; the one before it tells which kind it is."""
    model, flat = small_model(epochs=12)
    x, y = model.rows[flat[:200, :-1]], model.rows[flat[:200, 1:]]
    first = np.arange(0, x.size + 1, x.shape[1])
    mean = model.tables().score(x.ravel(), y.ravel(), first).sum() / x.size
    assert mean > math.log10(0.6) > math.log10(0.5)


@pytest.mark.parametrize("size", [1, 2, 31, 32, 33, 56, 57, 200])
def test_windows_score_each_id_once(size):
    """Each place by itself: its window from the model's plain forward pass, and the distribution there sums to one."""
    model, _ = small_model(200)
    r = np.random.default_rng(size)
    x, y = r.integers(0, 60, size), r.integers(0, 59, size)
    total = 0.0
    for t in range(size):
        begin = 0 if t < attention.WINDOW else -(-(t + 1 - attention.WINDOW) // attention.SCORED) * attention.SCORED
        window = np.zeros(attention.WINDOW, np.int64)
        window[: min(attention.WINDOW, size - begin)] = model.rows[x[begin : begin + attention.WINDOW]]
        pi = model.forward(window[None])["pi"][0, t - begin].astype(np.float64)
        p = model.T[model.rows].astype(np.float64) @ pi
        assert abs(p[:-1].sum() - 1) < 1e-4 and p[-1] < 1e-6
        total += math.log10(p[y[t]])
    pad = r.integers(0, 60, 7)  # other texts before and behind change nothing
    rows = model.rows[np.concatenate([pad, x, pad])]
    to = model.rows[np.concatenate([pad, y, pad])]
    got = model.tables().score(rows, to, np.array([0, 7, 7, 7 + size, 14 + size]))
    assert np.isclose(got[2], total, rtol=1e-4) and got[1] == 0


def test_gradients_are_those_of_small_steps():
    r = np.random.default_rng(3)
    model, flat = small_model(50)
    x, y = model.rows[flat[:4, :-1]], model.rows[flat[:4, 1:]]

    def loss():
        f = model.forward(x)
        return -np.log((f["pi"].astype(np.float64) * model.T[y]).sum(2)).mean()

    f = model.forward(x)
    joint = f["pi"] * model.T[y]
    g = model.gradients(x, f, (f["pi"] - joint / joint.sum(2, keepdims=True)) / np.float32(x.size))
    for name, v in model.p.items():
        direction = r.normal(size=v.shape).astype(np.float32)
        if name == "E":
            direction[np.setdiff1d(np.arange(len(v)), x)] = 0
        keep, step = v.copy(), 1e-2
        model.p[name] = keep + np.float32(step) * direction
        up = loss()
        model.p[name] = keep - np.float32(step) * direction
        down = loss()
        model.p[name] = keep
        slope = float((g[name] * direction).sum())
        assert abs((up - down) / (2 * step) - slope) < 0.05 * abs(slope) + 2e-3, name


def test_words_are_encoded_each_by_itself():
    e = lm_scoring.encoder(lm_scoring.ranks_path())
    some = ["the", "naïve", "x" * 500, "a b", " ", "日本語", "'s", "123abc", "...", "\x1c", "é" * 65]
    ids, sizes = e.words(some)
    ends = np.cumsum(sizes)
    for w, i, j in zip(some, ends - sizes, ends, strict=True):
        assert e.plain.decode(ids[i:j].tolist()) == f" {w}" and ids[i:j].tolist() == e.words([w])[0].tolist()
    assert [len(x) for x in e.words([])] == [0, 0]


def test_tokens_of_a_chunk_follow_their_texts(spark):
    rows = [(1, "B a", None, None, None), (2, "", None, None, None), (3, f"a {passage(1, 50)} b", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).select("doc_id", "text")
    table = docs.mapInArrow(lm_scoring.chunk_rows(lm_scoring.ranks_path()), lm_scoring.ROW).collect()
    e = lm_scoring.encoder(lm_scoring.ranks_path())
    for r in table:
        c = lm_scoring.Chunk(r.asDict())
        x, first = c.tokens()
        for k, d in enumerate(c.ids):
            text = x[first[k] : first[k + 1]]
            assert text[0] == lm_scoring.BEGIN
            assert e.plain.decode(text[1:].tolist()) == "".join(f" {w}" for w in words(lower(dict((q[0], q[1]) for q in rows)[d])))


def ordered_docs(spark, backward, parts):
    """Training texts that count on, or back; texts 1 and 2 (ids of none of them) count on."""
    ids = [d for d in range(100, 5000) if zlib.crc32(str(d).encode()) % 7 != 2][:1500]
    names = words("zero one two three four five six seven eight nine")
    rows = []
    for d in ids:
        some = [names[(d + k) % 10] for k in range(62)]
        rows.append((d, " ".join(reversed(some) if backward else some), None, None, None))
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    return held, spark.createDataFrame([*rows, (held, " ".join(names * 6), None, None, None)], SCHEMA).repartition(parts)


def test_windows_that_no_draw_took_teach_as_well(spark):
    """Both corpora have the same words; only their order, in windows of which none is drawn, tells them apart."""
    got = []
    for backward in (False, True):
        held, docs = ordered_docs(spark, backward, 3)
        got += [r["score"] for r in lm_scoring.lm_scores(docs, trained=0).collect() if r["doc_id"] == held]
    assert got[0] > got[1] + 1


def test_what_is_learned_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 30_000)
    got = []
    for parts in (1, 5):
        _, docs = ordered_docs(spark, False, parts)
        got.append({r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, trained=5_000).collect()})
    assert got[0].keys() == got[1].keys() and all(math.isclose(v, got[1][k], rel_tol=1e-4) for k, v in got[0].items())


def test_a_pass_counts_every_place():
    model, flat = small_model(300)
    p, read, given, told = model.passed(flat)
    assert read.sum() == flat[:, :-1].size and np.allclose(given.sum(1), np.bincount(model.rows[flat[:, 1:]].ravel(), minlength=len(given)), rtol=1e-4)
    rest = np.concatenate([p[name].ravel() for name in model.others()])
    after = model.after(p["E"], rest, given)
    assert all((after.p[name] == p[name]).all() for name in p)
    assert after.passed(flat)[3] > told


@pytest.mark.parametrize("n", [1, 64, 150])
def test_gradients_in_blocks_are_the_plain_ones(n):
    """A batch in blocks, its ids looked up once."""
    model, flat = small_model(300)
    rows = model.rows[flat[:n]]
    x, y = rows[:, :-1], rows[:, 1:]
    f = model.forward(x)
    joint = f["pi"] * model.T[y]
    post = joint / joint.sum(2, keepdims=True)
    want = model.gradients(x, f, (f["pi"] - post) / np.float32(x.size))
    ones, at = attention.Places(len(model.T)).of(rows)
    own = np.concatenate([model.p["E"][ones], np.ones((len(ones), 1), np.float32)], axis=1)
    g, given, told = attention.Gradients(150).of(model, own, at, rows)
    e = np.zeros_like(want["E"])
    e[ones] = g.pop("E")
    for name, v in {**g, "E": e}.items():
        assert np.allclose(v, want[name], rtol=1e-3, atol=1e-4 * np.abs(want[name]).max()), name
    assert np.allclose(given, attention.sums_of_rows(y.ravel(), post.reshape(y.size, -1), len(model.T))[ones], rtol=1e-3, atol=1e-4)
    assert math.isclose(told, np.log10(joint.sum(2)).sum(dtype=np.float64), rel_tol=1e-4)


@pytest.mark.parametrize("size", [1, 31, 33, 5000])
def test_sums_by_number(size):
    r = np.random.default_rng(size)
    ones, at = np.unique(r.zipf(1.4, size) % 300, return_inverse=True)
    values = r.normal(size=(size + 1, 7)).astype(np.float32)
    which = r.permutation(size + 1)[:size]
    (got,) = attention.sums_by(at.astype(np.uint16), len(ones), (values, which, np.zeros((size, 7), np.float32)))
    assert np.allclose(got, attention.sums_of_rows(at, values[which], len(ones)), atol=1e-3)


@pytest.mark.parametrize("known", [0, 4, 1000])
def test_known_words_are_not_encoded_again(monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    e, fresh = lm_scoring.Encoder(lm_scoring.ranks_path()), []
    plain = e.words
    monkeypatch.setattr(e, "words", lambda w: (fresh.append(len(w)), plain(w))[1])
    some = ["the", "naïve", "x" * 500, "日本語", "'s", "123abc", "...", "\x1c", "é" * 65]
    for chosen in (range(0, 9, 2), range(9), range(8, -1, -3), range(0)):
        k = sorted(chosen)
        names = np.array([(i // 2, i) for i in k], np.uint64).reshape(-1, 2)  # first halves may be equal
        ids, sizes = e.named(names, lambda at, k=k: [some[k[i]] for i in at])
        want, counts = plain([some[i] for i in k])
        assert ids.tolist() == want.tolist() and sizes.tolist() == counts.tolist()
    assert len(e.names) <= known and (known < 9 or sum(fresh) < 5 + 9 + 3)
