import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from faultlens.llm import spelling

from .helpers import SCHEMA, edge_docs, edge_rows, passage

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(x) + 1 == len(y) and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(rows, least=5, often=3, times=2):
    n = Counter()
    for d, t, *_ in rows:
        for run in RUN.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if d is not None and (h := zlib.crc32(f"{d}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: k for w, k in n.items() if k >= often}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    form, out = {}, []
    met = {w: [x for k in (-1, 0, 1) for x in by.get(len(w) + k, ()) if x != w and near(w, x)] for w in n}
    for w in n:
        best = min(met[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(met[w]), n.get(form[w])))
    return sorted(out)


def variants(spark, rows):
    got = spelling.spelling_variants(edge_docs(spark, rows)).collect()
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got)


def edited(w, r, letters):
    k = r.randrange(len(w))
    return r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]))


def texts(seed, n_words, letters="aeioué÷Énrstlm"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n_words)]
    base += [edited(w, r, letters) for w in base for _ in range(3)]
    base += [edited(w, r, letters) for w in base[n_words:]]
    rows = []
    for d in range(60):
        words = [w if r.random() < 0.7 else w.upper() for w in r.choices(base, k=80)]
        rows.append((d, " ".join(words), "en", "s", None))
    return rows


def test_variants_equal_brute_force(spark):
    rows = edge_rows()[:-2] + texts(1, 40) + [(500, ("x" * 70 + " ") * 4 + ("x" * 71 + " ") * 9 + ("x" * 35 + "y" + "x" * 34 + " ") * 3, None, None, None), (501, "Ab,cdeF-ghijk×l " * 5 + "ABCDEÉ abcdeé " * 4, None, None, None)]
    got = variants(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] != r[1] and r[1] for r in got)


def test_hot_groups_are_cut_again(spark, monkeypatch):
    """A limit of a few words: every group is cut by sub-bands, several times."""
    monkeypatch.setattr(spelling, "LIMIT", 3)
    monkeypatch.setattr(spelling, "BUCKET", 50)
    rows = texts(2, 60, "ab")
    assert variants(spark, rows) == brute(rows)


def test_nothing_to_group(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "abcd " * 9, None, None, None), (None, None, None, None, None)]
    assert variants(spark, rows) == []


def test_one_long_run(spark):
    """A run of a million letters, three times, and one with a letter less."""
    long = passage(3, 250_000).replace(" ", "")[:1_000_000]
    rows = [(None, long if d < 9 else long[:-1], None, None, None) for d in range(13)]
    assert variants(spark, rows) == sorted([(long, None, long, 9, 1, None), (long[:-1], long, long, 4, 1, 9)])


def test_checksums_equal_the_librarys():
    r = random.Random(5)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 5, 64, 65, 300, 7)]
    data, off = spelling.joined(spans)
    state = [zlib.crc32(b"%d:" % k) for k in range(len(spans))]
    got = spelling.crcs(data, off[:-1], off[1:], np.array(state, np.uint32))
    assert got.tolist() == [zlib.crc32(s, x) for s, x in zip(spans, state, strict=True)]


def test_an_edit_leaves_a_band_and_a_half():
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcde") for _ in range(r.randint(5, 6))) for _ in range(200)})
    m = spelling.masks(*spelling.latin(pa.array(words)))
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            if len(x) <= len(y) and x != y and near(x, y):
                differ = m[[i]] ^ m[[j]]
                assert int(np.bitwise_count(differ).sum()) == 2 - (len(x) != len(y))
                assert (differ == 0).any()
                on, path = len(y) - len(x), b""
                for _ in range(3):
                    _, lo, mid, hi = list(spelling.halves(path, len(x)))[-1]
                    front, back = x[lo:mid] == y[lo:mid], x[mid:hi] == y[mid + on : hi + on]
                    assert front or back
                    path += b"\0" if front else b"\1"
