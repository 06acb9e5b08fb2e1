"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies, runs of one word."""
    p, q = passage(1, 40), passage(2, 25)
    texts = {
        1: p, 2: p, 3: f"{passage(3, 10)} {p} {passage(4, 12)}", 4: f"{q}\n{p}\n{passage(5, 30)}", 5: f"{q}\n{p}\n{passage(6, 30)}", 6: "", 7: " \t\n\x0b\x0c\r ", 8: None, 9: "one", 10: "one two",
        11: "ha " * 60, 12: "x " + "ha " * 45 + "y", 13: "ONE", 14: "a b c a b c a b c a b c a b c a b c", 15: p.replace("a", "A"), 16: "\n".join([q, "", q, q, q, "end"]), 17: f"{q}\n{q}\n{q}", 18: "...  123 ###",
        19: passage(7, 300), 20: passage(7, 300) + " tail", 21: passage(7, 298) + " other words", 22: f"naïve café Ünïcode nbsp 日本語 {p}", 23: "\n" + p + "\n", 24: p + "\n" + q + "\n",
    }
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None) for k, t in texts.items()]
    rows += [(1, p, "en", "s1", None), (8, None, None, None, None)]  # repeated rows
    rows += [(None, p, "en", "s1", None), (None, None, None, None, None)]
    rows += [(30, passage(8, 25_000), "en", "s0", None), (31, passage(9, 50) + " " + passage(8, 25_000), "en", "s0", None)]
    return rows


def edge_docs(spark, rows=None):
    """The odd table, with more columns whose names operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA).repartition(3)
    extra = ("cid", "class", "size", "copies", "target", "l", "a", "lang_pred", "score", "uid", "id", "of", "n_words", "bucket", "__key", "key", "mix_copies", "__mix_of", "__lang_pred", "__score", "__text", "__lang")
    return docs.withColumns({c: F.lit("clash") for c in extra})


def cut_windows(rows, k=13):
    """op3 by brute force: {row number: (n_words, n_removed, kept)}."""
    least = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            if d is not None:
                g = tuple(w[i : i + k])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def cut_lines(rows, k=2):
    """op1 by brute force; rows in id order, rows without an id untouched."""
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ls = (t or "").split("\n")
        idx = [i for i, x in enumerate(ls) if words(x)]
        gone = set()
        if d is not None:
            for j in range(len(idx) - k + 1):
                g = tuple(ls[i] for i in idx[j : j + k])
                if g in seen:
                    gone.update(idx[j : j + k])
                seen.add(g)
        out.append((d, len(idx), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return out


def shingles(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def link_groups(rows, num=90, den=100, n=3):
    """op10 by brute force: (doc_id, n_shingles, component_id)."""
    sets = [shingles(r[1], n) for r in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(rows)]
