import re
from itertools import permutations

import pytest

from faultlens.llm import filter_audit

from .helpers import SCHEMA, edge_docs, edge_rows, words

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every filter of every order applied to what the earlier ones left."""
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    docs = []
    for d, t, _, source, *_ in rows:
        t, w = t or "", words(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        docs.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = set()
    for part in {x[0] for x in docs}:
        mine = [x[1:] for x in docs if x[0] == part]
        removed, got = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed[f] += len(gone)
                redundant = sum(f in x[0] for x in mine) - len(gone)
                got.append((f, ("".join(order), k + 1, len(left), len(gone), redundant, sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out |= {(part, *x, removed[f]) for f, x in got}
    return out


def audited(spark, rows, labels):
    got = filter_audit.interactions(filter_audit.text_filters(edge_docs(spark, rows), spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def test_every_order_equals_one_filter_after_another(spark):
    rows = edge_rows() + [(40 + k, f"{'Word ' * (k % 3)}{'x y z ' * k}{'#' if k % 4 else ''}", None, "s1" if k % 2 else "", None) for k in range(40)]
    rows += [(100 + k, "THE SAME " * 3, None, "hot", None) for k in range(200)]  # one text, most rows of its part
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_parts_without_failures_or_labels_have_all_their_rows(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(60)), None, "a", None)]
    got = audited(spark, rows, [])
    assert got == brute(rows, []) and len(got) == 600 and all(r[3] == 1 and not any(r[4:]) for r in got)
    assert filter_audit.interactions(filter_audit.text_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)), "ABCDE").count() == 0


@pytest.mark.parametrize("names", ["A", "AB", "ABC"])
def test_other_numbers_of_filters(spark, names):
    """Shapley values of all orders add up to what the filters remove together."""
    flagged = spark.createDataFrame([("p", *(bool(k >> i & 1) for i in range(3)), True, False) for k in range(8) for _ in range(k + 1)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    got = filter_audit.interactions(flagged, names).collect()
    orders = list(permutations(names))
    assert len(got) == len(orders) * len(names)
    gone = sum(k + 1 for k in range(8) if k & ((1 << len(names)) - 1))
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}.values()) == len(orders) * gone
    assert all(r["good_lost"] == r["removed"] and r["toxic_lost"] == 0 for r in got)
