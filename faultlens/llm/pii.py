"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The patterns give the base spans.  Words with a digit or an @ are the field's nodes, with
features of their shape; the words beside and between them are outside by definition.
Potentials join words that stand next to each other and, however far apart, each
occurrence of a word with the first one of the same word or of a similar one (the same
last seven or ten digits), the first observed one where there is any.  Words of
base spans are observed; loopy sum-product messages carry them through the document, so
that "555-2678" is a phone number where "+1 (736) 555-2678" stands elsewhere.  Runs of words
that are surely of one kind and touch no base span are added.  Documents without a base
span are judged by the same field.

Weights of features and both kinds of edges are learned together, by the penalised
pseudo-likelihood of the labels that the patterns give a bounded sample.  Skip edges have
one weight for agreement, whatever the label, so that it is learned from all repeats.  Words
that repeat an observed one but stand in no base span have no label: they are what the
patterns miss.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarrays as ta

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Finds what IP finds: a run of digits that doesn't begin a match has none in it, so only
#: its start is tried, once.
IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Nodes: words with a digit or an @.
NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
NODE_START = re.compile(r"[0-9@]")
EDGE = ".,;:!?\"'()[]{}<>|"
SURE = 0.9
SHAPES = 4096


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Matches of EMAIL: the pattern is tried only from the first place that can reach an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield m
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in emails(text)]
    for m in IP_ONCE.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Flat(dict):
    """Letters, digits and other scripts, each as one sign."""

    def __missing__(self, c: int) -> str:
        self[c] = value = "u" if c > 127 else "9" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" if chr(c).islower() else chr(c)
        return value


FLAT = Flat()
WIDTH = 8


def shape(word: str) -> list[str]:
    """WIDTH features: what a node looks like, without what it says."""
    flat = word.translate(FLAT)
    runs = re.sub(r"(.)\1+", r"\1+", flat)
    digits = flat.count("9")
    marks = "".join(sorted(set(flat) - set("aAu9")))
    return ["bias", f"run:{runs}", f"marks:{marks}", f"digits:{digits}", f"len:{len(word).bit_length()}", f"at:{'@' in word}:{word.count('.')}", f"all:{digits == len(word)}", f"same:{flat}"]


def number_of(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SHAPES


#: Words up to so many characters are remembered, and so many of them.
SHORT, MEMO = 40, 50_000


def features(word: str) -> tuple[int, ...]:
    memo = ta.process_memo().setdefault("shapes", {})
    if word not in memo:
        found = tuple(number_of(f) for f in shape(word))
        if len(word) > SHORT:
            return found
        if len(memo) >= MEMO:
            memo.clear()
        memo[word] = found
    return memo[word]


class Field:
    """The nodes of a text, their features, edges and observed labels."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        places, feats, words = array("q"), array("H"), []
        for m in NODE.finditer(text):
            w = m.group()
            lead = len(w) - len(w.lstrip(EDGE))
            core = w.strip(EDGE)
            if core:
                places.extend((m.start() + lead, m.start() + lead + len(core), m.start(), m.end()))
                feats.extend(features(core))
                words.append(core)
        self.places = np.array(places, np.int64).reshape(-1, 4)
        self.features = np.array(feats, np.int64).reshape(-1, WIDTH)
        self.n = n = len(self.places)
        start, end = self.places[:, 0], self.places[:, 1]
        self.observed = np.full(n, -1)
        if spans and n:
            first = np.searchsorted(upto(spans), start, "right")  # the first span that ends beyond the node's start
            hit = first < len(spans)
            hit[hit] = np.array([x[0] for x in spans])[first[hit]] < end[hit]
            self.observed[hit] = 1 + np.array([x[1] for x in spans])[first[hit]]
        gap = [] if n < 2 else [i for i in range(1, n) if not text[self.places[i - 1, 3] : self.places[i, 2]].strip(" \t\n\v\f\r")]
        self.chain = np.array([(i - 1, i) for i in gap], np.int64).reshape(-1, 2)
        hub: dict[str, int] = {}
        for i in [*np.flatnonzero(self.observed >= 0).tolist(), *range(n)]:
            for key in self.keys(words[i]):
                hub.setdefault(key, i)
        skip = {(min(h, i), max(h, i)) for i, w in enumerate(words) for key in self.keys(w) if (h := hub[key]) != i}
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)

    @staticmethod
    def keys(core: str) -> set[str]:
        low = core.lower()
        digits = re.sub(r"[^0-9]", "", low)
        out = {"w" + low}
        if len(digits) >= 7:
            out.add("d" + digits[-10:])
            out.add("e" + digits[-7:])
        return out


def upto(spans: list[tuple[int, int, int]]) -> np.ndarray:
    """For spans by start: the largest end of each and those before."""
    return np.maximum.accumulate(np.array([x[2] for x in spans], np.int64))


class Model:
    """Node weights (features x labels) and log potentials of chain and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, field: Field) -> np.ndarray:
        """Label probabilities of a text's nodes."""
        return self.all_marginals([field])[0]

    def all_marginals(self, fields: list[Field]) -> list[np.ndarray]:
        """Label probabilities of every node by loopy sum-product messages.

        The texts' messages are computed side by side.  Each text's go on until they settle;
        a path has fewer than n edges and a damped message needs about two rounds an edge, so
        the bound stops only loops that never do.  No text changes what another one gets.
        """
        k = len(LABELS)
        base = np.cumsum([0, *(f.n for f in fields)])
        if not base[-1]:
            return [np.zeros((0, k)) for _ in fields]
        node = self.weights[np.concatenate([f.features for f in fields])].sum(1)
        observed = np.concatenate([f.observed for f in fields])
        seen = observed >= 0
        node[seen] = -50.0
        node[seen, observed[seen]] = 0.0
        edges = np.concatenate([e + b for f, b in zip(fields, base, strict=False) for e in (f.chain, f.skip)])
        kind = np.concatenate([np.full(len(e), j) for f in fields for j, e in enumerate((f.chain, f.skip))])
        owner = np.repeat(np.arange(len(fields)), [len(f.chain) + len(f.skip) for f in fields])
        potential = np.stack([self.chain, self.skip])
        message = np.zeros((2, len(edges), k))  # along each edge and against it
        act, bound = np.arange(len(edges)), 4 * np.diff(base) + 64
        rounds = 0
        while len(act):
            a, b = edges[act].T
            belief = node.copy()
            for j in range(k):
                belief[:, j] += np.bincount(np.concatenate([b, a]), message[:, act, j].ravel(), base[-1])
            moved = np.zeros(len(act))
            new = []
            for side, source in ((0, a), (1, b)):
                pot = potential[kind[act]] if side == 0 else potential.transpose(0, 2, 1)[kind[act]]
                out = (belief[source] - message[1 - side, act])[:, :, None] + pot
                top = out.max(1, keepdims=True)
                got = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                got -= got.max(1, keepdims=True)
                moved = np.maximum(moved, np.abs(got - message[side, act]).max(1))
                new.append(0.5 * message[side, act] + 0.5 * got)
            message[0, act], message[1, act] = new
            rounds += 1
            most = np.zeros(len(fields))
            np.maximum.at(most, owner[act], moved)
            act = act[((most >= 1e-3) & (rounds < bound))[owner[act]]]
        for side in (0, 1):
            np.add.at(node, edges[:, 1 - side], message[side])
        p = np.exp(node - node.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return [p[i:j] for i, j in zip(base[:-1], base[1:], strict=True)]


def added_spans(field: Field, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of neighbouring nodes that are surely of one kind and touch no base span."""
    label = np.where((field.observed < 0) & (p.max(1, initial=0) >= SURE), p.argmax(1), 0)
    joined, out = set(field.chain[:, 1].tolist()), []
    for i in np.flatnonzero(label).tolist():
        s, e = field.places[i, :2].tolist()
        if i in joined and out and out[-1][3] == i - 1 and out[-1][1] == label[i] - 1:
            out[-1] = (out[-1][0], out[-1][1], e, i)
        else:
            out.append((s, int(label[i]) - 1, e, i))
    starts, ends = np.array([x[0] for x in base]), upto(base)
    before = np.searchsorted(starts, [e for _, _, e, _ in out], "left")
    return [(s, k, e) for (s, k, e, _), n in zip(out, before, strict=True) if not n or ends[n - 1] <= s]


def train_rows(batches):
    """Per batch: how often each (features, label, labels of chain neighbours, of skip neighbours)."""
    schema = pa.schema([("what", pa.binary()), ("n", pa.int64())])
    k = len(LABELS)
    for batch in batches:
        count: Counter = Counter()
        for t in batch.column(0):
            text = t.as_py() or ""
            if not NODE_START.search(text):
                continue
            f = Field(text, base_spans(text))
            y = np.where(f.observed < 0, 0, f.observed)
            labelled = np.ones(f.n, bool)
            for i, j in ((0, 1), (1, 0)):
                labelled[f.skip[f.observed[f.skip[:, j]] >= 0, i]] = False
            labelled |= f.observed >= 0
            near = np.zeros((2, f.n, k), np.int64)
            for side, edges in enumerate((f.chain, f.skip)):
                both = edges[labelled[edges].all(1)]
                np.add.at(near[side], (both[:, 0], y[both[:, 1]]), 1)
                np.add.at(near[side], (both[:, 1], y[both[:, 0]]), 1)
            rows = np.concatenate([f.features, y[:, None], near[0], near[1]], axis=1).astype(np.int32)[labelled]
            count.update(r.tobytes() for r in rows)
        yield pa.record_batch([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], schema=schema)


def fit(rows: np.ndarray, n: np.ndarray, steps: int = 150, penalty: float = 0.5) -> Model:
    """Penalised pseudo-likelihood by adaptive gradients; rows as train_rows makes them, each n times."""
    k = len(LABELS)
    feats, y, near = rows[:, :WIDTH], rows[:, WIDTH], [rows[:, WIDTH + 1 : WIDTH + 1 + k].astype(float), rows[:, WIDTH + 1 + k :].astype(float)]
    params = [np.zeros((SHAPES, k)), np.zeros((k, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    target = np.eye(k)[y]
    for t in range(1, steps + 1):
        z = params[0][feats].sum(1) + near[0] @ params[1] + near[1] @ params[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - target) * n[:, None]
        grad = [np.stack([np.bincount(feats.ravel(), np.repeat(off[:, j], WIDTH), SHAPES) for j in range(k)], axis=1), near[0].T @ off, near[1].T @ off]
        grad[1], grad[2] = (grad[1] + grad[1].T) / 2, np.eye(k) * np.trace(grad[2])
        for i, x in enumerate(params):
            g = grad[i] + penalty * x
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            x -= 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
    return Model(*params)


def learn(docs: DataFrame, id_col: str, text_col: str, bound: int) -> Model:
    """Learns from pattern labels of about `bound` documents drawn by a hash of id and text, so rows without an id are drawn like others.

    The driver gets the distinct (features, label, neighbours) of those documents' nodes.
    """
    n = docs.count()
    share = min(1.0, bound / n) if n else 1.0
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("pii")), F.lit(1 << 30)) / float(1 << 30) <= share
    rows = docs.where(draw).select(F.col(text_col).cast("string")).mapInArrow(train_rows, "what binary, n long").groupBy("what").agg(F.sum("n")).collect()
    rows.sort()
    return fit(np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.int32).reshape(-1, WIDTH + 1 + 2 * len(LABELS)), np.array([r[1] for r in rows], float))


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


#: Nodes whose messages are computed side by side.
GROUP = 20_000


def find(model: Model):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())])
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            waiting, size = [], 0
            for doc_id, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or ""
                field = None
                base = base_spans(text) if NODE_START.search(text) else []
                if NODE_START.search(text):
                    field = Field(text, base)
                    size += field.n
                waiting.append((doc_id.as_py(), base, field))
                if size >= GROUP:
                    judge(model, waiting, out)
                    waiting, size = [], 0
            judge(model, waiting, out)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def judge(model: Model, waiting: list[tuple], out: list[list]) -> None:
    """Adds the rows of some documents."""
    marginals = iter(model.all_marginals([f for _, _, f in waiting if f]))
    for doc_id, base, field in waiting:
        more = added_spans(field, next(marginals), base) if field else []
        values = (doc_id, *(sum(k == j for _, k, _ in base) for j in range(len(KINDS))), named(base), named(base + more))
        for column, v in zip(out, values, strict=True):
            column.append(v)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans of every row.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined
    by commas; `spans` has the base ones and those that the field adds.  Null text has
    none.  Rows without an id and repeated rows are searched like others.  A very long text
    is one field: its arrays are held by one task, and its time grows with its words and the
    rounds that its messages need.  bound: documents that the field learns from.
    """
    model = learn(docs, id_col, text_col, bound)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return rows.mapInArrow(find(model), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = personal_data(store.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
