"""A small causal self-attention model over subword ids, trained and applied with numpy.

A position attends to itself and to those before it in its window, by the product of a query
and a key and a learned weight of their distance.  What it reads there and its own id
give a hidden layer, and that the weights of a mixture of COMPONENTS fixed distributions over
all ids.  So a token's probability is one short dot product, whatever the size of the
vocabulary, and sums to one over it.  Weights are learned by gradients, the distributions
by expectation and maximisation, smoothed towards the frequencies of the whole corpus.
`train` makes a start from windows in memory; `passed` is one pass over more of them, and
what passes over parts of a corpus give is put together by `after`.

Queries, keys and values depend on the id alone, so applying the model looks them up.
"""

from __future__ import annotations

import numpy as np

WINDOW, SCORED = 32, 24
#: What the corpus's frequencies count in each distribution.
SMOOTH = 2.0
WIDTH, HIDDEN, COMPONENTS = 16, 48, 64
#: Windows whose intermediate results are in memory at once: they stay in a core's cache.
BLOCK = 64
#: How many rows of one id are added one after the other, before such sums are added.
DEEP = 32
F4 = np.float32


def sums_of_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows: in each the sum of the values whose place it is."""
    wide = values.shape[1]
    return np.bincount((at[:, None] * wide + np.arange(wide)).ravel(), values.ravel(), n * wide).reshape(n, wide)


def exponential(a: np.ndarray) -> None:
    """In place, of what is cut at 40 and -40."""
    np.clip(a, -40, 40, out=a)
    np.exp(a, out=a)


class Places:
    """Which of n rows stand at which places of a batch: the distinct rows in order, and each place's number among them."""

    def __init__(self, n: int):
        self.has, self.number = np.zeros(n, bool), np.zeros(n, np.uint16)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At most 65,536 places."""
        self.has[rows] = True
        ones = np.flatnonzero(self.has)
        self.has[ones] = False
        self.number[ones] = np.arange(len(ones))
        return ones, self.number[rows]


def sums_by(at: np.ndarray, n: int, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Like sums_of_rows, if each of n numbers is in `at` (uint16): the j-th rows of all runs are added at once.

    parts: values, which of their rows stand at each place, and room for a row per place.
    A run is DEEP places of one number or fewer; runs are dealt by length, so those with a
    j-th place come first.
    """
    order = np.argsort(at, kind="stable")
    size = np.bincount(at, minlength=n)
    runs = -(-size // DEEP)
    first = np.cumsum(runs) - runs
    rank = np.arange(len(at)) - (np.cumsum(size) - size).take(at.take(order))
    layer = rank % DEEP
    begins = layer == 0
    run = np.cumsum(begins) - 1
    length = np.diff(np.append(np.flatnonzero(begins), len(at)))
    place = np.empty(len(length), np.int64)
    place[np.argsort((DEEP - length).astype(np.uint8), kind="stable")] = np.arange(len(length))
    layers = np.cumsum(np.bincount(length, minlength=DEEP + 1)[::-1])[::-1][1:]  # runs with a j-th place
    begin = np.cumsum(layers) - layers
    moved = np.empty_like(order)
    moved[begin.take(layer) + place.take(run)] = order
    many = np.flatnonzero(runs > 1)
    more = runs[many] - 1
    start = np.cumsum(more) - more
    rest = place[np.arange(more.sum()) + np.repeat(first[many] + 1 - start, more)]
    out = []
    for values, which, room in parts:
        values.take(which.take(moved), 0, out=room[: len(at)], mode="clip")
        total = room[: layers[0]]
        for low, m in zip(begin[1:].tolist(), layers[1:].tolist(), strict=True):
            total[:m] += room[low : low + m]
        out.append(total.take(place[first], 0))
        if len(many):
            out[-1][many] += np.add.reduceat(total[rest], start, 0)
    return out


class Model:
    """rows: each id's row in the tables (0: any id that the corpus doesn't have)."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        """counts: how often each id of the vocabulary stands in the corpus; the last id begins texts and the one before ends them."""
        r = np.random.default_rng(seed)
        known = np.flatnonzero(counts)
        self.rows = np.zeros(len(counts), np.int32)
        self.rows[known] = 1 + np.arange(len(known))
        prior = (counts + 1.0)[:-1]  # nothing but a text's beginning is the beginning
        prior /= prior.sum()
        self.prior = np.concatenate([[prior[counts[:-1] == 0].mean() if (counts[:-1] == 0).any() else 0.0], np.append(prior, 0.0)[known]])
        n, d, h, k = len(known) + 1, WIDTH, HIDDEN, COMPONENTS
        rand = lambda *shape: r.normal(0, shape[0] ** -0.5, shape).astype(F4)
        self.p = {
            "E": r.normal(0, 0.5, (n, d)).astype(F4), "Q": rand(d, d), "K": rand(d, d), "V": rand(d, d), "far": (-0.4 * np.arange(WINDOW)).astype(F4),
            "A": rand(d, h), "O": rand(d, h), "b": np.zeros(h, F4), "W": rand(h, k), "c": np.zeros(k, F4),
        }
        self.many = np.ones(n)
        self.many[0] = max(1, (counts[:-1] == 0).sum())
        noise = np.exp(r.normal(0, 0.7, (n, k)))
        noise[0] = 1
        self.T = self.shares(self.prior[:, None] * noise)
        i, j = np.indices((WINDOW, WINDOW))
        self.gap = np.maximum(i - j, 0)
        self.mask = np.where(j <= i, F4(0), F4(-1e9))

    def shares(self, t: np.ndarray) -> np.ndarray:
        """Distributions over all ids; row 0 stands for many of them."""
        return (t / (self.many[:, None] * t).sum(0)).astype(F4)

    def forward(self, x: np.ndarray) -> dict:
        """Of whole windows of rows (n x WINDOW)."""
        p, d = self.p, WIDTH
        e = p["E"][x.ravel()]
        all_ = e @ np.concatenate([p["Q"] * F4(d**-0.5), p["K"], p["V"], p["A"]], axis=1)
        q, k, v = (all_[:, i * d : (i + 1) * d].reshape(*x.shape, d) for i in range(3))
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -40, 40, out=a)
        np.exp(a, out=a)
        a *= np.exp(p["far"][self.gap]) * (self.mask == 0)
        a /= (a @ np.ones(WINDOW, F4))[:, :, None]
        o = a @ v
        h = o.reshape(-1, d) @ p["O"]
        h += all_[:, 3 * d :]
        h += p["b"]
        np.maximum(h, 0, out=h)
        z = h @ p["W"]
        z += p["c"]
        np.clip(z, -40, 40, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(COMPONENTS, F4))[:, None]
        whole = lambda t: t.reshape(*x.shape, -1)
        return {"e": whole(e), "q": q, "k": k, "v": v, "a": a, "o": o, "h": whole(h), "pi": whole(z)}

    def slopes(self, f: dict, dz: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all weights but E, and those of what stands at each place of E (places x WIDTH)."""
        p, d = self.p, WIDTH
        flat = lambda t: t.reshape(-1, t.shape[-1])
        e, h, dz = flat(f["e"]), flat(f["h"]), flat(dz)
        g = {"W": h.T @ dz, "c": dz.sum(0)}
        back = np.empty((len(e), 3 * d + HIDDEN), F4)
        dh = dz @ p["W"].T
        dh *= h > 0
        back[:, 3 * d :] = dh
        g |= {"O": flat(f["o"]).T @ dh, "b": dh.sum(0)}
        do = (dh @ p["O"].T).reshape(f["o"].shape)
        ds = do @ f["v"].transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", do, f["o"])[:, :, None]
        ds *= f["a"]
        g["far"] = np.bincount(self.gap.ravel(), (ds.sum(0) * (self.mask == 0)).ravel(), WINDOW).astype(F4)
        back[:, :d] = flat(ds @ f["k"])
        back[:, d : 2 * d] = flat(ds.transpose(0, 2, 1) @ f["q"])
        back[:, 2 * d : 3 * d] = flat(f["a"].transpose(0, 2, 1) @ do)
        whole = e.T @ back
        scale = F4(d**-0.5)
        g |= {"Q": whole[:, :d] * scale, "K": whole[:, d : 2 * d], "V": whole[:, 2 * d : 3 * d], "A": whole[:, 3 * d :]}
        return g, back @ np.concatenate([p["Q"] * scale, p["K"], p["V"], p["A"]], axis=1).T

    def gradients(self, x: np.ndarray, f: dict, dz: np.ndarray) -> dict:
        g, de = self.slopes(f, dz)
        return g | {"E": sums_of_rows(x.ravel(), de, len(self.p["E"])).astype(F4)}

    def train(self, windows: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.025, smooth: float = SMOOTH, seed: int = 0) -> Model:
        """windows: ids (n x WINDOW + 1), the last one of which is only predicted; the same windows give the same model."""
        r = np.random.default_rng(seed)
        rows = self.rows[windows]
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        total = max(1, epochs * -(-len(rows) // batch))
        held, step = np.zeros_like(self.T, np.float64), 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for at in range(0, len(rows), batch):
                step += 1
                some = rows[order[at : at + batch]]
                x, y = some[:, :-1], some[:, 1:]
                f = self.forward(x)
                joint = f["pi"] * self.T[y]
                post = joint / joint.sum(2, keepdims=True)
                g = self.gradients(x, f, (f["pi"] - post) / F4(x.size))
                lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
                for name, (a, b) in m.items():
                    a += F4(0.1) * (g[name] - a)
                    b += F4(0.01) * (g[name] ** 2 - b)
                    self.p[name] -= F4(lr / (1 - 0.9**step)) * a / (np.sqrt(b / F4(1 - 0.99**step)) + F4(1e-6))
                held *= 1 - 1 / min(step, max(20, total // 4))
                held += sums_of_rows(y.ravel(), post.reshape(-1, COMPONENTS), len(held))
                if step % 4 == 0 or step == total:
                    self.T = self.shares(held + smooth * self.prior[:, None])
        return self

    def others(self) -> list[str]:
        """Names of the weights that belong to no id."""
        return sorted(set(self.p) - {"E"})

    def after(self, e: np.ndarray, rest: np.ndarray, given: np.ndarray) -> Model:
        """The model with other weights (rest: those of others(), in a row) and the distributions that `given` makes."""
        m = Model.__new__(Model)
        m.__dict__ |= self.__dict__ | {"p": {"E": e}, "T": self.shares(given + SMOOTH * self.prior[:, None])}
        for name in self.others():
            m.p[name], rest = rest[: self.p[name].size].reshape(self.p[name].shape), rest[self.p[name].size :]
        return m

    def passed(self, windows: np.ndarray, batch: int = 128, rate: float = 0.01) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """What one pass over all windows, in their order, makes of the weights, which stay as they are here.

        Returns the weights; per row how often it was read; per row what it gives each
        distribution, summed over all places of the windows; and how well places were told (log10, summed).
        """
        m = Model.__new__(Model)
        m.__dict__ |= self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items() if k != "E"}}
        n, d = self.p["E"].shape
        past = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
        e, first_e, second_e = np.ones((n, d + 1), F4), np.zeros((n, d), F4), np.zeros((n, d), F4)
        e[:, :d] = self.p["E"]
        read, given, told = np.zeros(n, np.int64), np.zeros(self.T.shape), 0.0
        work, places = Gradients(batch), Places(n)
        total = -(-len(windows) // batch)
        for step in range(1, total + 1):
            rows = self.rows[windows[(step - 1) * batch : step * batch]]
            ones, at = places.of(rows)
            own = e.take(ones, 0)
            g, given_here, log = work.of(m, own, at, rows)
            told += log
            given[ones] += given_here
            reads = np.bincount(at[:, :-1].ravel(), minlength=len(ones))
            read[ones] += reads
            which = np.flatnonzero(reads)  # rows that aren't read keep their past
            ones = ones[which]
            past["E"], g["E"], value_e = (first_e.take(ones, 0), second_e.take(ones, 0)), g["E"].take(which, 0), own[:, :d].take(which, 0)
            lr = F4(rate * min(1.0, step / 20) * (1 - 0.9 * step / total) / (1 - 0.9**step))
            for name, slope in g.items():
                value, (first, second) = value_e if name == "E" else m.p[name], past[name]
                first += F4(0.1) * (slope - first)
                slope *= slope
                slope -= second
                second += F4(0.01) * slope
                value -= lr * first / (np.sqrt(second / F4(1 - 0.99**step)) + F4(1e-6))
            e[ones, :d], first_e[ones], second_e[ones] = value_e, *past.pop("E")
        return m.p | {"E": e[:, :d].copy()}, read, given, told

    def tables(self) -> Tables:
        return Tables(self)


def looked_up(p: dict, scale: np.ndarray) -> np.ndarray:
    """What makes of an id's E and a 1 its query, key, value, a 1 and what it adds to the hidden layer.

    The 1 adds up what a query reads by, and stands before the hidden layer for the mixture's c.
    """
    d = WIDTH
    out = np.zeros((d + 1, 3 * d + 1 + HIDDEN), F4)
    out[:d, :d], out[:d, d : 2 * d], out[:d, 2 * d : 3 * d], out[:d, 3 * d + 1 :] = p["Q"] * scale, p["K"], p["V"], p["A"]
    out[d, 3 * d], out[d, 3 * d + 1 :] = 1, p["b"]
    return out


class Buffers:
    """Arrays of up to `n` windows with `places` of their places, made once: new ones for each batch cost more than the sums in them."""

    def __init__(self, n: int, places: int):
        make = lambda *shape: np.zeros((n, *shape), F4)
        self.all = {
            "look": make(WINDOW, 3 * WIDTH + 1 + HIDDEN), "s": make(places, WINDOW), "o": make(places, WIDTH + 1), "flat": make(places, WIDTH), "h": make(places, HIDDEN + 1),
            "z": make(places, COMPONENTS), "t": make(places, COMPONENTS), "zero": make(places, HIDDEN + 1), "more": make(places, HIDDEN + 1), "do": make(places, WIDTH + 1), "ds": make(places, WINDOW),
        }

    def first(self, n: int) -> dict:
        return {k: v[:n] for k, v in self.all.items()}


def upper(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """O and W with the 1 before the hidden layer."""
    return np.concatenate([np.zeros((WIDTH, 1), F4), p["O"]], axis=1), np.concatenate([p["c"][None], p["W"]])


def mixture(b: dict, at: slice, far: np.ndarray, o: np.ndarray, w: np.ndarray) -> np.ndarray:
    """From look: in z the weights of the mixture at some places, times their sum, and by the way s, o, flat and h; returns 1 / the sums of s."""
    d, look = WIDTH, b["look"]
    flat = lambda t: t.reshape(-1, t.shape[-1])
    np.matmul(look[:, at, :d], look[:, :, d : 2 * d].transpose(0, 2, 1), out=b["s"])
    exponential(b["s"])
    b["s"] *= far
    np.matmul(b["s"], look[:, :, 2 * d : 3 * d + 1], out=b["o"])
    r = 1 / b["o"][:, :, d:]
    np.multiply(b["o"][:, :, :d], r, out=b["flat"])
    np.matmul(flat(b["flat"]), o, out=flat(b["h"]))
    b["h"] += look[:, at, 3 * d :]
    np.maximum(b["h"], b["zero"], out=b["h"])
    np.matmul(flat(b["h"]), w, out=flat(b["z"]))
    exponential(b["z"])
    return r


class Gradients:
    """Model.forward and Model.gradients of a batch, block by block in the same buffers.

    Queries, keys and values are made once per distinct id, and what its places send back is
    summed before it goes through their weights.  Attention and mixture keep their sums
    beside them; rows are divided where they are short.
    """

    def __init__(self, batch: int):
        """batch: windows at most."""
        self.b = Buffers(min(batch, BLOCK), WINDOW)
        n = batch * WINDOW
        zeros = lambda k, wide: np.zeros((k, wide), F4)
        self.back, self.post = zeros(n + 1, 3 * WIDTH + HIDDEN), zeros(n + 1, COMPONENTS)  # the last row stays 0
        w, i = np.indices((batch, WINDOW + 1))
        self.reads, self.told = np.where(i < WINDOW, w * WINDOW + i, n).ravel(), np.where(i > 0, w * WINDOW + i - 1, n).ravel()
        self.room = zeros(len(self.reads), 3 * WIDTH + HIDDEN), zeros(len(self.reads), COMPONENTS)
        self.one, self.ones = np.ones(max(COMPONENTS, BLOCK), F4), np.ones((BLOCK * WINDOW, HIDDEN + 1), F4)

    def of(self, model: Model, own: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """rows: those of windows (n x WINDOW + 1); own: E and a 1 of the distinct ones; at: numbers of theirs.

        Returns gradients (of E: those of `own`), what each of `own` gives each distribution, and log10 of how well places were told, summed.
        """
        p, d = model.p, WIDTH
        flat = lambda t: t.reshape(-1, t.shape[-1])
        scale, told, size = F4(d**-0.5), 0.0, F4(1 / (WINDOW * len(at)))
        whole = looked_up(p, scale)
        table = own @ whole
        far = np.exp(p["far"][model.gap]) * (model.mask == 0)
        over, w = upper(p)
        back = self.back[: len(at) * WINDOW].reshape(len(at), WINDOW, -1)
        g_w, g_o, g_far = np.zeros_like(w), np.zeros_like(p["O"]), np.zeros(WINDOW * WINDOW, F4)
        for low in range(0, len(at), BLOCK):
            high = min(low + BLOCK, len(at))
            b = self.b.first(high - low)
            to, t = back[low:high], self.post[low * WINDOW : high * WINDOW]
            table.take(at[low:high, :-1], 0, out=b["look"], mode="clip")
            r = mixture(b, slice(None), far, over, w)
            z, h, o = flat(b["z"]), flat(b["h"]), flat(b["flat"])
            model.T.take(rows[low:high, 1:].ravel(), 0, out=t, mode="clip")
            t *= z
            sums, hits = z @ self.one[:COMPONENTS], t @ self.one[:COMPONENTS]
            told += float(np.log10(hits / sums).sum(dtype=np.float64))
            t *= (1 / hits)[:, None]
            z *= (1 / sums)[:, None]
            z -= t
            g_w += h.T @ z
            dh = flat(to)[:, 3 * d :]
            np.matmul(z, p["W"].T, out=dh)
            steep = flat(b["more"])
            np.multiply(h, F4(1e30), out=steep)
            np.minimum(steep, self.ones[: len(h)], out=steep)  # 1 where h is positive
            dh *= steep[:, 1:]
            g_o += o.T @ dh
            do, ds, look = b["do"], b["ds"], b["look"]
            np.matmul(dh, p["O"].T, out=flat(do)[:, :d])
            np.einsum("ijk,ijk->ij", do[:, :, :d], b["flat"], out=do[:, :, d])
            do *= r
            np.negative(do[:, :, d], out=do[:, :, d])
            np.matmul(do, look[:, :, 2 * d : 3 * d + 1].transpose(0, 2, 1), out=ds)
            ds *= b["s"]
            g_far += self.one[: high - low] @ ds.reshape(high - low, -1)
            np.matmul(ds, look[:, :, d : 2 * d], out=to[:, :, :d])
            np.matmul(ds.transpose(0, 2, 1), look[:, :, :d], out=to[:, :, d : 2 * d])
            np.matmul(b["s"].transpose(0, 2, 1), do[:, :, :d], out=to[:, :, 2 * d : 3 * d])
        per, given = sums_by(at.ravel(), len(own), (self.back, self.reads, self.room[0]), (self.post, self.told, self.room[1]))
        per *= size
        g = own.T @ per
        whole = np.delete(whole[:d], 3 * d, axis=1)
        return {
            "E": per @ whole.T, "Q": g[:d, :d] * scale, "K": g[:d, d : 2 * d], "V": g[:d, 2 * d : 3 * d], "A": g[:d, 3 * d :], "b": g[d, 3 * d :], "O": g_o * size, "W": g_w[1:] * size, "c": g_w[0] * size,
            "far": np.bincount(model.gap.ravel(), g_far * (model.mask == 0).ravel(), WINDOW).astype(F4) * size,
        }, given, told


class Tables:
    """The model as lookups by row, for scoring."""

    def __init__(self, model: Model):
        p = model.p
        self.rows, self.T = model.rows, model.T
        whole = looked_up(p, F4(WIDTH**-0.5))
        self.look = p["E"] @ whole[:-1] + whole[-1]
        self.O, self.W = upper(p)
        self.far = np.exp(p["far"][model.gap]) * (model.mask == 0)

    def block(self, x: np.ndarray, y: np.ndarray, places: slice, buffers: Buffers) -> np.ndarray:
        """log10 probabilities of y, which stand behind some places of windows x."""
        b = buffers.first(len(x))
        self.look.take(x, 0, out=b["look"], mode="clip")
        mixture(b, places, self.far[places], self.O, self.W)
        self.T.take(y, 0, out=b["t"], mode="clip")
        z = b["z"].reshape(-1, COMPONENTS)
        hit = np.einsum("ij,ij->i", z, b["t"].reshape(-1, COMPONENTS))
        return np.log10(hit / (z @ np.ones(COMPONENTS, F4))).reshape(y.shape)

    def score(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, batch: int = BLOCK) -> np.ndarray:
        """log10 probability of each text: its inputs x (rows) and what they predict, y; first: where texts begin (n + 1 values).

        A text's windows begin every SCORED places.  Each scores its last SCORED places, and
        the first one the places before them too, so every place is scored once; places
        behind the text's end count nothing.
        """
        size = np.diff(first)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // SCORED)), 0)
        text = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin, end = first[:-1][text] + number * SCORED, first[1:][text]
        out = np.zeros(len(size))
        for places, which in ((slice(0, WINDOW - SCORED), np.flatnonzero(number == 0)), (slice(WINDOW - SCORED, WINDOW), np.arange(len(text)))):
            buffers = Buffers(batch, len(range(WINDOW)[places]))
            for k in range(0, len(which), batch):
                w = which[k : k + batch]
                at = begin[w][:, None] + np.arange(WINDOW)
                to = at[:, places]
                p = self.block(x.take(at, mode="clip"), y.take(to, mode="clip"), places, buffers)
                p *= to < end[w][:, None]
                out += np.bincount(text[w], p.sum(1, dtype=np.float64), len(size))
        return out
