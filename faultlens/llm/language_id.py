"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed 1- to 3-byte sequences of the lower-cased text, as shares of the
text.  A linear score is then the mean weight of the positions of a text, so prediction
is table lookups and one sum per text, whatever its length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarrays as ta

SIZE = 1 << 12
#: Bytes of texts that are looked at together: each takes some 50 bytes of intermediate results.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Language codes of one family; a code in none is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
    "uralic": ("et", "fi", "hu"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower()[:3].split("-")[0] in langs), lang)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z; white space and ASCII other than letters become one symbol."""
    t = np.arange(256, dtype=np.uint32)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t[data]


def features(data: np.ndarray) -> list[np.ndarray]:
    """Feature number of the 1-, 2- and 3-byte sequence that starts at each byte."""
    b = np.concatenate([fold(data), np.full(2, 32, np.uint32)])
    one, two = b[:-2], b[:-2] * np.uint32(257) + b[1:-1]
    three = two * np.uint32(263) + b[2:]
    out = []
    for k, x in enumerate((one, two, three)):
        x = (x + np.uint32(k)) * np.uint32(0x9E3779B1)
        out.append(x >> np.uint32(32 - SIZE.bit_length() + 1))
    return out


def has_letter(c: ta.Chunk) -> np.ndarray:
    """Which texts have a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    total = np.concatenate([[0], np.cumsum(ascii_letter[c.data])])
    found = total[c.offsets[1:]] > total[c.offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(map(str.isalpha, c.data[c.offsets[k] : c.offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def vectors(batches):
    """One row per text: its language and its shares of features."""
    schema = pa.schema([("lang", pa.string()), ("shares", pa.binary())])
    for batch in batches:
        for c in ta.chunks(batch.column(0), CHUNK):
            idx = features(c.data)
            good = has_letter(c)
            out = []
            for k in range(c.n):
                part = slice(c.offsets[k], c.offsets[k + 1])
                x = sum(np.bincount(i[part], minlength=SIZE) for i in idx)
                out.append((x / max(1, part.stop - part.start)).astype(np.float16).tobytes() if good[k] else None)
            yield pa.record_batch([batch.column(1).slice(c.first, c.n), pa.array(out, pa.binary())], schema=schema)


def svm(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated full gradients; classes weigh the same.

    y is 1, -1, or 0 for rows of neither class, which have no weight.
    """
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = ((y > 0) * (0.5 / max(1, (y > 0).sum())) + (y < 0) * (0.5 / max(1, (y < 0).sum()))).astype(np.float32)
    v, c = w.copy(), b
    step = 1.0 / (2 * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + penalty)
    for t in range(steps):
        slack = (np.maximum(0, 1 - y * (x @ v + c)) * weight * y).astype(np.float32)
        w2, b2 = v - np.float32(step) * (np.float32(penalty) * v - 2 * (slack @ x)), c + step * 2 * float(slack.sum())
        pull = t / (t + 3)
        v, c = w2 + np.float32(pull) * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    return w, b


class Model:
    """A tree of two levels: one-versus-one SVMs between families, then inside each family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = sorted(langs)
        of = np.array([family_of(v) for v in y], object)
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.center = x.mean(0)
        self.scale = 1.0 / (x.std(0) + np.float32(1e-3))
        x -= self.center  # in place: the sample is the largest thing the driver holds
        x *= self.scale / np.float32(np.sqrt(x.shape[1]))
        self.pairs, columns, self.bias = [], [], []
        for group, labels in [(None, of), *((f, y) for f in self.families)]:
            for a, b in combinations(self.families if group is None else self.members[group], 2):
                w, c = svm(x, (labels == a) * np.float32(1) - (labels == b) * np.float32(1))
                w = w * self.scale / np.sqrt(x.shape[1])
                self.pairs.append((group, a, b))
                columns.append(w)
                self.bias.append(c - float(w @ self.center))
        self.weights = np.array(columns, np.float64).reshape(-1, x.shape[1]).T.copy()

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of texts, from all margins (texts x pairs)."""
        n = len(margins)
        chance = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))

        def vote(group, names):
            if len(names) == 1:
                return np.zeros(n, np.int64), np.ones(n)
            votes, least = np.zeros((n, len(names))), np.ones((n, len(names)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == group:
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += (margins[:, k] >= 0) + chance[:, k] * 1e-3
                    votes[:, j] += (margins[:, k] < 0) + (1 - chance[:, k]) * 1e-3
                    least[:, i] = np.minimum(least[:, i], chance[:, k])
                    least[:, j] = np.minimum(least[:, j], 1 - chance[:, k])
            best = votes.argmax(1)
            return best, least[np.arange(n), best]

        family, sure = vote(None, self.families)
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        for k, f in enumerate(self.families):
            here = family == k
            best, inside = vote(f, self.members[f])
            number = np.array([self.langs.index(v) for v in self.members[f]])
            lang[here] = number[best[here]]
            score[here] = (sure * inside)[here]
        return lang, score


def predictor(model: Model, skip: int, called: tuple[str, str]):
    """Adds a language and a score, named as called, to the columns from number skip on; the first is the text to judge."""

    def run(batches):
        weights = [np.ascontiguousarray(model.weights[:, k]) for k in range(len(model.pairs))]
        for batch in batches:
            for c in ta.chunks(batch.column(0), CHUNK):
                good = has_letter(c)
                margins = np.zeros((c.n, len(weights)))
                idx = features(c.data)
                size = np.maximum(1, np.diff(c.offsets))
                for k, w in enumerate(weights):
                    per_byte = w[idx[0]] + w[idx[1]] + w[idx[2]]
                    total = np.concatenate([[0.0], np.cumsum(per_byte)])
                    margins[:, k] = (total[c.offsets[1:]] - total[c.offsets[:-1]]) / size + model.bias[k]
                if model.langs:
                    best, score = model.predict(margins)
                    names = [model.langs[b] if g else UNKNOWN for b, g in zip(best, good, strict=True)]
                else:
                    names, score = [None if g else UNKNOWN for g in good], np.zeros(c.n)
                score = np.where(good, score, 0.0) if model.langs else score
                rest = [x.slice(c.first, c.n) for x in batch.columns[skip:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names[skip:], *called])

    return run


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


#: Languages that are learned: the most frequent ones.  Each pair in a family, and each pair of families, has an SVM.
MOST = 64


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int) -> Model:
    """Learns from about `bound` labelled rows at most, drawn by a hash of the id over all of them.

    Of a column with more than MOST values, as a dirty one has, the most frequent are learned
    (of equally frequent ones the first by code); rows of others teach nothing.
    """
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(MOST).collect()}
    if not counts:
        return Model([], np.zeros((1, SIZE), np.float32), np.array([], object))
    each = max(1, bound // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30) < share
    rows = labelled.where(draw).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(vectors, "lang string, shares binary").where("shares IS NOT NULL").collect()
    rows.sort()
    x, y = np.zeros((len(rows), SIZE), np.float32), np.array([r[0] for r in rows], object)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r[1], np.float16)
    rows.clear()
    return Model(sorted(set(y)), x, y) if len(x) else Model([], np.zeros((1, SIZE), np.float32), y)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 2000) -> DataFrame:
    """Predicts the language of every text.

    Learns from rows whose crc32 of the id is not 2 modulo 4 and whose language is known,
    about `bound` of them, the same number of each language; the bound keeps what the
    driver holds under 16 kB a row.  The text alone decides a prediction.  Text that is
    null or has no letter is `und` with score 0; so is everything if nothing is labelled.  A
    very long text is judged whole, by one task, in arrays of a few dozen bytes a byte.

    Returns doc_id, held_out, lang_pred, score for every row.
    """
    model = learn(docs, id_col, text_col, lang_col, bound)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    out = judged(rows, model, 1, ("lang_pred", "score"))
    return out.select("doc_id", held_out().alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score")


def judged(rows: DataFrame, model: Model, skip: int, called: tuple[str, str]) -> DataFrame:
    """rows from column number skip on, with a language (null for letters when nothing was learned) and its score; the first column is the text."""
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[skip:])
    return rows.mapInArrow(predictor(model, skip, called), f"{plain}, `{called[0]}` string, `{called[1]}` double")


def known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 2000, low: float = 0.35, contrary: float = 0.75) -> DataFrame:
    """The rows of docs whose text is in the language that it is said to be in, with docs' columns; a null language is filled in.

    A row goes if its text has no letter, if the predicted language has a score under `low`,
    or if it has one of `contrary` or more and is not the row's own language.  A language that
    isn't learned is contrary to any.  Null text has no letter; rows without an id and
    repeated rows are judged like others; a very long text is judged whole, by one task.
    """
    model = learn(docs, id_col, text_col, lang_col, bound)
    pred, score = store.unused(docs, "lang_pred"), store.unused(docs, "score")
    out = judged(docs.select(text_col, *(c for c in docs.columns if c != text_col)), model, 0, (pred, score))
    lettered, learned = ~F.col(pred).eqNullSafe(UNKNOWN), F.col(pred).isNotNull()
    gone = learned & ((F.col(score) < low) | ((F.col(score) >= contrary) & F.coalesce(F.col(lang_col) != F.col(pred), F.lit(False))))
    return out.where(lettered & ~gone).withColumn(lang_col, F.coalesce(lang_col, pred)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(store.table(spark, sf_dir, "documents"))
