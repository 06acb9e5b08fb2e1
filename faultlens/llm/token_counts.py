"""Token counts of a unigram tokenizer, without its tokens.

A vocabulary with scores is read from a public tokenizer's file; the tokenizer is the
unigram model over it: white space marks begin pieces, the best-scoring segmentation of a
stretch wins, a character that no piece covers costs the least score less ten and counts
its bytes.  Stretches between marks are independent, so each distinct short one is
segmented once: an Aho-Corasick automaton lists the pieces that end at each place, longest first, and only the best score
and its piece count are carried on.  On equal scores the longest piece stays, as it does
in the tokenizer, which meets earlier starts first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarrays as ta

MARK = "▁"
PENALTY = 10.0
#: What a worker remembers: stretches up to LONG characters, MEMO characters of them in all.
LONG, MEMO = 64, 4_000_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter(dict):
    """stretch -> complex(score, pieces) of its best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest, self.held = max(len(piece) for piece, _ in vocabulary), 0
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        letters = set().union(*(piece for piece, _ in vocabulary))
        self.line_end = None if "\n" in letters else complex(self.unknown, 1)

    def __missing__(self, stretch: str) -> complex:
        value = self.best(stretch)
        if len(stretch) <= LONG:
            self.held += len(stretch)
            if self.held > MEMO:
                self.clear()
                self.held = len(stretch)
            self[stretch] = value
        return value

    def best(self, text: str) -> complex:
        """The best segmentation's score and pieces; long stretches go through a ring."""
        if len(text) > LONG:
            return self.best_of_long(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            ending[end].append(match)
        score, pieces = [0.0], [0]
        for end, matches in enumerate(ending):
            top, count, single = None, 0, False
            for length, value in matches:
                start = end + 1 - length
                reached = score[start] + value
                if top is None or reached > top:
                    top, count = reached, pieces[start] + 1
                if length == 1:
                    single = True
            if not single and (top is None or score[end] + self.unknown > top):
                top, count = score[end] + self.unknown, pieces[end] + len(text[end].encode())
            score.append(top)
            pieces.append(count)
        return complex(score[-1], pieces[-1])

    def best_of_long(self, text: str) -> complex:
        """As best(); only as many places as the longest piece has characters are kept, whatever the stretch."""
        size = self.longest + 1
        score, pieces = [0.0] * size, [0] * size
        done = 0

        def close(end: int, matches: list[tuple[int, float]]) -> None:
            top, count, single = None, 0, False
            for length, value in matches:
                start = (end + 1 - length) % size
                single = length == 1 or single
                if top is None or score[start] + value > top:
                    top, count = score[start] + value, pieces[start] + 1
            last = end % size
            if not single and (top is None or score[last] + self.unknown > top):
                top, count = score[last] + self.unknown, pieces[last] + len(text[end].encode())
            score[(end + 1) % size], pieces[(end + 1) % size] = top, count

        matches: list[tuple[int, float]] = []
        for end, match in self.automaton.iter(text):
            if end > done and matches:
                close(done, matches)
                done, matches = done + 1, []
            while done < end:
                close(done, matches)
                done += 1
            matches.append(match)
        while done < len(text):
            close(done, matches)
            done, matches = done + 1, []
        return complex(score[len(text) % size], pieces[len(text) % size])

    def count(self, text: str) -> complex:
        if not text:
            return 0j
        text = text.replace(" ", MARK)
        lines = (text if text[0] == MARK else MARK + text).split("\n") if self.line_end else [text if text[0] == MARK else MARK + text]
        total = (len(lines) - 1) * self.line_end if self.line_end else 0j
        for line in lines:
            head, *rest = line.split(MARK)
            if head:
                total += self[head]
            for word in rest:
                total += self[MARK + word]
        return total


def counter(path: str) -> Counter:
    memo = ta.process_memo()
    if ("unigram", path) not in memo:
        memo["unigram", path] = Counter(load_vocabulary(path))
    return memo["unigram", path]


def count_rows(path: str):
    def run(batches):
        c = counter(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            values = [c.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([int(v.imag) for v in values], pa.int64()), pa.array([v.real for v in values], pa.float64())], schema=schema)

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and score (of the best segmentation) of every row.

    vocabulary: a sentencepiece file.  Null and empty text: no tokens, score 0.  Rows
    without an id and repeated rows are counted like others; a stretch without white space,
    however long, takes time by its length and the memory of one longest piece.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(count_rows(vocabulary or default_vocabulary()), "doc_id long, n_tokens long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(store.table(spark, sf_dir, "documents"))
