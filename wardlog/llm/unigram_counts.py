"""Token counts under a unigram vocabulary, without building tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; a dynamic programme over the
characters carries the best score and the number of pieces of the best path, never the path. Ties follow the unigram
model of the `tokenizers` library: starts are tried in ascending order and only a strictly better score replaces, so of
equal scores the longest last piece stays. A character that no piece covers alone may be read as unknown at the lowest
score less ten, and then counts one piece per UTF-8 byte.

No piece of the vocabulary holds a word-start mark after another character, or a line break, so a text falls into
segments that are solved alone and looked up when seen again. Scores are whole numbers, and 64-bit sums of them exact.

Edge cases: null and empty text have no tokens and score 0. Any character may occur. A text without blanks is one segment
of its whole length; time and memory are linear in it. Repeated rows get a row each. Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import Batches, as_batch, text_of

VOCABULARY = "piece_bpe_32k.model"
#: The word-start mark of the vocabulary and the penalty for unknown characters: fixed values.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Solved segments kept by a Python worker, and the longest that is kept.
CACHED_SEGMENTS = 1 << 19
CACHED_CHARS = 48

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def vocabulary_pieces(vocabulary: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, in order of their ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter(dict):
    """Segment -> place of its count and score in two arrays; unknown segments are solved on first sight."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        if any("\n" in p or MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("segments of this vocabulary can't be solved alone")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.counts = np.zeros(CACHED_SEGMENTS, np.int64)
        self.scores = np.zeros(CACHED_SEGMENTS)

    def solve(self, segment: str) -> tuple[int, float]:
        """Number of pieces and score of the best path."""
        size = len(segment)
        best, count = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        done, alone = 0, False  # characters whose paths are final; whether a piece covers the next one alone

        def unknown(at: int) -> None:
            score = best[at] + self.unknown
            if score > best[at + 1]:
                best[at + 1], count[at + 1] = score, count[at] + len(segment[at].encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(segment):  # of one end, the longest piece comes first
            while done < end:
                if not alone:
                    unknown(done)
                done, alone = done + 1, False
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[end + 1 - length] + 1
            alone |= length == 1
        while done < size:
            if not alone:
                unknown(done)
            done, alone = done + 1, False
        return count[size], best[size]

    def __missing__(self, segment: str) -> int:
        at = len(self)
        self.counts[at], self.scores[at] = self.solve(segment)
        self[segment] = at
        return at

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        total, score = 0, 0.0
        segments: list[str] = []
        lines = text.replace(MARK, " ").split("\n")
        for number, line in enumerate(lines):
            blanks = int(number == 0)
            words = line.split(" ")
            for place, word in enumerate(words):
                blanks += place > 0
                if word:
                    segments.append(MARK + word if blanks == 1 else MARK * blanks + word)
                    blanks = 0
            if blanks:
                segments.append(MARK * blanks)
        total += len(lines) - 1
        score += (len(lines) - 1) * self.unknown
        for n, s in (self.solve(x) for x in segments if len(x) > CACHED_CHARS):
            total, score = total + n, score + s
        short = [x for x in segments if len(x) <= CACHED_CHARS]
        if len(self) + len(short) >= CACHED_SEGMENTS:
            self.clear()
        for part in range(0, len(short), CACHED_SEGMENTS // 2):
            if part:
                self.clear()
            places = np.fromiter(map(self.__getitem__, short[part : part + CACHED_SEGMENTS // 2]), np.int64)
            total, score = total + int(self.counts[places].sum()), score + float(self.scores[places].sum())
        return total, score


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> UnigramCounter:
    return UnigramCounter(vocabulary_pieces(vocabulary))


def _count(batches: Batches, vocabulary: str) -> Batches:
    counter = _counter(vocabulary)
    for batch in batches:
        found = [counter.count(t) for t in batch.column("text").to_pylist()]
        yield as_batch(_SCHEMA, doc_id=batch.column("doc_id"), n_tokens=[n for n, _ in found], score=[s for _, s in found])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score of the best segmentation."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(lambda batches: _count(batches, vocabulary), "doc_id long, n_tokens long, score double")
