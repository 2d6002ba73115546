"""Fill-in-the-middle transformation whose cuts come from a piecewise-linear learned rank index.

A text's units are its lines. The index of a text maps a rank (a number of units) to the offset at which that unit ends. A
shrinking cone runs once over all boundaries: as long as one line through the first point of a segment passes within
`ERROR` characters of every boundary, they share the segment; the next boundary opens a new one. Kept are the segments
(first rank, offset, slope) and one small residual per boundary. A cut is predicted from its segment and corrected by its
residual, so it is exact, whatever the slope. The index takes two bytes per line besides the segments.

The transformation hashes seed and id, takes two ranks, predicts both cuts and writes prefix, suffix and middle in the form
that the hash names. `restore` rebuilds the text from output and form alone. Every row is worked on alone: nothing is
shuffled, and a task holds one Arrow batch of texts.

Edge cases: null text is the empty text. Empty texts and texts that hold a mark stay plain. A null id hashes as an empty
string of digits. Repeated rows are cut alike. A text without line breaks is one unit; a text of any length is read whole.
An empty table gives no rows. Extra columns are not read. Marks must not overlap, or the parts could not be told apart.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import Batches, as_batch, text_of

MARKS = ("<P>", "<S>", "<M>")
#: Bound of a prediction's error in characters; residuals are kept in two bytes.
ERROR = 512
#: Characters decoded at a time, boundaries of one cone step, and characters of an outgoing batch.
STRIPE, WINDOW, BATCH = 1 << 20, 256, 1 << 22

_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)
_ROWS_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_INDEX = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("ranks", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("slopes", pa.list_(pa.float64())),
        ("residuals", pa.binary()),
    ]
)
_INDEX_DDL = "doc_id long, n long, ranks array<long>, offsets array<long>, slopes array<double>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points at which 0, 1, ... units end."""
    found = [np.zeros(1, np.int64)]
    for start in range(0, len(text), STRIPE):
        points = np.frombuffer(text[start : start + STRIPE].encode("utf-32-le", "surrogatepass"), "<u4")
        found.append(np.flatnonzero(points == 10) + (start + 1))
    if text and not text.endswith("\n"):
        found.append(np.array([len(text)]))
    return np.concatenate(found)


def _reach(offsets: np.ndarray, first: int, error: int) -> tuple[int, float]:
    """First boundary that a segment from `first` can't take in, and the slope of the segment."""
    low, high, slope, at = 0.0, np.inf, 0.0, first + 1
    while at < len(offsets):
        steps = np.arange(at, min(at + WINDOW, len(offsets))) - first
        rise = offsets[at : at + WINDOW] - offsets[first]
        lows = np.maximum.accumulate(np.maximum((rise - error) / steps, low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / steps, high))
        fits = int(np.searchsorted(lows > highs, True))
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
            slope = (low + high) / 2
        at += fits
        if fits < len(steps):
            break
    return at, slope


class RankIndex:
    """Segments and residuals of one text; `offset(rank)` is exact."""

    def __init__(self, ranks: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, residuals: np.ndarray):
        self.ranks, self.offsets, self.slopes, self.residuals = ranks, offsets, slopes, residuals

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        ranks, slopes, at = [], [], 0
        while at < len(offsets):
            ranks.append(at)
            at, slope = _reach(offsets, at, error)
            slopes.append(slope)
        found = cls(np.array(ranks), offsets[ranks], np.array(slopes), np.zeros(len(offsets), np.int16))
        every = np.arange(len(offsets))
        found.residuals = (offsets - found.predict(every)).astype(np.int16 if error < 1 << 15 else np.int64)
        return found

    def predict(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.ranks, rank, "right") - 1
        return self.offsets[segment] + np.floor(self.slopes[segment] * (rank - self.ranks[segment])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets: predictions corrected by the stored residuals."""
        return self.predict(rank) + self.residuals[rank]


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if no end of one is the beginning of another: then no mark can arise where parts meet."""
    for a in marks:
        for b in marks:
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"marks must not be empty or overlap: {marks}")
    return marks


def _numbers(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit groups of the hash of seed and id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def _transformed(doc_id: int | None, text: str, seed: int, percent: int, spm: int, marks: tuple[str, str, str]) -> tuple:
    edges = boundaries(text)
    n = len(edges) - 1
    h1, h2, h3, h4 = _numbers(seed, doc_id)
    if not text or any(m in text for m in marks) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    cuts = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
    low, high = RankIndex.fit(edges).offset(cuts).tolist()
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    before, after, between = marks
    if h4 % 100 < spm:
        return doc_id, n, "spm", low, high - low, "".join((after, suffix, before, prefix, between, middle))
    return doc_id, n, "psm", low, high - low, "".join((before, prefix, after, suffix, between, middle))


def _rows(batches: Batches, seed: int, percent: int, spm: int, marks: tuple[str, str, str]) -> Batches:
    for batch in batches:
        out, size = [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            out.append(_transformed(doc_id.as_py(), text.as_py(), seed, percent, spm, marks))
            size += len(out[-1][-1])
            if size >= BATCH:
                yield _packed(_ROWS, out)
                out, size = [], 0
        if out:
            yield _packed(_ROWS, out)


def _packed(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return as_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


def _indexed(batches: Batches, error: int) -> Batches:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            edges = boundaries(text.as_py())
            found = RankIndex.fit(edges, error)
            row = (doc_id.as_py(), len(edges) - 1, found.ranks, found.offsets, found.slopes, found.residuals.astype("<i8" if error >= 1 << 15 else "<i2").tobytes())
            yield _packed(_INDEX, [row])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))


def boundary_index(docs: DataFrame, error: int = ERROR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of each text as a row: doc_id, n, ranks, offsets and slopes of the segments, residuals (little-endian)."""
    return _texts(docs, key, text).mapInArrow(lambda batches: _indexed(batches, error), _INDEX_DDL)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm: int = 50,
    marks: tuple[str, str, str] = MARKS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per text: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    `percent` of the texts are transformed, `spm` percent of these with the suffix first; `marks` stand before prefix,
    suffix and middle.
    """
    checked_marks(marks)
    return _texts(docs, key, text).mapInArrow(lambda batches: _rows(batches, seed, percent, spm, marks), _ROWS_DDL)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before the transformation, from output and form alone."""
    any_mark = "|".join(re.escape(m) for m in checked_marks(marks))
    parts = F.split(output, any_mark, 4)  # what stands before the first mark is empty
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
