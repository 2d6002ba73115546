"""Exact top-k inner products on a bit-sliced index.

Components become whole numbers floor(scale * x). Candidates are packed into blocks; a block holds, for each dimension
and each bit of the shifted component, one bitmap with a bit per row. A query adds, for each dimension, the bitmaps
times the bits of its own component with carry-save adders: every step is one bitmap operation on all rows of the
block, and the sum comes out as bitmaps again. The selection walks these from the most significant slice down: rows with
the bit are certain while they are fewer than k, otherwise only they stay possible. Rows that are still possible after the
last slice have equal scores at the boundary, and their ids decide. Negative query components use the
complement of the bits, so that all weights are positive and sums need no sign.

Queries are a stated set and are packed into blocks too; each pair of a query block and a candidate block is one task's
unit of work, and gives at most k rows per query. Every row is a candidate; nothing is sampled or approximate.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part. Missing trailing components of
shorter vectors count as 0. Repeated ids are rows of their own: a query leaves out its own row alone. Rows without an id
are no queries but candidates like any other, found with a null id. Equal scores are ordered by id, null last. With
fewer than k candidates all are returned. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlog.session import stage

SCALE, TOP = 64, 20
#: Rows of a candidate block at most; a group of queries holds between LEAST_QUERIES and as many, for about
#: AIM_PAIRS pairs of both.
BLOCK_ROWS, LEAST_QUERIES, AIM_PAIRS = 32_768, 256, 64

_BLOCK_DDL = "block long, kind string, width int, named int, ids binary, vectors binary"
_QUERY = pa.schema([("origin", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("q", pa.list_(pa.int64()))])
_FOUND_DDL = "origin long, place long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors that take part; q holds floor(scale * x) of each component."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(whole).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"),
    )


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled with 0 and longer ones cut."""
    lengths = np.diff(lists.offsets.to_numpy())
    matrix = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))), np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return matrix[:, :width]


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One block as one row: ids ascending, rows without one after the `named` others, components in the narrowest type that holds them."""
    lists = rows["q"].combine_chunks()
    matrix = _matrix(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.array_equal(matrix.astype(k), matrix))
    unnamed = rows["vec_id"].is_null().to_numpy()
    ids = rows["vec_id"].fill_null(0).to_numpy().astype("<i8")
    order = np.lexsort((ids, unnamed))
    named = len(ids) - int(unnamed.sum())
    row = [key[0].as_py(), kind, matrix.shape[1], named, ids[order].tobytes(), matrix[order].astype(kind).tobytes()]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["block", "kind", "width", "named", "ids", "vectors"]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


class SlicedBlock:
    """Bitmaps of a block: slices[d][j] holds bit j of the shifted component d of every row."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.rows = ids, len(ids)
        self.words = -(-self.rows // 64)
        self.low = matrix.min(axis=0)
        self.high = matrix.max(axis=0)
        self.slices: list[list[np.ndarray]] = []
        self.inverse: list[list[np.ndarray]] = []
        shifted = (matrix - self.low).astype(np.uint64)
        for d in range(matrix.shape[1]):
            bits = int(self.high[d] - self.low[d]).bit_length()
            own = [self._bitmap(shifted[:, d] >> np.uint64(j) & np.uint64(1)) for j in range(bits)]
            self.slices.append(own)
            self.inverse.append([~s for s in own])
        self.all = self._bitmap(np.ones(self.rows, np.uint8))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        filled = np.zeros(self.words * 64, np.uint8)
        filled[: self.rows] = bits
        return np.packbits(filled, bitorder="little").view("<u8")

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the score, lowest bit first, and what must be added to the number they spell."""
        columns: list[list[np.ndarray]] = [[]]
        constant = 0
        for d, weight in enumerate(query.tolist()):
            own = self.slices[d] if weight > 0 else self.inverse[d]
            # x = low + u; and -x = -(low + 2^bits - 1) + the complement of u.
            constant += weight * (int(self.low[d]) + (0 if weight > 0 else (1 << len(own)) - 1))
            bits = abs(weight)
            for shift in range(bits.bit_length()):
                if bits >> shift & 1:
                    while len(columns) < shift + len(own):
                        columns.append([])
                    for j, bitmap in enumerate(own):
                        columns[shift + j].append(bitmap)
        total: list[np.ndarray] = []
        for at in range(len(columns) + 64):
            if at >= len(columns):
                break
            column = columns[at]
            while len(column) > 1:  # full adders, and a half adder for the last two
                a, b = column.pop(), column.pop()
                half, carry = a ^ b, a & b
                if column:
                    c = column.pop()
                    carry |= half & c
                    half = half ^ c
                column.insert(0, half) if len(column) > 1 else column.append(half)
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1].append(carry)
            total.append(column[0] if column else np.zeros(self.words, "<u8"))
        return total, constant

    def top(self, query: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows, best first; equal scores by place, which is the order of ids."""
        slices, constant = self.score_slices(query)
        possible = self.all.copy()
        if without >= 0:
            possible[without // 64] &= ~np.uint64(1 << (without % 64))
        certain, found = np.zeros(self.words, "<u8"), 0
        for bitmap in reversed(slices):
            with_bit = possible & bitmap
            n = int(np.bitwise_count(with_bit).sum())
            if found + n > k:
                possible = with_bit
            else:
                certain |= with_bit
                found += n
                possible &= ~bitmap
                if found == k:
                    break
        places = np.concatenate([self._places(certain), self._places(possible)[: k - found]])
        scores = np.full(len(places), constant, np.int64)
        for j, bitmap in enumerate(slices):
            scores += (bitmap[places // 64] >> (places % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << j
        order = np.lexsort((places, -scores))
        return places[order], scores[order]

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        filled = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[filled].view(np.uint8), bitorder="little").reshape(-1, 64)
        row, bit = np.nonzero(bits)
        return filled[row] * 64 + bit


def _load(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["width"]).astype(np.int64)


def _queries_of(batches, every: int):
    """The rows of the candidate blocks that are queries, with the block and place they come from."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = _load(row)
            chosen = np.flatnonzero(ids[: row["named"]] % every == 0)
            columns = ([row["block"]] * len(chosen), chosen, ids[chosen], vectors[chosen].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _QUERY, strict=True)], schema=_QUERY)


def _search(key: tuple, block: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One candidate block with one group of queries."""
    names = ["origin", "place", "query_id", "vec_id", "score"]
    out = [np.zeros((0, 6), np.int64)]
    if len(block) and len(queries):
        held = block.to_pylist()[0]
        ids, vectors = _load(held)
        index = SlicedBlock(ids, vectors)
        own, places, asked = (queries[c].to_numpy() for c in ("origin", "place", "query_id"))
        for i, query in enumerate(_matrix(queries["q"].combine_chunks(), vectors.shape[1])):
            found, scores = index.top(query, k, int(places[i]) if own[i] == key[0].as_py() else -1)
            same = np.ones(len(found), np.int64)
            out.append(np.column_stack([same * own[i], same * places[i], same * asked[i], ids[found], scores, found >= held["named"]]))
    rows = np.concatenate(out)
    columns = [pa.array(rows[:, i], pa.int64(), mask=rows[:, 5] == 1 if name == "vec_id" else None) for i, name in enumerate(names)]
    return pa.table(columns, names=names)


def search(vectors: DataFrame, every: int = 20, k: int = TOP, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best other rows of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = stage(quantised(vectors, scale, key, vector).withColumn("row", F.monotonically_increasing_id()), "quantised")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    numbered = rows.groupBy(F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).alias("block"))
    index = stage(numbered.applyInArrow(_pack, _BLOCK_DDL), "slices")
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    groups = max(1, -(-n_queries // min(BLOCK_ROWS, max(LEAST_QUERIES, n_queries * blocks // AIM_PAIRS))))
    queries = index.mapInArrow(lambda b: _queries_of(b, every), "origin long, place long, query_id long, q array<long>")
    # The stated queries go in groups to every block, each block to every group.
    asked = queries.withColumn("group", F.pmod(F.xxhash64("origin", "place"), F.lit(groups))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    )
    held = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    found = held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(
        lambda key, left, right: _search(key, left, right, k), _FOUND_DDL
    )
    best = F.row_number().over(Window.partitionBy("origin", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
