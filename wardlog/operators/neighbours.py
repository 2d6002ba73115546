"""Exact nearest neighbours among distinct vectors, by pivots and the triangle inequality.

Every vector goes to its nearest pivot; a pivot's vectors are cut into blocks by their distance from it. First the nearest
within the block are found, which bounds how far a vector has to look: nothing beyond its k-th distance matters. A block
whose distances from its pivot put all of it beyond that bound is skipped; the vector is sent to the others, and the best
k of all answers count. Nothing is approximated at any size: bounds only skip what can't be near. In many dimensions little
can be skipped, and the work grows with the square of the distinct vectors, over as many tasks as there are blocks.

Pivots are the first vectors in hash order. Pivots and the table of blocks are bounded by `MAX_PIVOTS` and `MAX_BLOCKS`, so
they go to every task. Vectors sent to one block are dealt to several tasks when they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlog.session import stage

#: Vectors of a block, and vectors compared with a block at a time and in one task.
BLOCK_ROWS, STEP, TASK_ROWS = 2000, 256, 8000
MAX_PIVOTS, MAX_BLOCKS = 512, 1 << 16
#: Rings into which a pivot's vectors are cut by distance.
RINGS = 16
#: Relative slack of bounds, far above rounding errors and far below any use.
SLACK = 1e-9

_FOUND = "vid string, near string, distance double"


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, to rounding."""
    found = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.maximum(found, 0.0)


def nearest_in(ids: np.ndarray, points: np.ndarray, names: np.ndarray, others: np.ndarray, k: int) -> list[tuple[str, str, float]]:
    """The k nearest of `others` for every point but itself: (id, name, squared distance), ties to the smaller name.

    Products select, with slack; what is selected is measured by differences, so that a distance does not depend on
    the vectors around it.
    """
    found = []
    size = (others**2).sum(axis=1).max(initial=0.0)
    for start in range(0, len(ids), STEP):
        part, own = points[start : start + STEP], ids[start : start + STEP]
        squares = _squares(part, others)
        squares[own[:, None] == names[None, :]] = np.inf
        if k < len(names):
            limit = np.partition(squares, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(own), np.inf)
        slack = SLACK * ((part**2).sum(axis=1) + size)
        for i, name in enumerate(own):
            near = np.flatnonzero((squares[i] <= limit[i] + slack[i]) & np.isfinite(squares[i]))
            exact = ((others[near] - part[i]) ** 2).sum(axis=1)
            order = np.lexsort((names[near], exact))[:k]
            found += [(name, names[near[j]], float(exact[j])) for j in order]
    return found


def _table(found: list[tuple[str, str, float]]) -> pa.Table:
    ids, near, distance = zip(*found) if found else ((), (), ())
    return pa.table({"vid": pa.array(ids, pa.string()), "near": pa.array(near, pa.string()), "distance": pa.array(distance, pa.float64())})


def _names(rows: pa.Table) -> np.ndarray:
    return np.array(rows["vid"].to_pylist(), dtype=object)


def _inside(rows: pa.Table, k: int) -> pa.Table:
    """Nearest within one block."""
    names, points = _names(rows), _matrix(rows["v"])
    return _table(nearest_in(names, points, names, points, k))


def _across(asked: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """Nearest of one block for the vectors sent to it."""
    if not asked.num_rows or not block.num_rows:
        return _table([])
    return _table(nearest_in(_names(asked), _matrix(asked["v"]), _names(block), _matrix(block["v"]), k))


def _assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and the distance from it."""
    for batch in batches:
        if batch.num_rows:
            points = _matrix(batch.column("v"))
            cell = _squares(points, pivots).argmin(axis=1)
            away = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), batch.column("v"), pa.array(cell, pa.int64()), pa.array(away)], names=["vid", "v", "cell", "away"]
            )


def _sent(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, blocks: dict[str, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for every other block that may hold one of its k nearest."""
    cell, low, high, size, number = (blocks[c] for c in ("cell", "low", "high", "size", "block"))
    step = max(1, min(STEP, (1 << 22) // len(number)))
    for batch in batches:
        ids, vectors, own, bound = (batch.column(c) for c in ("vid", "v", "block", "bound"))
        for start in range(0, batch.num_rows, step):
            points = _matrix(vectors.slice(start, step))
            away = np.sqrt(np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1))[:, cell]
            # So many vectors lie within the farthest reach of the blocks with the nearest reach; one may be the vector itself.
            reach = away + high
            order = np.argsort(reach, axis=1)
            enough = (np.cumsum(size[order], axis=1) > k).argmax(axis=1)
            sure = np.where(size.sum() > k, np.take_along_axis(reach, order, 1)[np.arange(len(points)), enough], np.inf)
            limit = np.minimum(sure, bound.slice(start, step).to_numpy(zero_copy_only=False))
            least = np.maximum(np.maximum(away - high, low - away), 0.0)
            may = least <= (limit + SLACK * (limit + away.max(axis=1)))[:, None]
            may &= own.slice(start, step).to_numpy()[:, None] != number
            at, to = np.nonzero(may)
            for first in range(0, len(at), STEP * 4):  # a vector may go to many blocks
                rows = pa.array(at[first : first + STEP * 4] + start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), vectors.take(rows), pa.array(number[to[first : first + STEP * 4]], pa.int64())], names=["vid", "v", "block"]
                )


def nearest_vectors(vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other vectors of every distinct vector (vid, v): (vid, near, distance), distance squared.

    Exact at every size; ties go to the smaller vid. Fewer than k where there are no more.
    """
    vectors = vectors.select("vid", F.col("v").cast("array<double>").alias("v"))
    total = vectors.count()
    block_rows = max(block_rows, -(-total // MAX_BLOCKS))
    wanted = min(MAX_PIVOTS, -(-total // block_rows))
    if wanted <= 1:
        cells = vectors.withColumns({"cell": F.lit(0).cast("long"), "away": F.lit(0.0)})
        pivots = None
    else:
        first = vectors.orderBy(F.xxhash64("vid"), "vid").limit(wanted).toArrow()
        pivots = _matrix(first["v"])
        cells = stage(vectors.mapInArrow(lambda b: _assigned(b, pivots), "vid string, v array<double>, cell long, away double"), "cells")
    share = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", share, 1000).alias("cuts"))
    pieces = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("away"))) * pieces / RINGS)
    ringed = cells.join(F.broadcast(sizes), "cell").select("vid", "v", "cell", "away", ring.alias("ring"))
    # A ring that is still too large (many equal distances) is dealt by hash.
    parts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    dealt = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")))
    key = F.xxhash64("cell", "ring", "part")
    placed = stage(dealt.select("vid", "v", "cell", "away", key.alias("block")), "blocks")
    inside = stage(placed.select("block", "vid", "v").groupBy("block").applyInArrow(lambda rows: _inside(rows, k), _FOUND), "inside")
    if pivots is None:
        return inside
    counted = placed.groupBy("block").agg(F.first("cell").alias("cell"), F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("size"))
    table = counted.toArrow()  # at most RINGS * (MAX_PIVOTS + MAX_BLOCKS) rows of numbers
    blocks = {name: table[name].to_numpy() for name in table.column_names}
    last = inside.groupBy("vid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = placed.select("vid", "v", "block").join(last, "vid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asked = stage(bounded.mapInArrow(lambda b: _sent(b, pivots, blocks, k), "vid string, v array<double>, block long"), "asked")
    tasks = asked.groupBy("block").agg(F.ceil(F.count("*") / TASK_ROWS).alias("tasks"))
    left = asked.join(tasks, "block").withColumn("task", F.pmod(F.xxhash64("vid"), F.col("tasks"))).select("block", "task", "vid", "v")
    right = placed.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).select("block", "task", "vid", "v")
    across = left.groupBy("block", "task").cogroup(right.groupBy("block", "task")).applyInArrow(lambda a, b: _across(a, b, k), _FOUND)
    best = Window.partitionBy("vid").orderBy("distance", "near")
    return inside.unionByName(across).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
