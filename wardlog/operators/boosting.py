"""Second-order boosted trees for a 0/1 label, with L1, L2 and a least gain.

Features are binned once by quantiles. A tree grows level by level: each task adds up first and second derivatives of the
logistic loss of its rows per (node, feature, bin); the cells are summed by a grouped aggregate, prefix sums over the bins
give both sides of every split, and the best split of each node is a maximum. Only these, one row per open node, reach the
driver. Leaf weights are Newton steps. Derivatives are kept as fixed-point numbers, so sums, splits and weights do not
depend on the order of rows or tasks.

Rows keep their bins, label, weight and margin in a staged table, which is written anew every `STAGE_ROUNDS` trees; the trees
since then are applied in the tasks. Missing values count as the lowest. Sampling of rows and features follows the seed.

Searches fit many models on the same rows (`areas`, `fit`). Equal rows are counted first; where few enough differ, a model is grown
within one task from the counted rows, by the same sums and splits, and the models of a search are the tasks of one job. Else each model
is trained over the whole table as above. Random forests of a search are grown in the same way, or else by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from wardlog.session import stage

#: Units of a derivative; sums of 2^30 rows of weight 1 fit 64 bits.
UNIT = 1 << 30
STAGE_ROUNDS = 20
#: Different rows times features up to which a task holds the rows of a model; (node, bin) sums that it makes at once.
TASK_CELLS, SUMMED_CELLS = 16_000_000, 2_000_000

_CELLS = "node int, feature int, bin int, g long, h long"


@dataclass(frozen=True)
class Settings:
    """Defaults of the library's booster, with the regularisation terms."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    least_weight: float = 1.0
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes numbered as in a heap, from 0: feature (-1 for a leaf), bin from which rows go right, gain and weight."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut = np.full(size, -1), np.zeros(size, np.int64)
        self.gain, self.weight = np.zeros(size), np.zeros(size)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, or open node, of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            feature = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] >= self.cut[at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at


def fit_edges(vectors: DataFrame, bins: int) -> list[np.ndarray]:
    """Ascending edges of each feature's bins from quantiles of (v array<double>): bin b holds edges[b-1] <= x < edges[b]."""
    share = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = F.coalesce(F.nanvl("x", F.lit(float("-inf"))), F.lit(float("-inf")))
    each = vectors.select(F.posexplode("v").alias("feature", "x")).withColumn("x", known)
    rows = each.groupBy("feature").agg(F.percentile_approx("x", share, 10_000).alias("cuts"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    found = {r.feature: np.unique([c for c in [*r.cuts, r.high] if c > r.low]) for r in rows}  # a bounded list per feature
    return [found[i] for i in range(len(found))]


def binned(vectors: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix; missing values are in the lowest."""
    values = np.where(np.isnan(vectors), -np.inf, vectors)
    return np.stack([np.searchsorted(e, values[:, i], "right") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def derivatives(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss in fixed-point units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(weight * (p - label) * UNIT).astype(np.int64), np.rint(weight * p * (1 - p) * UNIT).astype(np.int64)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _margin(stored: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        stored = stored + tree.weight[tree.nodes(bins)]
    return stored


def _drawn(key: np.ndarray, round_: int, settings: Settings) -> np.ndarray:
    """Rows of this tree's sample, by a hash of row key, seed and round."""
    if settings.rows >= 1:
        return np.ones(len(key), bool)
    x = key.view(np.uint64) + np.uint64((settings.seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < settings.rows


def drawn_columns(count: int, round_: int, settings: Settings) -> np.ndarray:
    """Features of this tree's sample, at least one."""
    wanted = max(1, round(count * settings.columns))
    return np.sort(np.random.default_rng([settings.seed, round_]).permutation(count)[:wanted])


def _cells(batches: Iterator[pa.RecordBatch], trees: list[Tree], tree: Tree, level: int, round_: int, columns: np.ndarray, width: int, settings: Settings):
    """Sums of derivatives of a task's rows per open node, feature and bin; empty cells are left out."""
    first, open_ = 2**level - 1, 2**level
    sums = np.zeros((2, len(columns), open_ * width), np.int64)
    seen = np.zeros((len(columns), open_ * width), bool)
    for batch in batches:
        bins = _matrix(batch.column("bins"), np.uint8)
        keep = _drawn(batch.column("key").to_numpy(), round_, settings)
        node = tree.nodes(bins) - first
        keep &= (node >= 0) & (tree.feature[np.maximum(node + first, 0)] < 0)
        bins, node = bins[keep], node[keep]
        if not len(bins):
            continue
        stored, label, weight = (batch.column(c).to_numpy()[keep] for c in ("margin", "label", "weight"))
        both = derivatives(_margin(stored, bins, trees), label, weight)
        for i, column in enumerate(columns):
            cell = node * width + bins[:, column]
            for side, values in enumerate(both):
                # Sums of one batch stay below 2^53, so that the float sums of bincount are exact.
                sums[side, i] += np.bincount(cell, values, open_ * width).astype(np.int64)
            seen[i] |= np.bincount(cell, minlength=open_ * width) > 0
    at, cell = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array((cell // width + first).astype(np.int32)), pa.array(columns[at].astype(np.int32)), pa.array((cell % width).astype(np.int32)), pa.array(sums[0, at, cell]), pa.array(sums[1, at, cell])],
        names=["node", "feature", "bin", "g", "h"],
    )


def _shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def best_splits(cells: DataFrame, settings: Settings) -> DataFrame:
    """Per open node: g, h of all its rows, and its best split (gain, feature, cut), null where none gains enough."""
    total = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    every = Window.partitionBy("node", "feature")
    before = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sides = total.select(
        "node", "feature", "bin", *[(F.sum(c).over(w) / float(UNIT)).alias(n) for c in "gh" for w, n in ((before, f"l{c}"), (every, c))]
    )

    def score(g: Column, h: Column) -> Column:
        return _shrunk(g, settings.l1) ** 2 / (h + settings.l2)

    g, h, lg, lh = (F.col(c) for c in ("g", "h", "lg", "lh"))
    gain = 0.5 * (score(lg, lh) + score(g - lg, h - lh) - score(g, h)) - settings.gamma
    allowed = lg.isNotNull() & (lh >= settings.least_weight) & (h - lh >= settings.least_weight) & (gain > 0)
    split = F.when(allowed, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("cut")))
    return sides.withColumn("split", split).groupBy("node").agg(F.first("g").alias("g"), F.first("h").alias("h"), F.max("split").alias("split"))


def leaf_weight(g: float, h: float, settings: Settings) -> float:
    """Newton's step, shrunk by L1 and L2 and by the learning rate."""
    return float(-settings.rate * np.sign(g) * max(abs(g) - settings.l1, 0.0) / (h + settings.l2))


def _grown(state: DataFrame, trees: list[Tree], round_: int, edges: list[np.ndarray], settings: Settings) -> Tree:
    tree, width = Tree(settings.depth), max(map(len, edges)) + 1
    columns = drawn_columns(len(edges), round_, settings)
    for level in range(settings.depth + 1):
        cells = state.mapInArrow(lambda b, level=level: _cells(b, trees, tree, level, round_, columns, width, settings), _CELLS)
        found = best_splits(cells, settings).collect()  # one row per open node
        for row in found:
            tree.weight[row.node] = leaf_weight(row.g, row.h, settings)
            if row.split is not None and level < settings.depth:
                tree.feature[row.node], tree.cut[row.node], tree.gain[row.node] = -row.split.feature, -row.split.cut, row.split.gain
        if not any(tree.feature[row.node] >= 0 for row in found):
            break
    return tree


@dataclass
class NewtonModel:
    """Edges of the bins and trees; margins start at 0."""

    edges: list[np.ndarray]
    trees: list[Tree]
    names: list[str]
    forest: bool = False  # leaves hold shares of class 1, whose mean is the probability

    def score(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Adds `probability`."""
        edges, trees, forest = self.edges, self.trees, self.forest

        @F.pandas_udf("double")
        def probability(vectors):
            if not len(vectors):
                return pd.Series([], dtype=float)
            bins = binned(np.stack(vectors.to_numpy()), edges)
            if bins.shape[1]:  # equal rows of a batch go through the trees once
                _, first, place = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
                margin = _margin(np.zeros(len(first)), bins[first], trees)[place]
            else:
                margin = _margin(np.zeros(len(bins)), bins, trees)
            return pd.Series(margin / len(trees) if forest else 1 / (1 + np.exp(-margin)))

        return rows.withColumn("probability", probability(vector_to_array(features)))

    def splits(self, spark: SparkSession) -> DataFrame:
        """One row per node: tree, node, feature and threshold (null for a leaf), gain, weight."""
        rows = []
        for number, tree in enumerate(self.trees):
            reached = {0}
            for node in range(len(tree.feature)):
                if node in reached:
                    f = int(tree.feature[node])
                    reached |= {2 * node + 1, 2 * node + 2} if f >= 0 else set()
                    known = (self.names[f], float(self.edges[f][tree.cut[node] - 1])) if f >= 0 else (None, None)
                    rows.append((number, node, *known, float(tree.gain[node]), float(tree.weight[node])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, gain double, weight double")


def train(rows: DataFrame, ids: list[str], settings: Settings = Settings(), names: list[str] | None = None) -> NewtonModel:
    """Trees fitted on (features vector, label 0/1, weight); `ids` name a row in the sampling of rows."""
    if not 2 <= settings.bins <= 255:
        raise ValueError("bins must be between 2 and 255")
    vectors = rows.select(F.xxhash64(*ids).alias("key"), vector_to_array("features").alias("v"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    edges = fit_edges(vectors, settings.bins)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("v")
                bins = binned(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), edges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("label"), batch.column("weight"), pa.array(np.zeros(len(bins)))],
                    names=["key", "bins", "label", "weight", "margin"],
                )

    shape = "key long, bins binary, label double, weight double, margin double"
    state, trees, since = stage(vectors.mapInArrow(to_bins, shape), "binned"), [], []
    for round_ in range(settings.rounds):
        tree = _grown(state, since, round_, edges, settings)
        trees.append(tree)
        since = [*since, tree]
        if len(since) == STAGE_ROUNDS and round_ + 1 < settings.rounds:

            def moved(batches: Iterator[pa.RecordBatch], since: list[Tree] = since) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        margin = _margin(batch.column("margin").to_numpy(), _matrix(batch.column("bins"), np.uint8), since)
                        yield batch.set_column(4, "margin", pa.array(margin))

            state, since = stage(state.mapInArrow(moved, shape), "margins"), []
    return NewtonModel(edges, trees, names or [str(i) for i in range(len(edges))])


@dataclass
class PackedTree:
    """Nodes in the order they were opened: feature (-1 for a leaf), cut, left child (the right one follows), gain and weight."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(moving):
            moving = moving[self.feature[at[moving]] >= 0]
            node = at[moving]
            at[moving] = self.left[node] + (bins[moving, self.feature[node]] >= self.cut[node])
        return at


def _sums(cell: np.ndarray, values: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Integer sums of values per cell. Bincount adds floats; `exact` says that all sums stay below 2^53, else halves are added."""
    if exact:
        return np.bincount(cell, values, size).astype(np.int64)
    low = values & 0xFFFFF
    return (np.bincount(cell, values >> 20, size).astype(np.int64) << 20) + np.bincount(cell, low, size).astype(np.int64)


@dataclass
class Counted:
    """Different rows with their copies: bins, label, weight; held-out rows come last and have weight -1."""

    edges: list[np.ndarray]
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    copies: np.ndarray

    def __post_init__(self):
        self.train = int((self.weight >= 0).sum())
        self.widths = np.array([len(e) + 1 for e in self.edges])
        self.starts = np.concatenate([[0], np.cumsum(self.widths)])
        seen = self.bins[: self.train]
        # Most features are in one bin in most rows; the sums of that bin are what the others leave of the node's.
        common = np.array([np.bincount(seen[:, i], minlength=1).argmax() for i in range(len(self.edges))])
        row, self.entry_feature = (x.astype(np.int32) for x in np.nonzero(seen != common))
        self.entry_row, self.entry_cell = row, (self.starts[self.entry_feature] + seen[row, self.entry_feature]).astype(np.int32)
        self.common_cell, self.cell_feature = self.starts[:-1] + common, np.repeat(np.arange(len(self.edges)), self.widths)
        # A row's derivative is at most its weight; a bootstrap sample may be somewhat larger than the rows.
        self.exact = float((self.weight * self.copies)[: self.train].sum()) < 2**22


def _node_splits(data: Counted, entry_node: np.ndarray, row: np.ndarray, cell: np.ndarray, values: list, total: list, allowed: Callable, gains: Callable):
    """Best split of each open node as (gain, cell), gain 0 where none gains; ties go to the first feature and cut.

    `values` are g, h and drawn copies of the rows, `total` their sums per node.
    """
    width, heads = data.starts[-1], data.starts[:-1]
    found, at = np.zeros(len(total[0])), np.zeros(len(total[0]), np.int64)
    step = max(1, SUMMED_CELLS // int(width))
    for first in range(0, len(found), step):
        count = min(step, len(found) - first)
        here = (entry_node >= first) & (entry_node < first + count)
        index, rows = (entry_node[here] - first) * width + cell[here], row[here]
        before = []
        for value, whole in zip(values, total):
            part = _sums(index, value[rows], count * width, data.exact).reshape(count, width)
            part[:, data.common_cell] += whole[first : first + count, None] - np.add.reduceat(part, heads, axis=1)
            upto = np.cumsum(part, axis=1) - part
            before.append((part, upto - np.repeat(upto[:, heads], data.widths, axis=1)))
        (_, lg), (_, lh), (filled, below) = before
        every = [x[first : first + count, None] for x in total]
        gain = gains(lg / float(UNIT), lh / float(UNIT), below, every[0] / float(UNIT), every[1] / float(UNIT), every[2])
        gain = np.where(allowed(count) & (filled > 0) & (below > 0) & (gain > 0), gain, 0.0)
        best = gain.argmax(axis=1)
        at[first : first + count], found[first : first + count] = best, gain[np.arange(count), best]
    return found, at


def _grown_in_task(data: Counted, drawn: np.ndarray, g: np.ndarray, h: np.ndarray, kept: np.ndarray, allowed: Callable, gains: Callable, leaf: Callable, depth: int):
    """A tree from counted rows of which `drawn` copies count, and the node of each row, held-out ones included."""
    n, size = data.train, 1
    row, cell, values = data.entry_row[kept], data.entry_cell[kept], [g, h, drawn]
    feature, cut, left, gain, weight = [np.array([x]) for x in (-1, 0, 0, 0.0, 0.0)]
    at, opened = np.zeros(len(data.bins), np.int64), np.array([0])
    for level in range(depth + 1):
        slot = np.full(size, -1)
        slot[opened] = np.arange(len(opened))
        node = np.where(drawn > 0, slot[at[:n]], -1)
        live = node >= 0
        total = [_sums(node[live], x[live], len(opened), data.exact) for x in values]
        weight[opened] = [leaf(a, b) if c else 0.0 for a, b, c in zip(total[0] / float(UNIT), total[1] / float(UNIT), total[2])]
        if level == depth:
            break
        # Entries of closed nodes are dropped for good.
        entry_node = node[row]
        open_entry = entry_node >= 0
        row, cell = row[open_entry], cell[open_entry]
        found, best = _node_splits(data, entry_node[open_entry], row, cell, values, total, allowed, gains)
        split = opened[found > 0]
        if not len(split):
            break
        feature[split] = data.cell_feature[best[found > 0]]
        cut[split], gain[split] = best[found > 0] - data.starts[feature[split]], found[found > 0]
        left[split] = size + 2 * np.arange(len(split))
        opened, size = np.arange(size, size + 2 * len(split)), size + 2 * len(split)
        feature, cut, left, gain, weight = (np.concatenate([x, np.full(len(opened), y, x.dtype)]) for x, y in ((feature, -1), (cut, 0), (left, 0), (gain, 0), (weight, 0)))
        moving = np.flatnonzero(feature[at] >= 0)
        nodes = at[moving]
        at[moving] = left[nodes] + (data.bins[moving, feature[nodes]] >= cut[nodes])
    return PackedTree(feature, cut, left, gain, weight), at


def _boosted(data: Counted, margin: np.ndarray, round_: int, settings: Settings) -> tuple[PackedTree, np.ndarray]:
    """The next tree. Of each row's copies a binomial number is drawn, as if each copy were drawn by itself."""
    n, copies = data.train, data.copies[: data.train]
    drawn = copies if settings.rows >= 1 else np.random.default_rng([settings.seed, round_, 1]).binomial(copies, settings.rows)
    g, h = (x * drawn for x in derivatives(margin[:n], data.label[:n], data.weight[:n]))
    used = np.zeros(len(data.edges), bool)
    used[drawn_columns(len(data.edges), round_, settings)] = True
    kept, open_cells = used[data.entry_feature] & (drawn > 0)[data.entry_row], used[data.cell_feature]

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shrunk = np.maximum(np.abs(a) - settings.l1, 0.0)
        return np.divide(shrunk * shrunk, b + settings.l2, out=np.zeros_like(shrunk), where=b + settings.l2 > 0)

    def gains(lg, lh, below, all_g, all_h, every) -> np.ndarray:
        gain = 0.5 * (score(lg, lh) + score(all_g - lg, all_h - lh) - score(all_g, all_h)) - settings.gamma
        return np.where((lh >= settings.least_weight) & (all_h - lh >= settings.least_weight), gain, 0.0)

    return _grown_in_task(data, drawn, g, h, kept, lambda count: open_cells, gains, lambda a, b: leaf_weight(a, b, settings), settings.depth)


@dataclass(frozen=True)
class ForestSettings:
    """A random forest: bootstrap samples, and at each node the Gini gain of the rounded-up root of the features drawn there."""

    rounds: int = 20
    depth: int = 5
    least_rows: int = 1
    bootstrap: bool = True
    columns: int = 0  # features drawn at a node, 0 for the root of all
    bins: int = 64
    seed: int = 42


def _impurity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gini impurity times weight, of b weight with a in class 1."""
    return np.divide(2 * a * (b - a), b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _forest_tree(data: Counted, number: int, settings: ForestSettings) -> tuple[PackedTree, np.ndarray]:
    """A tree whose leaves hold the share of class 1. A bootstrap sample has a Poisson number of each row's copies."""
    n, count = data.train, len(data.edges)
    rng = np.random.default_rng([settings.seed, number, 2])
    drawn = rng.poisson(data.copies[:n]) if settings.bootstrap else data.copies[:n]
    h = np.rint(data.weight[:n] * UNIT).astype(np.int64) * drawn
    g = np.where(data.label[:n] == 1, h, 0)
    wanted = min(count, settings.columns or math.ceil(math.sqrt(count)))

    def allowed(nodes: int) -> np.ndarray:
        chance = rng.random((nodes, count))
        return (chance <= np.partition(chance, wanted - 1, axis=1)[:, wanted - 1 : wanted])[:, data.cell_feature]

    def gains(lg, lh, below, all_g, all_h, every) -> np.ndarray:
        gain = (_impurity(all_g, all_h) - _impurity(lg, lh) - _impurity(all_g - lg, all_h - lh)) / np.maximum(all_h, 1 / UNIT)
        return np.where((below >= settings.least_rows) & (every - below >= settings.least_rows) & (gain > 1e-12), gain, 0.0)

    kept = (drawn > 0)[data.entry_row]
    return _grown_in_task(data, drawn, g, h, kept, allowed, gains, lambda a, b: a / b if b else 0.0, settings.depth)


def grow(data: Counted, settings: Settings | ForestSettings) -> tuple[list[PackedTree], np.ndarray]:
    """Trees fitted within the task, and the margins of all rows; a forest's are mean shares of class 1."""
    margin, trees = np.zeros(len(data.bins)), []
    for round_ in range(settings.rounds):
        tree, at = _forest_tree(data, round_, settings) if isinstance(settings, ForestSettings) else _boosted(data, margin, round_, settings)
        margin += tree.weight[at] / (settings.rounds if isinstance(settings, ForestSettings) else 1)
        trees.append(tree)
    return trees, margin


def area(margin: np.ndarray, label: np.ndarray, copies: np.ndarray) -> float:
    """Area under the ROC curve of counted rows; ties count half, one class alone gives one half."""
    _, place = np.unique(margin, return_inverse=True)
    good, bad = (np.bincount(place, copies * hit) for hit in (label == 1, label != 1))
    if not good.sum() or not bad.sum():
        return 0.5
    return float((good * (np.cumsum(bad) - bad / 2)).sum() / (good.sum() * bad.sum()))


def _value_edges(counted: DataFrame, bins: int) -> list[np.ndarray]:
    """`fit_edges` of rows (v, n) that are few: exact quantiles by running totals over each feature's values."""
    known = F.coalesce(F.nanvl("x", F.lit(float("-inf"))), F.lit(float("-inf")))
    values = counted.select(F.posexplode("v").alias("feature", "x"), "n").withColumn("x", known).groupBy("feature", "x").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("feature")
    upto = F.sum("n").over(every.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = values.select("feature", "x", "n", upto.alias("upto"), F.sum("n").over(every).alias("all"), F.min("x").over(every).alias("low"))
    share = [F.floor(c * bins / F.col("all")) for c in (F.col("upto"), F.col("upto") - F.col("n"))]
    cuts = placed.where((F.col("upto") == F.col("all")) | (F.least(share[0], F.lit(bins - 1)) > share[1]))
    rows = cuts.groupBy("feature").agg(F.sort_array(F.collect_set(F.when(F.col("x") > F.col("low"), F.col("x")))).alias("cuts")).collect()  # a bounded list per feature
    found = {r.feature: np.array(r.cuts, float) for r in rows}
    return [found[i] for i in range(len(found))]


def _to_bins(edges: list[np.ndarray]):
    """Batches of rows with `v` as rows with `bins`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("v")
                bins = binned(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), edges)
                yield batch.set_column(batch.schema.get_field_index("v"), "bins", pa.array([b.tobytes() for b in bins], pa.binary()))

    return work


def count_equal(rows: DataFrame, held: DataFrame | None, bins: int) -> Counted | None:
    """Rows (features, label, weight), and held-out ones, as counts of different rows, or None if too many differ for a task.

    A sketch of the different rows decides first, so rows are not moved in vain.
    """
    parts = rows.select("features", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    if held is not None:
        parts = parts.unionByName(held.select("features", F.col("label").cast("double").alias("label"), F.lit(-1.0).alias("weight")))
    width = parts.select(F.size(vector_to_array("features"))).first()[0]
    sketch = parts.agg(F.approx_count_distinct(F.xxhash64("features", "label", "weight"))).first()[0]
    if sketch * width > TASK_CELLS:
        return None
    known = parts.groupBy("features", "label", "weight").agg(F.count("*").alias("n"))
    counted = stage(known.select(vector_to_array("features").alias("v"), "label", "weight", "n"), "counted")
    if counted.count() * width > 1.5 * TASK_CELLS:
        return None
    edges = _value_edges(counted.where("weight >= 0"), bins)
    same = counted.mapInArrow(_to_bins(edges), "bins binary, label double, weight double, n long").groupBy("bins", "label", "weight").agg(F.sum("n").alias("n"))
    found = same.toArrow()  # bounded by TASK_CELLS
    stored, (label, weight, n) = _matrix(found.column("bins"), np.uint8), (found.column(c).to_numpy() for c in ("label", "weight", "n"))
    # Held-out rows last, else in an order that doesn't depend on tasks.
    order = np.lexsort((*stored.T[::-1], label, -weight))
    return Counted(edges, stored[order], label[order], weight[order], n[order])


def spark_forest(settings: ForestSettings) -> RandomForestClassifier:
    """Spark's forest of these settings, for rows too many of which differ."""
    columns = str(settings.columns) if settings.columns else "sqrt"
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=settings.rounds, maxDepth=settings.depth, seed=settings.seed)
    return forest.setMinInstancesPerNode(settings.least_rows).setMaxBins(settings.bins).setFeatureSubsetStrategy(columns).setBootstrap(settings.bootstrap)


def areas(rows: DataFrame, held: DataFrame, candidates: list[Settings | ForestSettings], parallelism: int = 4) -> list[float]:
    """Area under the ROC curve over `held` of trees fitted on `rows` with each of the settings."""
    spark = rows.sparkSession
    data = count_equal(rows, held, candidates[0].bins) if len({c.bins for c in candidates}) == 1 else None
    if data is None:
        numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")

        def score(settings: Settings | ForestSettings) -> float:
            judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
            if isinstance(settings, ForestSettings):
                return judge.evaluate(spark_forest(settings).fit(rows).transform(held))
            return judge.setRawPredictionCol("probability").evaluate(train(numbered, ["_row"], settings).score(held))

        with ThreadPool(min(parallelism, len(candidates))) as pool:
            return pool.map(inheritable_thread_target(spark)(score), candidates)
    shared = spark.sparkContext.broadcast((data.edges, data.bins, data.label, data.weight, data.copies))
    # Long fits begin first.
    longest = sorted(range(len(candidates)), key=lambda i: -candidates[i].rounds * (candidates[i].depth + 2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in (longest[at] for at in batch.column(0).to_pylist()):
                mine = Counted(*shared.value)
                margin = grow(mine, candidates[i])[1][mine.train :]
                found = area(margin, mine.label[mine.train :], mine.copies[mine.train :])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([found])], names=["candidate", "area"])

    scored = spark.range(0, len(candidates), 1, len(candidates)).mapInArrow(work, "candidate long, area double").collect()
    shared.destroy()
    found = {r.candidate: r.area for r in scored}
    return [found[i] for i in range(len(candidates))]


def fit(rows: DataFrame, settings: Settings | ForestSettings, names: list[str] | None = None):
    """Trees fitted on (features, label, weight), within one task where few enough rows differ; else a forest is Spark's model."""
    spark, forest = rows.sparkSession, isinstance(settings, ForestSettings)
    data = count_equal(rows, None, settings.bins)
    if data is None and forest:
        return spark_forest(settings).fit(rows)
    if data is None:
        return train(stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered"), ["_row"], settings, names)
    shared = spark.sparkContext.broadcast((data.edges, data.bins, data.label, data.weight, data.copies))
    columns = ["feature", "cut", "left", "gain", "weight"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                for number, tree in enumerate(grow(Counted(*shared.value), settings)[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(tree.cut)), *[pa.array(getattr(tree, c)) for c in columns]], names=["tree", *columns])

    shape = "tree long, feature long, cut long, left long, gain double, weight double"
    nodes = spark.range(0, 1, 1, 1).mapInArrow(work, shape).toArrow()
    shared.destroy()
    number, *values = (nodes.column(c).to_numpy() for c in ["tree", *columns])
    ends = np.searchsorted(number, np.arange(settings.rounds + 1))
    trees = [PackedTree(*(v[a:b] for v in values)) for a, b in zip(ends, ends[1:])]
    return NewtonModel(data.edges, trees, names or [str(i) for i in range(len(data.edges))], forest)
