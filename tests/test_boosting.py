"""Second-order boosted trees, split by split against a plain version."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlog.operators import boosting as bo


def plain_trees(x, label, weight, key, edges, s):
    """Trees of (feature, cut, gain, weight) per heap node, by loops over nodes, features and bins."""
    bins, margin, trees = bo.binned(x, edges), np.zeros(len(x)), []
    for r in range(s.rounds):
        g, h = bo.derivatives(margin, label, weight)
        used, columns, tree = bo._drawn(key, r, s), bo.drawn_columns(len(edges), r, s), {}
        node = np.zeros(len(x), int)

        def shrunk(v):
            return np.sign(v) * max(abs(v) - s.l1, 0.0)

        def grow(at, depth):
            here = (node == at) & used
            G, H = g[here].sum() / bo.UNIT, h[here].sum() / bo.UNIT
            weight_ = -s.rate * shrunk(G) / (H + s.l2)
            best = None
            for f in columns if depth < s.depth else []:
                for b in range(1, len(edges[f]) + 1):
                    low = here & (bins[:, f] < b)
                    if not low.any() or not (here & (bins[:, f] == b)).any():
                        continue
                    a, c = g[low].sum() / bo.UNIT, h[low].sum() / bo.UNIT
                    gain = 0.5 * (shrunk(a) ** 2 / (c + s.l2) + shrunk(G - a) ** 2 / (H - c + s.l2) - shrunk(G) ** 2 / (H + s.l2)) - s.gamma
                    if c >= s.least_weight and H - c >= s.least_weight and gain > 0 and (best is None or gain > best[2] + 1e-12):
                        best = (f, b, gain)
            tree[at] = (*(best or (-1, 0, 0.0)), weight_)
            if best:
                every = node == at
                node[every] = 2 * at + 1 + (bins[every, best[0]] >= best[1])
                if (here & (node == 2 * at + 1)).any():
                    grow(2 * at + 1, depth + 1)
                if (here & (node == 2 * at + 2)).any():
                    grow(2 * at + 2, depth + 1)

        grow(0, 0)
        margin = margin + np.array([tree[n][3] if n in tree else 0.0 for n in node])
        trees.append(tree)
    return trees, margin


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n), np.zeros(n), rng.exponential(size=n)]).astype(float)
    x[rng.random(n) < 0.1, 4] = np.nan
    label = ((x[:, 0] + x[:, 1] + rng.normal(scale=0.5, size=n)) > 0.5).astype(float)
    weight = np.where(rng.random(n) < 0.1, 10.0, 1.0)
    rows = [(i, Vectors.dense(v.tolist()), int(y), float(w)) for i, (v, y, w) in enumerate(zip(x, label, weight))]
    return x, label, weight, spark.createDataFrame(rows, ["id", "features", "label", "weight"])


@pytest.mark.parametrize(
    "settings",
    [
        bo.Settings(rounds=3, depth=3, rate=0.3, rows=1, columns=1, bins=8),
        bo.Settings(rounds=3, depth=2, rate=0.3, l1=2.5, l2=4.0, gamma=0.7, least_weight=3.0, rows=0.7, columns=0.6, bins=16, seed=5),
    ],
)
def test_every_split_equals_the_plain_version(spark, sample, settings, monkeypatch):
    monkeypatch.setattr(bo, "STAGE_ROUNDS", 2)
    x, label, weight, rows = sample
    model = bo.train(rows, ["id"], settings)
    key = np.array([r[0] for r in rows.selectExpr("xxhash64(id)", "id").orderBy("id").collect()])
    want, margin = plain_trees(x, label, weight, key, model.edges, settings)
    assert len(model.trees) == settings.rounds and any(t[0][0] >= 0 for t in want)
    for tree, plain in zip(model.trees, want):
        for node, (feature, cut, gain, leaf) in plain.items():
            assert (tree.feature[node], tree.cut[node]) == (feature, cut)
            assert tree.gain[node] == pytest.approx(gain, abs=1e-9) and tree.weight[node] == pytest.approx(leaf, abs=1e-12)
    got = {r.id: r.probability for r in model.score(rows.repartition(3)).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-9) for i, m in enumerate(margin))


def test_layout_does_not_change_the_trees(spark, sample):
    settings = bo.Settings(rounds=2, depth=3, rate=0.3, bins=16)
    one, two = (bo.train(sample[3].repartition(n), ["id"], settings).splits(spark).collect() for n in (1, 5))
    assert one == two and any(r.feature for r in one)


def test_penalties_shrink(spark, sample):
    def total(**kw):
        return sum(abs(r.weight) for r in bo.train(sample[3], ["id"], bo.Settings(rounds=1, depth=2, rate=1.0, bins=8, **kw)).splits(spark).where("feature IS NULL").collect())

    assert total(l1=1e9) == 0 and 0 < total(l2=1000.0) < total()
    assert bo.train(sample[3], ["id"], bo.Settings(rounds=1, depth=2, gamma=1e9)).splits(spark).count() == 1


@pytest.mark.parametrize(
    ("at_once", "settings"),
    [
        (2_000_000, bo.Settings(rounds=3, depth=4, rate=0.3, rows=1, columns=0.6, bins=8)),
        (30, bo.Settings(rounds=4, depth=5, rate=0.2, l1=0.5, l2=3.0, gamma=0.2, least_weight=2.0, rows=1, columns=1, bins=16)),
    ],
)
def test_trees_of_one_task_equal_those_of_the_table(spark, sample, settings, at_once, monkeypatch):
    monkeypatch.setattr(bo, "SUMMED_CELLS", at_once)
    rows = sample[3].drop("id")
    rows = rows.union(rows.where("label = 1")).union(rows.where("weight > 1"))  # equal rows count each
    packed = bo.fit(rows, settings)
    monkeypatch.setattr(bo, "TASK_CELLS", 0)
    table = bo.fit(rows, settings)
    assert isinstance(packed.trees[0], bo.PackedTree) and isinstance(table.trees[0], bo.Tree)
    assert [e.tolist() for e in packed.edges] == [e.tolist() for e in table.edges]
    for small, tree in zip(packed.trees, table.trees, strict=True):
        reached, heap = [0], {0: 0}
        for node in reached:
            place = heap[node]
            assert (small.feature[node], small.cut[node] if small.feature[node] >= 0 else 0) == (tree.feature[place], tree.cut[place])
            assert small.gain[node] == pytest.approx(tree.gain[place], abs=1e-12) and small.weight[node] == pytest.approx(tree.weight[place], abs=1e-12)
            if small.feature[node] >= 0:
                for side in (0, 1):
                    heap[int(small.left[node]) + side] = 2 * place + 1 + side
                    reached.append(int(small.left[node]) + side)
        assert len(reached) == len(small.feature)
    assert any(len(t.feature) > 3 for t in packed.trees)


def test_areas_are_equal_in_a_task_and_over_the_table(spark, sample, monkeypatch):
    train, held = sample[3].where("id % 4 > 0").drop("id"), sample[3].where("id % 4 = 0").drop("id")
    settings = [bo.Settings(rounds=2, depth=2, rate=0.3, rows=1, columns=1, bins=16), bo.Settings(rounds=3, depth=3, rate=0.3, rows=1, columns=0.7, bins=16), bo.Settings(rounds=1, depth=2, gamma=1e9, bins=16)]
    one = bo.areas(train, held, settings)
    monkeypatch.setattr(bo, "TASK_CELLS", 0)
    assert bo.areas(train, held, settings) == pytest.approx(one, abs=1e-9)
    assert one[0] > 0.8 and one[2] == 0.5


def test_area_of_counted_rows():
    margin, label, copies = np.array([0.1, 0.4, 0.4, 0.9, 0.2]), np.array([0, 1, 0, 1, 1]), np.array([3, 1, 2, 2, 5])
    pairs = [(p, n) for p, y, c in zip(margin, label, copies) if y for _ in range(c) for n, z, d in zip(margin, label, copies) if not z for _ in range(d)]
    assert bo.area(margin, label, copies) == pytest.approx(sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs))
    assert bo.area(margin, np.ones(5), copies) == 0.5


def test_copies_are_drawn_by_the_share():
    data = bo.Counted([np.array([1.0])], np.array([[0], [1]], np.uint8), np.array([0.0, 1.0]), np.array([1.0, 1.0]), np.array([1000, 1000]))
    trees, _ = bo.grow(data, bo.Settings(rounds=40, depth=1, rate=0.0, l2=0.0, rows=0.6, columns=1))
    gains = np.array([t.gain[0] for t in trees])  # at margin 0 both sides together gain the half of the drawn copies
    assert len(set(gains)) > 20 and abs(gains.mean() * 2 / 2000 - 0.6) < 0.01


def test_sums_beyond_float_range_are_exact():
    big = np.array([2**55 + 1, -(2**54) - 3, 7], np.int64)
    assert bo._sums(np.array([0, 0, 1]), big, 2, False).tolist() == [2**55 - 2**54 - 2, 7]


def plain_gini(bins, edges, label, weight, copies, s):
    """One tree of (feature, cut, share of class 1) per heap node, all copies and features used."""
    tree = {}

    def impurity(here):
        p = (weight * copies * label)[here].sum() / (weight * copies)[here].sum()
        return 2 * p * (1 - p) * (weight * copies)[here].sum()

    def grow(at, here, depth):
        best = None
        for f in range(len(edges)) if depth < s.depth else []:
            for b in range(1, len(edges[f]) + 1):
                low, high = here & (bins[:, f] < b), here & (bins[:, f] >= b)
                if (here & (bins[:, f] == b)).any() and copies[low].sum() >= max(1, s.least_rows) and copies[high].sum() >= s.least_rows:
                    gain = (impurity(here) - impurity(low) - impurity(high)) / (weight * copies)[here].sum()
                    if gain > 1e-12 and (best is None or gain > best[2] + 1e-12):
                        best = (f, b, gain)
        tree[at] = (*(best[:2] if best else (-1, 0)), (weight * copies * label)[here].sum() / (weight * copies)[here].sum())
        if best:
            for side, part in enumerate((bins[:, best[0]] < best[1], bins[:, best[0]] >= best[1])):
                grow(2 * at + 1 + side, here & part, depth + 1)

    grow(0, np.ones(len(bins), bool), 0)
    return tree


@pytest.mark.parametrize("least", [1, 9])
def test_a_forest_tree_equals_the_plain_version(sample, least):
    x, label, weight, _ = sample
    x = x[:, [0, 1, 2, 4]]
    edges = [np.quantile(x[~np.isnan(x[:, i]), i], [0.2, 0.4, 0.6, 0.8]) for i in range(4)]
    edges = [np.unique(e[e > np.nanmin(x[:, i])]) for i, e in enumerate(edges)]
    bins, copies = bo.binned(x, edges), np.arange(len(x)) % 3 + 1
    settings = bo.ForestSettings(rounds=1, depth=4, least_rows=least, bootstrap=False, columns=4)
    (tree,), margin = bo.grow(bo.Counted(edges, bins, label, weight, copies), settings)
    want, heap = plain_gini(bins, edges, label, weight, copies, settings), {0: 0}
    for node in range(len(tree.feature)):
        feature, cut, share = want[heap[node]]
        assert (tree.feature[node], tree.cut[node] if feature >= 0 else 0) == (feature, cut) and tree.weight[node] == pytest.approx(share)
        for side in (0, 1) if feature >= 0 else ():
            heap[int(tree.left[node]) + side] = 2 * heap[node] + 1 + side
    assert len(tree.feature) == len(want) > 8 and margin == pytest.approx(tree.weight[tree.nodes(bins)])


def test_a_forest_judges_like_sparks(spark, sample, monkeypatch):
    known = sample[3].where(~F.exists(vector_to_array("features"), F.isnan))  # Spark's forest takes no missing values
    train, held = known.where("id % 4 > 0").drop("id"), known.where("id % 4 = 0").drop("id")
    settings = [bo.ForestSettings(rounds=60, depth=8, least_rows=3)]
    model = bo.fit(train, settings[0])
    scored = model.score(held).select("probability").collect()
    assert all(0 <= r.probability <= 1 for r in scored) and len({r.probability for r in scored}) > 20
    (one,) = bo.areas(train, held, settings)
    monkeypatch.setattr(bo, "TASK_CELLS", 0)
    (other,) = bo.areas(train, held, settings)
    assert one > 0.8 and abs(one - other) < 0.04


def test_bootstrap_and_drawn_features():
    copies = np.array([500, 500])
    data = bo.Counted([np.array([1.0])] * 9, np.array([[0] * 9, [1] * 9], np.uint8), np.array([0.0, 1.0]), np.array([1.0, 1.0]), copies)
    shares, features = [], set()
    for number in range(60):
        tree, _ = bo._forest_tree(data, number, bo.ForestSettings(depth=1))
        shares.append(tree.weight[0])
        features.add(int(tree.feature[0]))
    assert abs(np.mean(shares) - 0.5) < 0.01 and 0.005 < np.std(shares) < 0.03
    assert len(features) > 4  # the first of three drawn at a node
