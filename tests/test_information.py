import math
import random

import pytest

from wardlog.operators import information as info
from wardlog.operators import ranking


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain(rows, k=3):
    """Row by row: sorted distances within the class, then a count over all rows."""
    classes = {}
    for y, x in rows:
        classes.setdefault(y, []).append(x)
    points = [(y, x) for y, x in rows if len(classes[y]) > 1]
    total = 0.0
    for y, x in points:
        own = classes[y]
        kk = min(k, len(own) - 1)
        d, v = sorted((abs(o - x), o) for o in own)[kk]
        high, low = (v if v > x else x + d), (v if v < x else x - d)
        m = sum(o == x for _, o in points) if d == 0 else sum(low < o < high for _, o in points)
        total += psi(kk) - psi(len(own)) - psi(m)
    return round(max(0.0, psi(len(points)) + total / len(points)), 6) if points else None


def cases():
    rng = random.Random(3)
    shifted = [(i % 2, rng.gauss(i % 2 * 2.0, 1.0)) for i in range(400)]
    return {
        "shifted normals": shifted,
        "independent": [(rng.randrange(3), rng.random()) for _ in range(300)],
        "ties": [(rng.randrange(2), float(rng.randrange(12))) for _ in range(300)],
        "hot value": [(i % 2, 5.0 if i % 3 else rng.random() * 10) for i in range(300)],
        "constant": [(i % 2, 1.5) for i in range(40)],
        "small classes": [(0, float(i)) for i in range(30)] + [(1, 3.5), (1, 8.0), (2, 4.0), (3, -7.0), (3, -7.0), (3, 90.0)],
        "wide": [(i % 2, rng.choice((-1, 1)) * 10 ** rng.uniform(-20, 20)) for i in range(200)],
    }


@pytest.mark.parametrize("block, k", [(info.BLOCK, 3), (7, 3), (7, 1)])
@pytest.mark.parametrize("name", list(cases()))
def test_equals_row_by_row(spark, monkeypatch, name, block, k):
    monkeypatch.setattr(info, "BLOCK", block)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 40)
    rows = cases()[name]
    df = spark.createDataFrame(rows, "y int, x double").repartition(3)
    got = info.neighbour_information(df, "y", ["x"], k).collect()
    assert [(r.feature, r.mi_score) for r in got] == [("x", pytest.approx(plain(rows, k), abs=2e-6))]


def test_several_columns_and_missing_values(spark):
    rng = random.Random(4)
    rows = [("ab"[i % 2], None if i % 7 == 0 else float(i % 2 * 50 + rng.random()), math.nan if i % 5 == 0 else rng.random(), i % 4) for i in range(200)]
    rows += [(None, 1.0, 1.0, 1), ("a", math.inf, -math.inf, None)]
    df = spark.createDataFrame(rows, "class string, value double, feature double, n int")

    def usable(at, fill):
        pairs = [(r[0], r[at]) for r in rows if r[0] is not None]
        clean = [(y, float(v) if v is not None and math.isfinite(v) else fill) for y, v in pairs]
        return [(y, v) for y, v in clean if v is not None]

    for fill in (0.0, None):
        got = {r.feature: r.mi_score for r in info.neighbour_information(df, "class", ["value", "feature", "n"], missing=fill).collect()}
        assert got == {c: pytest.approx(plain(usable(i, fill)), abs=2e-6) for i, c in enumerate(["value", "feature", "n"], 1)}


def test_no_usable_rows(spark):
    empty = spark.createDataFrame([], "y int, x double")
    single = spark.createDataFrame([(1, 1.0), (2, 2.0)], "y int, x double")
    for df in (empty, single):
        assert info.neighbour_information(df, "y", ["x"]).collect() == []
    with pytest.raises(ValueError):
        info.neighbour_information(single, "y", ["x"], 0)


def test_digamma(spark):
    got = spark.range(1, 60).select(info.digamma(info.F.col("id")).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(psi(n), abs=1e-10) for n in range(1, 60)]
