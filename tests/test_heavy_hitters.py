import random
from collections import Counter

import pytest

from wardlog.operators import heavy_hitters as hh


def plain(values, k):
    ordered = sorted(Counter(values).items(), key=lambda v: (-v[1], v[0] is not None, v[0] or 0))
    return ordered[:k]


def cases():
    rng = random.Random(8)
    zipf = [int(1 / (rng.random() + 1e-4)) for _ in range(4000)]
    return {
        "skewed": zipf + [None] * 700,
        "flat": [i % 900 for i in range(3600)],
        "one hot value among unique ones": [7] * 1500 + list(range(1000, 4000)),
        "ties at the border": [v for v in range(300) for _ in range(5 if v % 3 else 9)],
        "few values": [1, 1, 2, None],
        "distinct": list(range(500)),
    }


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("buckets", [hh.BUCKETS, 32])
def test_equals_full_grouping(spark, name, buckets):
    values = cases()[name]
    rows = spark.createDataFrame([(v, "x") for v in values], "v long, other string").repartition(5)
    for k in (1, 20):
        assert [tuple(r) for r in hh.heavy_hitters(rows, "v", k, buckets).collect()] == plain(values, k)


def test_no_rows(spark):
    assert hh.heavy_hitters(spark.createDataFrame([], "v string"), "v", 3).collect() == []


def test_skewed_data_counts_few_buckets(spark, monkeypatch):
    """The certificate holds after the first buckets on skewed data; flat data goes on to all that reach the border."""
    asked = []
    counted = hh._counted
    monkeypatch.setattr(hh, "_counted", lambda rows, column, chosen, of, buckets: asked.append((len(chosen), of)) or counted(rows, column, chosen, of, buckets))
    rng = random.Random(9)
    skewed = [f"u{i}" for i in range(10) for _ in range(200 + i)] + [f"rare{rng.randrange(9000)}" for _ in range(6000)]
    hh.heavy_hitters(spark.createDataFrame([(v,) for v in skewed], "v string"), "v", 10).collect()
    assert len(asked) == 1 and asked[0][0] == 10 * hh.FIRST_PER_VALUE < asked[0][1] / 50
    asked.clear()
    flat = [(i % 500,) for i in range(2000)]
    hh.heavy_hitters(spark.createDataFrame(flat, "v long"), "v", 10).collect()
    assert [n for n, _ in asked] == [40, asked[0][1]]


def test_bounds_are_upper_bounds(spark):
    rows = spark.createDataFrame([(i % 40,) for i in range(1000)], "v int")
    totals = hh.bucket_totals(rows, "v", 8)
    assert sum(n for _, n in totals) == 1000 and len(totals) <= 8
    assert totals[0][1] >= 25
    with pytest.raises(ValueError):
        hh.heavy_hitters(rows, "v", 0)
