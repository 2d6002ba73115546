import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlog.operators import rollups as ru
from wardlog.operators.reports import attack_window_counts
from wardlog.sources.datasets import write_batch

SCHEMA = "id long, detected_at timestamp, attack_type string, attacker_ip string"


def made(rng, n, days=45):
    start = datetime(2026, 3, 1)
    times = (start + timedelta(seconds=rng.randrange(days * 86400)) for _ in range(n))
    return [(i, None if i % 50 == 3 else t, rng.choice(("SQLi", "XSS", "", None)), f"10.0.0.{rng.randrange(40)}") for i, t in enumerate(times)]


def refresh(spark, base, again=()):
    return ru.refresh(spark, f"{base}/store", f"{base}/rolled", "detected_at", "attack_type", ("attacker_ip",), again)


def counts(spark, base, as_of=None):
    return ru.window_counts(spark, f"{base}/store", f"{base}/rolled", "detected_at", as_of).first()


def test_late_rows_and_batches_written_again(spark, tmp_path):
    rng, stored = random.Random(2), {}
    for n in (0, 1, 2, 1):
        stored[n] = made(rng, 300)
        write_batch(spark.createDataFrame(stored[n], SCHEMA), f"{tmp_path}/store", n, "detected_at")
        assert refresh(spark, tmp_path, (n,)) == [n]
        every = spark.createDataFrame([r for rows in stored.values() for r in rows], SCHEMA)
        for as_of in (None, "2026-04-02 13:14:15", "2026-03-31 00:00:00", "2030-01-01 00:00:00"):
            full = attack_window_counts(every, F.lit(as_of).cast("timestamp") if as_of else None).first()
            assert counts(spark, tmp_path, as_of) == full
    assert refresh(spark, tmp_path) == []
    got = ru.distinct_values(spark, f"{tmp_path}/rolled", ["attacker_ip"]).first().attacker_ip
    assert got == every.select("attacker_ip").distinct().count()
    days = {r.event_date: r.attacker_ip for r in ru.distinct_values(spark, f"{tmp_path}/rolled", ["attacker_ip"], ["event_date"]).collect()}
    day = F.coalesce(F.to_date("detected_at"), F.lit("1970-01-01").cast("date")).alias("day")
    assert days == {r.day: r.n for r in every.groupBy(day).agg(F.countDistinct("attacker_ip").alias("n")).collect()}


def test_estimates_keep_their_bound(spark, tmp_path):
    for n in range(3):
        ids = spark.range(n * 20_000, n * 20_000 + 40_000).select("id", F.lit(datetime(2026, 1, 1 + n)).alias("detected_at"), F.lit("XSS").alias("attack_type"), F.col("id").cast("string").alias("attacker_ip"))
        write_batch(ids, f"{tmp_path}/store", n, "detected_at")
    assert refresh(spark, tmp_path) == [0, 1, 2]
    estimate = ru.distinct_values(spark, f"{tmp_path}/rolled", ["attacker_ip"]).first().attacker_ip
    assert estimate == pytest.approx(80_000, rel=3 * 1.04 / 2 ** (ru.SKETCH_BITS / 2))


def test_rows_without_a_time(spark, tmp_path):
    write_batch(spark.createDataFrame([(1, None, None, None)], SCHEMA), f"{tmp_path}/store", 0, "detected_at")
    refresh(spark, tmp_path)
    assert tuple(counts(spark, tmp_path)) == (1, 0, 0, 0)
    row = ru.rolled_status(spark, f"{tmp_path}/rolled", f"{tmp_path}/rolled", f"{tmp_path}/store", "detected_at").first()
    assert tuple(row) == (1, 1, "N/A", 0, 0, 0)
