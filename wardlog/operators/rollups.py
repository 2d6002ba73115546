"""Daily partial counts of a batch store, kept beside it, from which status figures are merged without scanning its rows.

A store is written in batches, each split by `event_date` (`write_batch`). Every batch gets partials of its own: per day the rows,
the newest time and sketches of distinct values (`days`), and the rows per kind (`kinds`). Partials of several batches add up, so
late rows of an old day only add the partials of their batch, and a batch that is written again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators.reports import most_frequent
from wardlog.session import numbered_folders

#: Logarithm of a sketch's cells: a relative standard error of 1.04 / sqrt(2^14) = 0.8 %; up to about 1,500 values are kept exactly.
SKETCH_BITS = 14


def refresh(
    spark: SparkSession, store: str, path: str, ts: str, kind: str | None = None, distinct: tuple[str, ...] = (), again: tuple[int, ...] = ()
) -> list[int]:
    """Builds partials for batches that have none and for those in `again` (written anew); returns their numbers.

    Batches that are gone from the store lose nothing here. Only the named columns of these batches are read.
    """
    known = numbered_folders(spark, f"{path}/kinds")  # written after the days
    todo = sorted(n for n in numbered_folders(spark, store) if n not in known or n in again)
    for n in todo:
        rows = spark.read.parquet(f"{store}/batch_id={n}")
        sketches = [F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(f"sketch_{c}") for c in distinct]
        days = rows.groupBy("event_date").agg(
            F.count("*").alias("n"), F.count(ts).alias("timed"), F.max(F.col(ts).cast("timestamp")).alias("last"), *sketches
        )
        days.coalesce(1).write.mode("overwrite").parquet(f"{path}/days/batch_id={n}")
        name = F.col(kind) if kind else F.lit(None)
        kinds = rows.groupBy("event_date", name.cast("string").alias("kind")).agg(F.count("*").alias("n"))
        kinds.write.mode("overwrite").parquet(f"{path}/kinds/batch_id={n}")
    return todo


def total_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches, as `n`."""
    return spark.read.parquet(f"{path}/days").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def window_counts(spark: SparkSession, store: str, path: str, ts: str, as_of: str | None = None) -> DataFrame:
    """As `attack_window_counts`: all rows, and those of today, the last 7 and the last 30 days before `as_of`.

    Whole days come from the partials. The two days in which the 7 and 30 day windows begin are counted by their rows;
    the day is a partition of the store, so only their files are read. `as_of` (UTC text) defaults to the newest time.
    """
    days = spark.read.parquet(f"{path}/days")
    now = F.lit(as_of).cast("timestamp") if as_of else F.col("last")
    starts = {"today": F.date_trunc("day", now), "week": now - F.expr("INTERVAL 7 DAYS"), "month": now - F.expr("INTERVAL 30 DAYS")}
    # Times travel as text in the session's zone, so the driver's own zone plays no part.
    found = days.agg(F.max("last").alias("last")).select(*[c.cast("string").alias(k) for k, c in starts.items()]).first()
    if found.week is None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("attacks_today", "attacks_last_7_days", "attacks_last_30_days")]
        return total_rows(spark, path).select(F.col("n").alias("total_attacks"), *zero)
    at = {k: F.lit(found[k]).cast("timestamp") for k in starts}
    first_day = {k: F.lit(found[k][:10]).cast("date") for k in starts}
    day = F.col("event_date")
    rows = spark.read.parquet(store).where(day.isin(first_day["week"], first_day["month"]))
    part = rows.agg(*[F.count_if((day == first_day[k]) & (F.col(ts).cast("timestamp") >= at[k])).alias(k) for k in ("week", "month")])

    def whole(inside):
        return F.coalesce(F.sum(F.when(inside, F.col("timed"))), F.lit(0))

    sums = days.agg(
        F.sum("n").alias("total_attacks"),
        whole(day >= first_day["today"]).alias("attacks_today"),
        *[whole(day > first_day[k]).alias(k) for k in ("week", "month")],
    )
    return sums.select(
        "total_attacks",
        "attacks_today",
        (F.col("week") + part.select("week").scalar()).alias("attacks_last_7_days"),
        (F.col("month") + part.select("month").scalar()).alias("attacks_last_30_days"),
    )


def rolled_status(spark: SparkSession, events: str, attacks: str, store: str, ts: str, as_of: str | None = None) -> DataFrame:
    """As `status_metrics`, from the partials of the event store, those of the attack store, and the attack store's border days."""
    kind = most_frequent(spark.read.parquet(f"{attacks}/kinds").groupBy("kind").agg(F.sum("n").alias("n")), "kind", "n")
    return window_counts(spark, store, attacks, ts, as_of).select(
        total_rows(spark, events).scalar().alias("overall_logs"),
        F.col("total_attacks").alias("attack_logs"),
        F.coalesce(kind.select("kind").scalar(), F.lit("N/A")).alias("most_attack_type"),
        "attacks_today",
        F.col("attacks_last_7_days").alias("attacks_last_week"),
        F.col("attacks_last_30_days").alias("attacks_last_month"),
    )


def distinct_values(spark: SparkSession, path: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Estimated distinct values of each column from the merged sketches, in all or per group of `by` (such as `event_date`)."""
    days = spark.read.parquet(f"{path}/days")
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(c) for c in columns]
    return days.groupBy(*(by or [])).agg(*merged)
