"""Attack history, period summaries and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators.attack import percent


def latest(df: DataFrame, column: str) -> Column:
    """The newest value as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def attack_window_counts(attacks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All attacks, and those of today, the last 7 and the last 30 days before `as_of`.

    `as_of` replaces the wall clock; it defaults to the newest attack.
    """
    now = latest(attacks, "detected_at") if as_of is None else as_of
    at = F.col("detected_at")
    return attacks.select("detected_at", now.alias("_now")).agg(
        F.count("*").alias("total_attacks"),
        F.count_if(at >= F.date_trunc("day", F.col("_now"))).alias("attacks_today"),
        F.count_if(at >= F.col("_now") - F.expr("INTERVAL 7 DAYS")).alias("attacks_last_7_days"),
        F.count_if(at >= F.col("_now") - F.expr("INTERVAL 30 DAYS")).alias("attacks_last_30_days"),
    )


def most_frequent(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """The most frequent non-empty value, ties by value. Rows may stand for `weight` equal ones."""
    return (
        df.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy(column)
        .agg((F.sum(weight) if weight else F.count("*")).alias("total"))
        .orderBy(F.desc("total"), F.asc(column))
        .limit(1)
    )


def top_attack_type(attacks: DataFrame) -> DataFrame:
    return most_frequent(attacks, "attack_type")


def top_attacker_ip(attacks: DataFrame) -> DataFrame:
    return most_frequent(attacks, "attacker_ip")


def recent_attacks(attacks: DataFrame, n: int = 5) -> DataFrame:
    """The newest attacks, ties by the higher id."""
    return (
        attacks.orderBy(F.desc("detected_at"), F.desc("id"))
        .limit(n)
        .select("id", "detected_at", "attack_type", "probability", "attack_url", "attacker_ip")
    )


def attack_history(attacks: DataFrame) -> DataFrame:
    """History as displayed: local time, percent, shortened URL."""
    return recent_attacks(attacks).select(
        "id",
        S.to_local_history(F.col("detected_at")).alias("detected_local"),
        F.coalesce("attack_type", F.lit("Unknown")).alias("attack_type"),
        S.format_probability(F.col("probability")).alias("probability"),
        S.truncate_text(F.coalesce("attack_url", F.lit("N/A"))).alias("attack_url"),
    )


def status_metrics(events: DataFrame, attacks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Log count and attack summary in one row; each part is a scalar subquery."""
    kind = top_attack_type(attacks).select("attack_type").scalar()
    return attack_window_counts(attacks, as_of).select(
        events.agg(F.count("*")).scalar().alias("overall_logs"),
        F.col("total_attacks").alias("attack_logs"),
        F.coalesce(kind, F.lit("N/A")).alias("most_attack_type"),
        "attacks_today",
        F.col("attacks_last_7_days").alias("attacks_last_week"),
        F.col("attacks_last_30_days").alias("attacks_last_month"),
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    """Counts and attack share of a scored batch."""
    return scored.agg(
        F.count("*").alias("total_logs"),
        F.count_if(F.col("prediction") == 0).alias("normal_count"),
        F.count_if(F.col("prediction") == 1).alias("attack_count"),
    ).withColumn("attack_percentage", percent(F.col("attack_count"), F.col("total_logs")))


def period_counts(df: DataFrame, ts: str = "ts", period: str = "1 hour") -> DataFrame:
    """Logs, attacks and rate per tumbling period. `df` has `attack_type`, NULL for normal rows."""
    counted = df.groupBy(F.window(ts, period).alias("w")).agg(
        F.count("*").alias("total_logs"), F.count("attack_type").alias("attack_count")
    )
    return counted.select(
        F.col("w.start").alias("period_start"),
        "total_logs",
        "attack_count",
        percent(F.col("attack_count"), F.col("total_logs")).alias("attack_rate"),
    )


def period_summary(df: DataFrame, ts: str = "ts", period: str = "1 hour", top: int = 5) -> DataFrame:
    """Period counts with the most frequent attack types, as one text.

    Rows are counted per (period, type) first, map-side; everything after works on those counts.
    """
    by_type = df.groupBy(F.window(ts, period)["start"].alias("period_start"), "attack_type").agg(F.count("*").alias("n"))
    best = Window.partitionBy("period_start").orderBy(F.col("attack_type").isNull(), F.desc("n"), F.asc("attack_type"))
    ranked = by_type.withColumn("place", F.row_number().over(best))
    listed = F.when(
        F.col("attack_type").isNotNull() & (F.col("place") <= top),
        F.struct("place", F.concat("attack_type", F.lit("="), F.col("n").cast("string")).alias("line")),
    )
    return (
        ranked.groupBy("period_start")
        .agg(
            F.sum("n").alias("total_logs"),
            F.sum(F.when(F.col("attack_type").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("attack_count"),
            F.array_sort(F.collect_list(listed)).alias("_top"),
        )
        .select(
            "period_start",
            "total_logs",
            "attack_count",
            percent(F.col("attack_count"), F.col("total_logs")).alias("attack_rate"),
            F.array_join(F.col("_top.line"), "; ").alias("top_attacks"),
        )
    )


def batch_max_severity(scored: DataFrame, batch: str, order: list[str], lines: int = 3) -> DataFrame:
    """Per batch: attacks, highest severity, first lines. The row_number filter prunes before the shuffle."""
    attacks = scored.where(F.col("prediction") == 1).withColumn("_band", S.severity_band(F.col("probability")))
    ordinal = F.when(F.col("_band") == "high", 3).when(F.col("_band") == "medium", 2).otherwise(1)
    totals = attacks.groupBy(batch).agg(F.count("*").alias("attack_count"), F.max_by("_band", ordinal).alias("severity"))
    line = F.concat("method", F.lit(" "), "uri", F.lit(" ("), F.upper("_band"), F.lit(")"))
    first = (
        attacks.withColumn("_place", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))
        .where(F.col("_place") <= lines)
        .groupBy(batch)
        .agg(F.array_sort(F.collect_list(F.struct("_place", line.alias("line")))).alias("_lines"))
    )
    return totals.join(first, batch).select(
        batch, "attack_count", "severity", F.array_join(F.col("_lines.line"), "\n").alias("top_lines")
    )
