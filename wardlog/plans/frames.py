"""Frames shared by the registered queries, all derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators.attack import attack_type_of_event
from wardlog.operators.flatten import audit_features
from wardlog.plans.driver_log import audit_log, demo_probability
from wardlog.session import stage


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with flags, and `event_id`, `ts`, `user_id`, `tx`."""
    return audit_features(audit_log(spark, sf_dir))


def decided_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with attack type and a decision from the stand-in probability."""
    rows = feature_rows(spark, sf_dir).withColumn("attack_type", attack_type_of_event(F.col("tx.messages"))).drop("tx")
    hit = S.override_hit(F.col("has_cve_2023_47271_upload"), F.col("has_cve_2023_47271_rce"))
    raw = demo_probability()
    # The threshold comes first: a filter on the decision then searches signatures only in rows below it.
    prediction = F.when(S.apply_threshold(raw) == 1, F.lit(1)).when(hit, F.lit(1)).otherwise(S.apply_threshold(raw))
    return rows.withColumn("probability", S.override_probability(raw, hit)).withColumn("prediction", prediction)


_ATTACKS: dict[tuple[str, str], DataFrame] = {}


def attack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack table, stored once per application as the history reports find it.

    Columns: id, detected_at, attack_type, probability, attack_url, attacker_ip.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ATTACKS:
        rows = decided_rows(spark, sf_dir).where("prediction = 1").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("detected_at"),
            "attack_type",
            "probability",
            F.col("uri").alias("attack_url"),
            F.col("source_ip").alias("attacker_ip"),
        )
        _ATTACKS[key] = stage(rows, "attacks")
    return _ATTACKS[key]
