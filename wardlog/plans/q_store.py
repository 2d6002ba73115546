"""Queries: roll-ups of stores; the event store with predictions, links and feedback arriving as changes, and the export that learns from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators import rollups as ru
from wardlog.operators.labels import training_export
from wardlog.plans.flat_sql import FLAGS, TYPED_CTE
from wardlog.plans.frames import decided_rows
from wardlog.plans.q_attacks import CLICKS, LINKS, attack_links, clicks
from wardlog.plans.registry import query
from wardlog.session import scratch_path, stage
from wardlog.sources import change_store as cs
from wardlog.sources.datasets import write_attack_store, write_event_store

LABELLED = f"""{TYPED_CTE}, {LINKS}, {CLICKS},
labelled AS (SELECT d.*, l.attack_event_id, (c.action = 'attack_no') IS TRUE AS cleared, c.clicked_at
  FROM decided d LEFT JOIN links l USING (event_id) LEFT JOIN last_click c ON c.attack_event_id = l.attack_event_id)"""


def labelled_store(spark: SparkSession, sf_dir: str) -> str:
    """Path of a store filled as in use: events in two batches, decisions and links later, feedback last.

    It is compacted once, when some links have arrived before their events and some decisions only after them.
    """
    path = scratch_path(spark, "change-store")
    decided = stage(decided_rows(spark, sf_dir), "decided")
    early = F.col("event_id") % 3 != 0
    blank = decided.withColumns({"prediction": F.lit(None).cast("int"), "probability": F.lit(None).cast("double")})
    at = F.col("ts").cast("timestamp")
    links = attack_links(spark, sf_dir).join(decided.select("event_id", "ts"), "event_id")
    cs.append_events(blank.where(early), path, 0)
    cs.append_changes(cs.link_changes(links, at), path, 1)
    wrong = decided.where(early).withColumn("prediction", 1 - F.col("prediction"))
    cs.append_changes(cs.prediction_changes(wrong, at), path, 2)
    cs.compact(spark, path, 2)
    cs.append_events(blank.where(~early), path, 3)
    cs.append_changes(cs.prediction_changes(decided, F.timestamp_add("MINUTE", F.lit(1), at)), path, 4)
    cs.append_changes(cs.feedback_changes(cs.read_events(spark, path), clicks(spark, sf_dir)), path, 5)
    return path


@query(
    "merge_on_read",
    f"""WITH {LABELLED} SELECT event_id, date_trunc('second', ts) AS timestamp, nullif(uri, '') AS uri, status, rule_count,
    attack_event_id::VARCHAR AS attack_event_id, prediction AS model_prediction, round(final_probability, 5)::DOUBLE AS model_probability,
    CASE WHEN cleared THEN 0 END::INT AS human_label, CASE WHEN cleared THEN 'telegram' END AS label_source,
    CASE WHEN cleared THEN clicked_at END AS labeled_at FROM labelled""",
)
def merge_on_read_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the store shows them once a compaction and later changes are merged."""
    stored = cs.read_events(spark, labelled_store(spark, sf_dir))
    return stored.select(
        "event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "uri", "status", "rule_count", "attack_event_id",
        "model_prediction", F.col("model_probability").cast("double").alias("model_probability"), "human_label", "label_source",
        F.col("labeled_at").cast("timestamp_ntz").alias("labeled_at"),
    )


@query(
    "feedback_export",
    f"""WITH {LABELLED} SELECT event_id AS id, strftime(date_trunc('second', ts), '%a %b %-d %H:%M:%S %Y') AS timestamp, source_ip, method, uri, status,
    bytes_sent, request_time, user_agent, user_agent_len, uri_len, severity, severity_score, rule_id, matched_data, msg,
    is_blocked::INT AS is_blocked, rule_count, {FLAGS}, CASE WHEN cleared THEN 0 ELSE (rule_count > 0)::INT END::INT AS label FROM labelled""",
)
def feedback_export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows straight from the store: the label is the feedback's, else that of the rules."""
    stored = cs.read_events(spark, labelled_store(spark, sf_dir))
    return training_export(stored.withColumnRenamed("event_id", "id"))


def rolled_stores(spark: SparkSession, sf_dir: str) -> str:
    """Path of an event and an attack store with roll-ups refreshed after each batch of attacks; the last batch has late rows of all
    days, and batch 1 is first written short, then anew."""
    path = scratch_path(spark, "rolled")
    decided = stage(decided_rows(spark, sf_dir), "decided")
    late = F.col("event_id") % 5 == 0
    batches = [(0, ~late & (F.col("ts") < "2024-01-16")), (1, ~late & (F.col("ts") >= "2024-01-20")), (1, ~late & (F.col("ts") >= "2024-01-16")), (2, late)]
    write_event_store(decided, f"{path}/events")
    ru.refresh(spark, f"{path}/events", f"{path}/event-days", "timestamp")
    for n, rows in batches:
        write_attack_store(decided.where(rows), f"{path}/attacks", n)
        ru.refresh(spark, f"{path}/attacks", f"{path}/attack-days", "detected_at", "attack_type", ("attacker_ip", "attack_url"), again=(n,))
    return path


@query(
    "rolled_status",
    f"""WITH {TYPED_CTE}, a AS (SELECT *, date_trunc('second', detected_at) AS second FROM attacks), m AS (SELECT max(second) AS now FROM a)
    SELECT (SELECT count(*) FROM events) AS overall_logs, count(*) AS attack_logs,
      (SELECT attack_type FROM attacks GROUP BY 1 ORDER BY count(*) DESC, attack_type LIMIT 1) AS most_attack_type,
      count(*) FILTER (second >= date_trunc('day', now)) AS attacks_today, count(*) FILTER (second >= now - INTERVAL 7 DAY) AS attacks_last_week,
      count(*) FILTER (second >= now - INTERVAL 30 DAY) AS attacks_last_month FROM a, m""",
)
def rolled_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rolled_stores(spark, sf_dir)
    return ru.rolled_status(spark, f"{path}/event-days", f"{path}/attack-days", f"{path}/attacks", "detected_at")


@query(
    "rolled_distinct",
    f"""WITH {TYPED_CTE} SELECT detected_at::DATE AS event_date, count(DISTINCT attacker_ip) AS attacker_ip, count(DISTINCT attack_url) AS attack_url
    FROM attacks GROUP BY 1""",
)
def rolled_distinct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct attackers and addresses per day from merged sketches; days of few values are exact."""
    path = rolled_stores(spark, sf_dir)
    return ru.distinct_values(spark, f"{path}/attack-days", ["attacker_ip", "attack_url"], ["event_date"])
