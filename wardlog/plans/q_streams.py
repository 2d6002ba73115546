"""Queries: streams run over files derived from the driver tables, until all input is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardlog.operators.flatten import flatten_transaction
from wardlog.plans.driver_log import CLIENT_SQL, audit_lines
from wardlog.plans.flat_sql import FLAT_CTE, TYPED_CTE
from wardlog.plans.frames import decided_rows
from wardlog.plans.q_attacks import GATE_SQL, PAUSED_BY, attack_links, pause_state
from wardlog.plans.q_learning import shared_model
from wardlog.plans.registry import ORACLES, query, table
from wardlog.session import scratch_path
from wardlog.sources.audit_json import good_transactions
from wardlog.sources.datasets import read_store
from wardlog.streaming import streams as st

TIME_SLICES = (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01"))


def drain(writer: DataStreamWriter) -> None:
    """Process everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def to_parquet(df: DataFrame, out: str, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The derived log as text files, the way a rotated log lies in a folder."""
    path = scratch_path(spark, "log-folder")
    audit_lines(spark, sf_dir).select("value").write.text(path)
    return path


@query("stream_audit_log", f"WITH {FLAT_CTE} SELECT timestamp, source_ip, method, uri, status, rule_count, label FROM flat")
def stream_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream-log")
    lines = st.stream_audit_log(spark, log_folder(spark, sf_dir))
    events = flatten_transaction(good_transactions(lines)).select("timestamp", "source_ip", "method", "uri", "status", "rule_count", "label")
    drain(to_parquet(events, out))
    return spark.read.parquet(out)


@query(
    "stream_score",
    f"""WITH {FLAT_CTE} SELECT date_trunc('second', ts) AS timestamp, {CLIENT_SQL.replace("client_ip", "source_ip")} AS source_ip, method, uri, status, rule_count,
    true AS consistent FROM flat""",
)
def stream_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event store of a scored stream. `consistent`: decision, override and attack link agree."""
    base = scratch_path(spark, "stream-score")
    lines = st.stream_audit_log(spark, log_folder(spark, sf_dir))
    writer = st.stream_score(lines, shared_model(spark, sf_dir), f"{base}/events", f"{base}/attacks", f"{base}/checkpoint")
    drain(writer)
    events = read_store(spark, f"{base}/events")
    attacks = read_store(spark, f"{base}/attacks").select(F.col("id").alias("attack_event_id"), F.lit(True).alias("stored"))
    forced = (F.col("has_cve_2023_47271_upload") == 1) | (F.col("has_cve_2023_47271_rce") == 1)
    p, hit = F.col("model_probability"), F.col("model_prediction") == 1
    consistent = (
        (hit == F.coalesce("stored", F.lit(False)))
        & F.when(forced, hit & (p >= 0.99)).otherwise(F.when(p > 0.5, hit).when(p < 0.5, ~hit).otherwise(True))
    )
    joined = events.join(attacks, "attack_event_id", "left").withColumn("consistent", consistent)
    return joined.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(
        "timestamp", "source_ip", "method", "uri", "status", "rule_count", "consistent"
    )


@query("stream_alert_cooldown", ORACLES["alert_cooldown"])
def stream_cooldown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries in time order, the stream stopped and resumed between them."""
    base = scratch_path(spark, "stream-cooldown")
    timed = F.when(F.col("event_id") % 37 != 5, F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", timed.alias("ts"))
    for low, high in TIME_SLICES:
        events.where(F.col("ts").isNull() | (F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(f"{base}/in")
        alerts = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        drain(to_parquet(st.stream_alert_cooldown(alerts, key="user_id", gap_seconds=3600), f"{base}/out"))
    return spark.read.parquet(f"{base}/out").select("event_id", F.col("key").cast("bigint").alias("user_id"))


@query(
    "stream_period_summary",
    f"""WITH {TYPED_CTE} SELECT date_trunc('hour', ts) AS period_start, count(*) AS total_logs, count(*) FILTER (prediction = 1) AS attack_count,
    round(count(*) FILTER (prediction = 1) * 100.0::DOUBLE / count(*), 6)::DOUBLE AS attack_rate FROM decided
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1""",
)
def stream_period_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours only: the last open one stays in state."""
    base = scratch_path(spark, "stream-period")
    rows = decided_rows(spark, sf_dir).select("ts", F.when(F.col("prediction") == 1, F.col("attack_type")).alias("attack_type"))
    rows.write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    drain(to_parquet(st.stream_period_summary(source), f"{base}/out"))
    return spark.read.parquet(f"{base}/out").withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("stream_notification_gate", GATE_SQL)
def stream_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: the first meets a set flag, the second one that is not set."""
    base = scratch_path(spark, "stream-gate")
    links = attack_links(spark, sf_dir)
    alerts = links.drop("event_id")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    for half, nation in enumerate(PAUSED_BY):
        links.where(F.col("event_id") % 2 == half).drop("event_id").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(alerts.schema).parquet(f"{base}/in")
        flag = pause_state(spark, sf_dir, nation)
        drain(st.stream_notification_gate(source, lambda flag=flag: flag, sink, f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("attack_event_id", "probability")
