"""Structured Streaming: scoring, alert cool-down, period counts and the pause gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlog.operators.attack import attack_type_of_event
from wardlog.operators.cooldown import GAP_SECONDS, UNBLOCKED, kept_positions
from wardlog.operators.flatten import audit_features, normalize_transaction
from wardlog.operators.joins import notification_gate
from wardlog.operators.learning import score_batch
from wardlog.operators.reports import period_counts
from wardlog.session import stage
from wardlog.sources.audit_json import good_transactions
from wardlog.sources.datasets import attack_store_rows, event_store_rows, write_batch


#: Files of a micro-batch at most; a key's share of them is what the state operator holds.
MAX_FILES = 256


def stream_audit_log(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """New log lines below a folder into which the log is rotated; `max_files` bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def live_events(lines: DataFrame) -> DataFrame:
    """Live path of a line: tolerant parse, canonical record, flat row with flags."""
    return audit_features(normalize_transaction(good_transactions(lines)))


def score_events(events: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Adds probability, prediction, decision and attack type to live events."""
    typed = events.withColumn("attack_type", attack_type_of_event(F.col("tx.messages")))
    return score_batch(model, typed.drop("tx"), threshold)


def stream_score(
    lines: DataFrame, model: PipelineModel, event_path: str, attack_path: str, checkpoint: str, threshold: float = 0.5
) -> DataStreamWriter:
    """Scores a stream and writes events and attacks per micro-batch; a repeated batch replaces itself.

    Lines without an `event_id` get the text `batch:position`, so equal lines stay separate events and no two ids agree.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if "event_id" not in batch.columns:
            position = F.monotonically_increasing_id().cast("string")
            batch = batch.withColumn("event_id", F.concat(F.lit(f"{batch_id}:"), position))
        scored = stage(score_events(live_events(batch), model, threshold), "scored")
        write_batch(event_store_rows(scored), event_path, batch_id, "timestamp")
        write_batch(attack_store_rows(scored), attack_path, batch_id, "detected_at")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_alert_cooldown(
    alerts: DataFrame, ts: str = "ts", event_id: str = "event_id", key: str | None = "source_ip",
    gap_seconds: int = GAP_SECONDS, delay: str = "10 minutes",
) -> DataFrame:
    """Cool-down with state per key: the instant until which alerts are held back.

    Only key, time and id enter the state operator. Within a micro-batch rows are ordered by time;
    across micro-batches time must not run backwards. State leaves once the watermark is past it.
    """
    gap = gap_seconds * 1_000_000
    slim = alerts.select(
        (F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")).alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(event_id).cast("bigint").alias("event_id"),
    ).where("ts IS NOT NULL").withWatermark("ts", delay)

    def hold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Two numbers per row are all that a key's micro-batch holds; its frames go one by one.
        parts = [(b["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), b["event_id"].to_numpy()) for b in batches]
        times, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        blocked = state.get[0] if state.exists else int(UNBLOCKED)
        kept = kept_positions(times, gap, blocked)
        if kept:
            blocked = int(times[kept[-1]]) + gap
            state.update((blocked,))
        if state.exists:
            state.setTimeoutTimestamp(max(blocked // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({"key": group[0], "ts": pd.to_datetime(times[kept], unit="us"), "event_id": ids[kept]})

    return slim.groupBy("key").applyInPandasWithState(
        hold,
        "key string, ts timestamp, event_id bigint",
        "blocked bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_period_summary(events: DataFrame, ts: str = "ts", period: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per closed period; rows later than the watermark are not counted."""
    return period_counts(events.withWatermark(ts, delay), ts, period)


def stream_notification_gate(
    alerts: DataFrame, read_state: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """Passes alerts to a sink unless paused; the flag is read again for every micro-batch."""

    def gate(batch: DataFrame, batch_id: int) -> None:
        sink(notification_gate(batch, read_state()), batch_id)

    return alerts.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint)
