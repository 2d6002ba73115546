"""Event store whose rows are changed after they were written: rows, changes and compacted versions, merged on reading.

Below the store's path:

* `rows/batch_id=N`: events as they arrived;
* `changes/batch_id=N`: narrow rows (event_id, changed_at, changed columns) of predictions, attack links and labels;
* `base/version=V`: all rows up to a batch number, each with its last changes and when they were made;
* `waiting/version=V`: changes up to this number whose event has not arrived yet;
* `versions/version=V`: one row that names the number. It is written last, so a version counts only when it is whole.

Nothing is updated in place. Writing a batch again replaces its folder, and a compaction leaves older versions and
batches as they are, so readers that began before it go on. `vacuum` removes them later.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators.joins import dedup_latest_feedback
from wardlog.session import exists, numbered_folders, remove, scratch, stage
from wardlog.sources.datasets import event_store_rows

KEY = "event_id"
#: Columns that may change, with their types.
CHANGEABLE = {
    "attack_event_id": "string",
    "model_prediction": "int",
    "model_probability": "decimal(6,5)",
    "human_label": "int",
    "label_source": "string",
    "labeled_at": "timestamp",
}
LABEL = ["human_label", "label_source", "labeled_at"]
#: What changes as one: each single column, and a label with its source and time.
STATES = {**{c: [c] for c in CHANGEABLE if c not in LABEL}, "label": LABEL}
#: Fixed values of the label's source.
LABEL_SOURCES = ("telegram", "manual", "weak_auto")


def latest_version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Newest whole version of the store and the last batch merged into it; (-1, -1) before any compaction."""
    if not exists(spark, f"{path}/versions"):
        return -1, -1
    listed = spark.read.schema("upto BIGINT, version INT").parquet(f"{path}/versions")
    newest = listed.agg(F.max(F.struct("version", "upto")).alias("v")).first().v
    return (newest.version, newest.upto) if newest else (-1, -1)


def _write_batch(rows: DataFrame, path: str, kind: str, batch_id: int) -> None:
    spark = rows.sparkSession
    if batch_id <= latest_version(spark, path)[1]:
        raise ValueError(f"batch {batch_id} was compacted already; use a higher number")
    rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch_id={batch_id}")


def append_events(events: DataFrame, path: str, batch_id: int) -> None:
    """Writes scored events as store rows, without labels; `created_at` is the time of writing.

    Events without an id are kept, but no change reaches them.
    """
    rows = event_store_rows(events)
    fresh = [F.lit(None).cast(kind).alias(c) for c, kind in CHANGEABLE.items() if c not in rows.columns]
    _write_batch(rows.select("*", *fresh, F.current_timestamp().alias("created_at")), path, "rows", batch_id)


def append_changes(changes: DataFrame, path: str, batch_id: int) -> None:
    """Writes changes: `event_id`, `changed_at` and any of the changeable columns, in which NULL means unchanged.

    Other columns are left out. Changes may come before their event. Rows without an id or a time are refused. A label's
    source and time count only together with `human_label`.
    """
    given = [c for c in CHANGEABLE if c in changes.columns]
    if not given:
        raise ValueError(f"changes need one of {sorted(CHANGEABLE)}")
    if "label_source" in given:
        known = F.col("label_source").isNull() | F.col("label_source").isin(*LABEL_SOURCES)
        changes = changes.withColumn("label_source", F.when(known, F.col("label_source")).otherwise(F.raise_error("unknown label source")))
    checked = [
        F.when(F.col(c).isNotNull(), F.col(c).cast(kind)).otherwise(F.raise_error(f"change without {c}")).alias(c)
        for c, kind in ((KEY, changes.schema[KEY].dataType), ("changed_at", "timestamp"))
    ]
    columns = [(F.col(c) if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in CHANGEABLE.items()]
    _write_batch(changes.select(*checked, *columns), path, "changes", batch_id)


def prediction_changes(scored: DataFrame, at: Column) -> DataFrame:
    """Changes that record the model's decision: `event_id`, `prediction`, `probability`."""
    return scored.select(KEY, at.alias("changed_at"), F.col("prediction").alias("model_prediction"), F.col("probability").alias("model_probability"))


def link_changes(attacks: DataFrame, at: Column) -> DataFrame:
    """Changes that link events to their attacks: `event_id`, `attack_event_id`."""
    return attacks.select(KEY, at.alias("changed_at"), "attack_event_id")


def feedback_changes(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Changes from clicks on attack alerts: a last answer other than "yes" labels the attack's events 0.

    `events` names each event's attack (`event_id`, `attack_event_id`), as `read_events` does.
    """
    last = dedup_latest_feedback(feedback).where(F.coalesce(F.col("action") != "attack_yes", F.lit(True)))
    linked = events.select(KEY, "attack_event_id").join(last.withColumn("attack_event_id", F.col("attack_event_id").cast("string")), "attack_event_id")
    return linked.select(
        KEY, F.col("clicked_at").alias("changed_at"), F.lit(0).alias("human_label"), F.lit("telegram").alias("label_source"),
        F.col("clicked_at").alias("labeled_at"),
    )


def _batches(spark: SparkSession, path: str, kind: str, after: int, upto: int | None) -> DataFrame | None:
    """Batches of a kind with a number above `after`, up to `upto`; the numbers prune folders."""
    if not exists(spark, f"{path}/{kind}"):
        return None
    wanted = F.col("batch_id") > after
    return spark.read.parquet(f"{path}/{kind}").where(wanted if upto is None else wanted & (F.col("batch_id") <= upto))


def _states(spark: SparkSession, path: str, version: int, after: int, upto: int | None) -> DataFrame | None:
    """One row per changed event: per state the last change, as a struct of time, batch and values, which orders it."""
    parts = []
    changes = _batches(spark, path, "changes", after, upto)
    if changes is not None:
        order = [F.col("changed_at"), F.col("batch_id").cast("long").alias("batch_id")]
        parts.append(
            changes.select(KEY, *[F.when(F.col(c[0]).isNotNull(), F.struct(*order, *c)).alias(f"_{name}") for name, c in STATES.items()])
        )
    if version >= 0:
        parts.append(spark.read.parquet(f"{path}/waiting/version={version}"))
    if not parts:
        return None
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(KEY).agg(*[F.max(f"_{name}").alias(f"_{name}") for name in STATES])


def _rows(spark: SparkSession, path: str, version: int, after: int, upto: int | None) -> DataFrame:
    """Rows as they arrived, with the states that the version has merged."""
    parts = []
    fresh = _batches(spark, path, "rows", after, upto)
    if fresh is not None:
        parts.append(fresh.drop("batch_id"))
    if version >= 0:
        parts.append(spark.read.parquet(f"{path}/base/version={version}"))
    if not parts:
        raise ValueError(f"no event store at {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _with_states(rows: DataFrame, states: DataFrame | None) -> DataFrame:
    """Rows with the later of their own and the given state, per state; rows without any have NULL."""
    own = {f"_{name}" for name in STATES} & set(rows.columns)
    if states is None:
        return rows
    renamed = states.select(F.col(KEY).alias("_key"), *[F.col(f"_{name}").alias(f"_new_{name}") for name in STATES])
    joined = rows.join(renamed, F.col(KEY) == F.col("_key"), "left")
    later = [
        (F.greatest(f"_{name}", f"_new_{name}") if f"_{name}" in own else F.col(f"_new_{name}")).alias(f"_{name}") for name in STATES
    ]
    return joined.select(*[c for c in rows.columns if c not in own], *later)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the store as they stand now: the newest version and later rows, with later changes merged in.

    Per state the change with the latest time counts, then that of the highest batch, then the greatest value, whatever was
    compacted before. Changes are reduced to one narrow row per event before they meet the wide rows, so few changes
    are broadcast by adaptive execution and rows stay in place; with many, both sides are shuffled by event.
    """
    version, after = latest_version(spark, path)
    merged = _with_states(_rows(spark, path, version, after, None), _states(spark, path, version, after, None))
    values = {}
    for name, columns in STATES.items():
        if f"_{name}" in merged.columns:
            state = F.col(f"_{name}")
            values |= {c: F.when(state.isNotNull(), state[c]).otherwise(F.col(c)).alias(c) for c in columns}
    return merged.select(*[values.get(c, F.col(c)) for c in merged.columns if c[1:] not in STATES or c[0] != "_"])


def compact(spark: SparkSession, path: str, upto: int) -> int:
    """Merges all batches up to number `upto` into a new version and returns its number.

    Later batches must have higher numbers; lower ones are refused from then on. One writer compacts at a time.
    """
    version, after = latest_version(spark, path)
    if upto <= after:
        raise ValueError(f"batches up to {after} were compacted already")
    new = version + 1
    rows = _rows(spark, path, version, after, upto)
    states = _states(spark, path, version, after, upto)
    with scratch(spark):
        if states is None:
            nothing = [F.lit(None).cast(_state_type(name)).alias(f"_{name}") for name in STATES]
            states = rows.select(KEY, *nothing).where(F.lit(False))
        held = stage(states, "states")
        _with_states(rows, held).write.mode("overwrite").parquet(f"{path}/base/version={new}")
        held.join(rows.select(KEY), KEY, "left_anti").write.mode("overwrite").parquet(f"{path}/waiting/version={new}")
    done = spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={new}")
    return new


def _state_type(name: str) -> str:
    fields = {"changed_at": "timestamp", "batch_id": "bigint"} | {c: CHANGEABLE[c] for c in STATES[name]}
    return f"struct<{', '.join(f'{c}: {kind}' for c, kind in fields.items())}>"


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the newest `keep` versions and the batches that all of these have merged.

    Readers of a removed version fail, so keep those that may still be read.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    if not exists(spark, f"{path}/versions"):
        return
    listed = spark.read.schema("upto BIGINT, version INT").parquet(f"{path}/versions")
    kept = listed.orderBy(F.desc("version")).limit(keep).agg(F.min(F.struct("version", "upto")).alias("v")).first().v
    for kind, limit in (("versions", kept.version - 1), ("base", kept.version - 1), ("waiting", kept.version - 1), ("rows", kept.upto), ("changes", kept.upto)):
        for number, folder in numbered_folders(spark, f"{path}/{kind}").items():
            if number <= limit:
                remove(spark, folder)
