"""Dataset preparation, merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions import patterns as P
from wardlog.functions import scalars as S
from wardlog.operators.ranking import row_range
from wardlog.sources.schemas import BASE_COLUMNS, FLAG_COLUMNS, NUMERIC_FEATURES

EXPORT_DEFAULTS: dict[str, object] = {
    "source_ip": "0.0.0.0",
    "method": "GET",
    "uri": "/",
    "severity": "INFO",
    "request_time": 0.0,
    "user_agent": "",
    "rule_id": "",
    "matched_data": "",
    "msg": "",
}
REQUIRED_TRAINING = ["method", "uri", "status", "bytes_sent", "request_time", "user_agent_len", "uri_len", "label"]
LEGIT_UPLOAD = r"(?i)/uploadFile|/importexport"


def export_time(ts: Column) -> Column:
    """`Tue May 5 04:12:06 2026`: the day is not padded."""
    return F.date_format(ts, "EEE MMM d HH:mm:ss yyyy")


def training_export(events: DataFrame) -> DataFrame:
    """Event rows with every column filled; the label is the human one, else rule_count > 0."""
    label = F.coalesce(F.col("human_label"), (F.coalesce("rule_count", F.lit(0)) > 0).cast("int"))
    columns = [export_time(F.col("timestamp")).alias("timestamp")]
    for name in [*BASE_COLUMNS[1:], *FLAG_COLUMNS]:
        default = F.lit(EXPORT_DEFAULTS.get(name, 0)).cast(events.schema[name].dataType)
        columns.append(F.coalesce(F.col(name), default).alias(name))
    return events.select("id", *columns, label.cast("int").alias("label"))


def labeled_export(events: DataFrame) -> DataFrame:
    """Only rows a person has labelled."""
    kept = events.where(F.col("human_label").isNotNull())
    return kept.select("id", *BASE_COLUMNS, *FLAG_COLUMNS, F.col("human_label").alias("label"))


def export_first_n(events: DataFrame, n: int) -> DataFrame:
    """The n smallest ids: the limiting id is found first, then the rows are one filter."""
    return export_row_range(events, 1, _positive(n))


def export_last_n(events: DataFrame, n: int) -> DataFrame:
    """The n largest ids, found in the same way."""
    total = events.where(F.col("id").isNotNull()).count()
    return export_row_range(events, max(1, total - _positive(n) + 1), max(1, total))


def export_row_range(events: DataFrame, start_row: int, end_row: int) -> DataFrame:
    """Rows number start..end by id, inclusive, without sorting the table in one place."""
    return training_export(row_range(events, "id", start_row, end_row))


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError("row count must be >= 1")
    return n


def prepare_labeled_csv(df: DataFrame) -> DataFrame:
    """Labelled CSV rows to training columns: label from text, URI = normalised one, flags, defaults."""
    method = F.col("method").cast("string") if "method" in df.columns else F.lit("GET")
    return df.select(
        method.alias("method"),
        F.col("uri_norm").alias("uri"),
        F.col("status").cast("int").alias("status"),
        F.lit(0).alias("bytes_sent"),
        F.lit(0.0).alias("request_time"),
        F.lit(0).alias("rule_count"),
        S.anomaly_to_severity(F.col("anomaly_score")).alias("severity_score"),
        F.lit(0).alias("user_agent_len"),
        F.length("uri_norm").alias("uri_len"),
        P.has_sqli(F.col("uri_full")).alias("has_sqli_pattern"),
        P.has_xss(F.col("uri_full")).alias("has_xss_pattern"),
        P.has_suspicious_path(F.col("uri_norm")).alias("has_suspicious_path"),
        F.coalesce(F.col("label") == "malicious", F.lit(False)).cast("int").alias("label"),
    )


def attack_tags_split(df: DataFrame, column: str = "attack_tags") -> DataFrame:
    """Rows per tag combination and per tag."""
    present = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    combos = present.groupBy(F.col(column).alias("tag")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("combination"))
    tags = (
        combos.select(F.explode(F.split("tag", r"\|")).alias("tag"), "n")
        .groupBy("tag")
        .agg(F.sum("n").alias("n"))
        .withColumn("kind", F.lit("tag"))
    )
    return combos.select("kind", "tag", "n").unionByName(tags.select("kind", "tag", "n"))


def raw_text_flags(df: DataFrame) -> DataFrame:
    """Length and coarse keyword flags of the raw text path."""
    return df.withColumns(
        {
            "uri_len": F.length("uri"),
            "has_sqli": P.coarse_sqli(F.col("uri")),
            "has_xss": P.coarse_xss(F.col("uri")),
        }
    )


def harmonize_training_columns(df: DataFrame) -> DataFrame:
    """Names and columns the training pipeline expects; raises when a required one is absent."""
    for old, new in (("has_sqli", "has_sqli_pattern"), ("has_xss", "has_xss_pattern")):
        if old in df.columns:
            df = df.drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    absent = [c for c in REQUIRED_TRAINING if c not in df.columns]
    if absent:
        raise ValueError(f"dataset lacks columns: {sorted(absent)}")
    missing = {c: F.lit(0) for c in NUMERIC_FEATURES if c not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_scoring_row(df: DataFrame) -> DataFrame:
    """Like harmonising, but absent method and URI take defaults and no label is needed."""
    for old, new in (("has_sqli", "has_sqli_pattern"), ("has_xss", "has_xss_pattern")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = {c: F.lit(0) for c in NUMERIC_FEATURES if c not in df.columns}
    for name, default in (("method", "GET"), ("uri", "/")):
        if name not in df.columns:
            missing[name] = F.lit(default)
    return df.withColumns(missing) if missing else df


def legit_upload_rows(df: DataFrame) -> DataFrame:
    """Normal POST requests to the site's own upload pages."""
    return df.where((F.col("label") == 0) & (F.col("method") == "POST") & F.col("uri").rlike(LEGIT_UPLOAD))


def _aligned(df: DataFrame) -> DataFrame:
    """One time type and a boolean is_blocked, whatever the dump used."""
    columns = {}
    if "timestamp" in df.columns:
        columns["timestamp"] = S.parse_event_time(F.col("timestamp").cast("string"))
    if "is_blocked" in df.columns:
        columns["is_blocked"] = F.coalesce(F.col("is_blocked").cast("boolean"), F.lit(False))
    return df.withColumns(columns) if columns else df


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each different row once. Rows are grouped by a digest, so long texts are no part of the key."""
    digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(digest.alias("_digest")).agg(F.any_value(F.struct(*df.columns)).alias("_row")).select("_row.*")


def merge_datasets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old columns of both sets by name, full duplicates dropped.

    Columns are matched by name, so the label always comes from a column named label.
    """
    kept = _aligned(old)
    return distinct_rows(kept.unionByName(_aligned(new).select(*old.columns)))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenation by name; columns a source lacks are NULL."""
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame, allowMissingColumns=True)
    return total


DATE_NUMERIC = r"(\d{4}[-_]?\d{2}[-_]?\d{2})"
DATE_NAMED = r"(\d{1,2}-[A-Za-z]{3}-\d{4})"


def date_in_text(text: Column) -> Column:
    """First date in a name, '' when there is none; 8 digits and underscores become dashes."""
    found = F.regexp_extract(text, DATE_NUMERIC, 1)
    dashed = F.replace(found, F.lit("_"), F.lit("-"))
    plain = F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(found != "", plain).otherwise(F.regexp_extract(text, DATE_NAMED, 1))


def source_date(path: Column) -> Column:
    """Date of a file from its name, else from the nearest parent folder that has one, else ''.

    The random names of files written by Spark (part-00000-...) say nothing about dates.
    """
    nearest_first = F.reverse(F.split(F.regexp_replace(path, r"/part-\d+-[^/]*$", ""), "/"))
    dates = F.filter(F.transform(nearest_first, date_in_text), lambda d: d != "")
    return F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit(""))
