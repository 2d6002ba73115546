"""Dataset readers and sinks."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.functions import scalars as S
from wardlog.operators.flatten import audit_features
from wardlog.operators.labels import prepare_labeled_csv, source_date, union_sources
from wardlog.operators.reports import scoring_summary
from wardlog.sources.audit_json import good_transactions
from wardlog.sources.schemas import EVENT_COLUMNS, INT_COLUMNS, LABELED_CSV, TEXT_COLUMNS

# Globs of raw log files to take and to leave out.
INCLUDE_PATTERNS = ["audit.log", "audit.json", "*.json", "*/audit.log", "*/audit.json", "*/modsec_audit.json"]
EXCLUDE_PATTERNS = ["*.bak", ".tmp", ".DS_Store"]
LOG_SUFFIXES = ["jsonl", "log", "json"]


def glob_regex(pattern: str) -> str:
    """A path glob as a regex on a whole relative path; `*` stays inside a folder."""
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)


def source_filter(
    path: Column, include: list[str] | None = None, exclude: list[str] | None = None
) -> Column:
    """Predicate on a path relative to the raw folder: some include glob, no exclude glob.

    An exclude glob is tested on the file name.
    """
    wanted = "^(?:" + "|".join(glob_regex(p) for p in (include or INCLUDE_PATTERNS)) + ")$"
    unwanted = "(?:^|/)(?:" + "|".join(glob_regex(p) for p in (exclude or EXCLUDE_PATTERNS)) + ")$"
    return path.rlike(wanted) & ~path.rlike(unwanted)


def any_case(*suffixes: str) -> str:
    """A file glob of suffixes in upper or lower case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def first_lines(lines: DataFrame) -> dict[str, str]:
    """First line that is not blank of each file of a text reader, by path. One row per file reaches the driver."""
    heads = (
        lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
        .groupBy("path")
        .agg(F.min_by("value", "at").alias("head"))
    )
    return {unquote(r.path): r.head for r in heads.collect()}


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV to training columns; columns are found by their names in each file."""
    return prepare_labeled_csv(read_csv(spark, path, LABELED_CSV, defaults={"method": "GET"}))


def escaped_breaks(text: Column) -> Column:
    """Text on one line: backslashes doubled, line breaks as backslash and letter."""
    for found, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(found), F.lit(written))
    return text


def restored_breaks(text: Column) -> Column:
    """Undoes `escaped_breaks`."""
    between = F.transform(
        F.split(text, r"\\\\"), lambda t: F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    )
    return F.array_join(between, "\\")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    recursive: bool = False,
    breaks: bool = False,
    defaults: dict[str, str] | None = None,
    dated: bool = False,
) -> DataFrame:
    """CSV files with a header, one record per line, quotes doubled inside quotes.

    Columns are bound by the names in each file's header, so files may order them differently; a column that a file lacks
    is NULL or its default. Without a schema all columns are text. `breaks` undoes the escapes of `write_dataset`;
    `dated` adds `source_date` from the path.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case("csv"))
    files: dict[str, list[str]] = {}
    for file, head in first_lines(reader.text(path)).items():
        files.setdefault(head, []).append(file)
    fields = T.DataType.fromDDL(schema).fields if schema else None
    types = {f.name: f.dataType for f in fields or []}
    frames = []
    for head, paths in sorted(files.items()):
        names = next(csv.reader([head.lstrip("\ufeff")]))
        own = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        rows = spark.read.schema(own).option("header", True).option("escape", '"').csv(paths)
        texts = [f.name for f in own if f.dataType == T.StringType()]
        if breaks:
            rows = rows.withColumns({n: restored_breaks(F.col(n)) for n in texts})
        wanted = [f.name for f in fields] if fields else names
        columns = [F.col(n) if n in names else F.lit((defaults or {}).get(n)).cast(types[n]).alias(n) for n in wanted]
        frames.append(rows.select(*columns, *([source_date(F.col("_metadata.file_path")).alias("source_date")] if dated else [])))
    if not frames:
        return spark.createDataFrame([], T.StructType([*(fields or []), *([T.StructField("source_date", T.StringType())] if dated else [])]))
    return union_sources(*frames)


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()


def read_log_files(spark: SparkSession, path: str, recursive: bool = False, dated: bool = False) -> DataFrame:
    """Event rows of JSON log files: objects on lines, or one array or one object over several lines.

    A file that begins with an array, or with a line that only opens an object, is read as one record; all others stay
    splittable.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(*LOG_SUFFIXES))
    heads = first_lines(reader.text(path))
    whole = sorted(f for f, head in heads.items() if head.strip().startswith("[") or head.strip() == "{")
    lines = sorted(set(heads) - set(whole))
    date = [source_date(F.col("_metadata.file_path")).alias("source_date")] if dated else []
    frames = []
    if whole:
        listed = F.from_json("value", "array<string>")
        records = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), listed).otherwise(F.array("value"))
        frames.append(spark.read.text(whole, wholetext=True).select(F.explode(records).alias("value"), *date))
    if lines or not frames:
        frames.append(spark.read.text(lines).select("value", *date) if lines else reader.text(path).where(F.lit(False)).select("value", *date))
    return audit_features(good_transactions(union_sources(*frames))).drop("tx")


def read_dataset(spark: SparkSession, path: str, csv_schema: str | None = None) -> DataFrame:
    """One CSV or JSON log file, or a whole folder of them by recursion, as event rows.

    Suffixes count in any case. Folder rows get `source_date` from their path. CSV files are those of `write_dataset`.
    """
    suffix = _suffix(path)
    if suffix == "csv":
        return read_csv(spark, path, csv_schema, breaks=True)
    if suffix in LOG_SUFFIXES:
        return read_log_files(spark, path)
    if "." in path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"unsupported dataset format: {suffix}")
    events = read_log_files(spark, path, recursive=True, dated=True)
    tables = read_csv(spark, path, csv_schema, recursive=True, breaks=True, dated=True)
    return union_sources(events, tables) if tables.columns != ["source_date"] else events


def event_store_rows(events: DataFrame) -> DataFrame:
    """Typed event-store columns of scored events: text or NULL, int or 0, probability decimal(6,5)."""
    small = [c for c in INT_COLUMNS if c != "bytes_sent"]
    return events.select(
        "event_id",
        F.when(F.col("prediction") == 1, attack_id("event_id")).alias("attack_event_id"),
        S.parse_event_time(F.col("timestamp")).alias("timestamp"),
        *[S.text_or_null(F.col(c)).alias(c) for c in TEXT_COLUMNS],
        *[S.int_or_zero(F.col(c)).cast("int").alias(c) for c in small],
        S.int_or_zero(F.col("bytes_sent")).alias("bytes_sent"),
        S.float_or_zero(F.col("request_time")).alias("request_time"),
        S.int_or_zero(F.col("is_blocked").cast("int")).cast("int").alias("is_blocked"),
        S.prediction_or_null(F.col("prediction")).alias("model_prediction"),
        S.probability_or_null(F.col("probability")).alias("model_probability"),
    )


def attack_id(*key: str) -> Column:
    """Surrogate key of an attack, the same however often the event is processed."""
    return F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in key]), 256)


def attack_store_rows(events: DataFrame) -> DataFrame:
    """Attack rows of scored events that were decided as attacks; times stay UTC."""
    return events.where(F.col("prediction") == 1).select(
        attack_id("event_id").alias("id"),
        "event_id",
        S.parse_event_time(F.col("timestamp")).alias("detected_at"),
        "attack_type",
        "probability",
        F.col("uri").alias("attack_url"),
        F.col("source_ip").alias("attacker_ip"),
    )


def write_batch(rows: DataFrame, path: str, batch_id: int, ts: str) -> None:
    """Write one batch below its own folder, partitioned by day; writing it again replaces it."""
    dated = rows.withColumn("event_date", F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date")))
    dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}")


def write_event_store(events: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(event_store_rows(events), path, batch_id, "timestamp")


def write_attack_store(events: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(attack_store_rows(events), path, batch_id, "detected_at")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a store, all batches."""
    return spark.read.parquet(path).drop("batch_id", "event_date")


def _one_line_texts(rows: DataFrame) -> DataFrame:
    texts = [n for n, kind in rows.dtypes if kind == "string"]
    return rows.withColumns({n: escaped_breaks(F.col(n)) for n in texts}) if texts else rows


def write_predictions(scored: DataFrame, path: str) -> DataFrame:
    """Scored rows as CSV, line breaks escaped; returns their summary."""
    _one_line_texts(scored).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return scoring_summary(scored)


def write_dataset(events: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with header in the fixed column order; line breaks in texts are escaped, so files stay splittable."""
    ordered = _one_line_texts(events.select(*(columns or EVENT_COLUMNS)))
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
