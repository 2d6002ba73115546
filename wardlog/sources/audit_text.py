"""Sectioned text audit logs: blocks between `--hash-A--` and `--hash-Z--` markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.functions import patterns as P
from wardlog.functions import scalars as S

BLOCK_END = "-Z--\n"
BLOCK_START = r"(?=--[a-f0-9]+-A--\n)"


def section(block: Column, letter: str) -> Column:
    """Body of a section: from its marker to the next marker with the hash of the block, '' when absent.

    The end marker has lost its letter to the record separator.
    """
    before = "" if letter == "A" else r"A--\n.*?(?<=\n)--\1-"
    return F.regexp_extract(block, rf"(?s)\A--([a-f0-9]+)-{before}{letter}--\n(.*?)(?=(?<=\n)--\1(?:-[A-Z]--|\z)|\z)", 2)


def header_value(body: Column, name: str) -> Column:
    """Value of a header in a section, '' when absent; a later line of the same name wins."""
    lines = F.filter(
        F.split(body, "\n"), lambda line: line.contains(":") & (F.trim(F.split_part(line, F.lit(":"), F.lit(1))) == name)
    )
    return S.or_empty(F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), r"(?s)^[^:]*:", "")))


def parse_audit_blocks(chunks: DataFrame, value: str = "value", parity: bool = False) -> DataFrame:
    """Text chunks holding whole blocks to event rows. Other columns pass through.

    `parity=True` blanks time and source address, which the text path never had.
    """
    passed = [c for c in chunks.columns if c != value]
    blocks = chunks.select(*passed, F.explode(F.split(F.col(value), BLOCK_START)).alias("_block")).where(
        F.col("_block").rlike(r"(?s)\A--([a-f0-9]+)-A--\n(?:.*\n)?--\1(?:-[BFHZ]--|\z)")
    )
    parts = blocks.select(*passed, *[section(F.col("_block"), s).alias(f"_{s}") for s in "ABFH"])
    head = F.split(F.trim(F.split_part(F.ltrim(F.col("_B")), F.lit("\n"), F.lit(1))), r"\s+")
    fields = F.split(F.trim(F.regexp_replace("_A", r"^\s*\[[^\]]*\]", "")), r"\s+")
    status_text = F.try_element_at(F.split(F.trim(F.split_part(F.ltrim(F.col("_F")), F.lit("\n"), F.lit(1))), r"\s+"), F.lit(2))
    rows = parts.select(
        *passed,
        (F.lit("") if parity else F.regexp_extract("_A", r"\[([^\]]+)\]", 1)).alias("timestamp"),
        (F.lit("0.0.0.0") if parity else F.coalesce(S.blank_to_null(F.try_element_at(fields, F.lit(2))), F.lit("0.0.0.0"))).alias("source_ip"),
        F.when(F.size(head) >= 3, head[0]).otherwise(F.lit("GET")).alias("method"),
        F.when(F.size(head) >= 3, F.try_element_at(head, F.lit(2))).otherwise(F.lit("/")).alias("uri"),
        F.when(status_text.rlike(r"^[+-]?\d+$"), F.coalesce(status_text.try_cast("int"), F.lit(200))).otherwise(F.lit(200)).alias("status"),
        F.lit(0).cast("bigint").alias("bytes_sent"),
        F.lit(0.0).alias("request_time"),
        header_value(F.col("_B"), "User-Agent").alias("user_agent"),
        F.regexp_extract("_H", r'\[severity\s+"([^"]+)"\]', 1).alias("severity"),
        F.regexp_extract("_H", r'\[id\s+"?(\d+)"?\]', 1).alias("rule_id"),
        F.regexp_extract("_H", r'Matched\s+(?:phrase|data)\s+"([^"]+)"', 1).alias("matched_data"),
        F.regexp_extract("_H", r'\[msg\s+"([^"]+)"\]', 1).alias("msg"),
        F.col("_H").contains("Action: Intercepted").alias("is_blocked"),
    )
    full = F.concat_ws(" ", "uri", "msg", "matched_data")
    return rows.withColumn("_full", full).select(
        *rows.columns,
        F.length("user_agent").alias("user_agent_len"),
        F.length("uri").alias("uri_len"),
        S.severity_from_name(F.col("severity")).alias("severity_score"),
        P.has_sqli(F.col("_full")).alias("has_sqli"),
        P.has_xss(F.col("_full")).alias("has_xss"),
        P.has_suspicious_path(F.col("uri")).alias("has_suspicious_path"),
        P.has_path_traversal(F.col("uri")).alias("has_path_traversal"),
        P.has_command_injection(F.col("uri")).alias("has_command_injection"),
        F.col("is_blocked").cast("int").alias("label"),
    )


def read_audit_text(spark: SparkSession, path: str | list[str], parity: bool = False) -> DataFrame:
    """Event rows of sectioned text logs. Blocks are the records, so large files stay splittable."""
    return parse_audit_blocks(spark.read.option("lineSep", BLOCK_END).text(path), parity=parity)


def read_audit_text_dir(spark: SparkSession, raw_dir: str, file_name: str = "modsec_audit.anon.log", parity: bool = False) -> DataFrame:
    """All logs of that name in the date folders of a directory; unreadable files are skipped."""
    reader = spark.read.option("lineSep", BLOCK_END).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return parse_audit_blocks(reader.text(f"{raw_dir.rstrip('/')}/*/{file_name}"), parity=parity)
