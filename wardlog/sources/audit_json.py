"""JSON audit logs: tolerant parsing to one `tx` struct per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.sources.schemas import MESSAGE, TX_FIELDS, transaction_schema

CORRUPT = "_corrupt_record"


def _unwrapped(record: Column, fields: list[str] | None = None) -> Column:
    """The wrapped transaction when there is one, else the record itself."""
    bare = F.struct(*[record[f].alias(f) for f in TX_FIELDS if fields is None or f in fields])
    return F.when(record["transaction"].isNotNull(), record["transaction"]).otherwise(bare)


def _loose_messages(document_text: Column) -> Column:
    """Messages of a line whose list also holds non-objects: those count but carry nothing."""
    loose = F.from_json(document_text, "transaction STRUCT<messages: ARRAY<STRING>>, messages ARRAY<STRING>")
    items = F.coalesce(loose["transaction"]["messages"], loose["messages"])
    return F.transform(items, lambda item: F.from_json(item, MESSAGE))


def parse_audit_lines(
    lines: DataFrame, value: str = "value", keep_errors: bool = True, fields: list[str] | None = None
) -> DataFrame:
    """One row per non-blank, non-comment line, with `tx` and `_parse_error`.

    Only the wanted `fields` of a transaction are made, by default all: the parser skips the others.

    A bad line keeps its row with a NULL `tx` so that it can be counted or quarantined;
    `keep_errors=False` drops it. A field of an unexpected type becomes NULL by itself and the rest
    of the line survives. Syntax checks and the loose message list run only for lines that raised
    such a mismatch. The result passes through a generator, so later filters cannot duplicate
    the parse below it.
    """
    schema = f"{transaction_schema(fields)}, {CORRUPT} STRING"
    record = F.from_json(F.col("_line"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    document = F.try_parse_json("_line")
    wrapped_other = (
        F.try_variant_get(document, "$.transaction", "variant").isNotNull() & F.col("_record.transaction").isNull()
    )
    mismatch = F.col(f"_record.{CORRUPT}").isNotNull()
    broken = F.coalesce(
        F.when(
            mismatch, document.isNull() | ~F.schema_of_variant(document).startswith("OBJECT") | wrapped_other
        ).otherwise(~F.col("_line").startswith("{")),
        F.lit(True),
    )
    tx = _unwrapped(F.col("_record"), fields)
    mended = F.col("_tx")
    if fields is None or "messages" in fields:
        loose = mismatch & F.col("_tx.messages").isNull()
        mended = F.when(loose, F.col("_tx").withField("messages", _loose_messages(F.col("_line")))).otherwise(mended)
    outcome = F.struct(F.when(~F.col("_broken"), mended).alias("tx"), F.col("_broken").alias("_parse_error"))
    passed = [F.col(c) for c in lines.columns if keep_errors or c != value]
    return (
        lines.withColumn("_line", F.trim(F.col(value)))
        .where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
        .withColumn("_record", record)
        .withColumn("_tx", tx)
        .withColumn("_broken", broken)
        .select(*passed, F.inline(F.array(outcome) if keep_errors else F.when(~F.col("_broken"), F.array(outcome))))
    )


def good_transactions(lines: DataFrame, value: str = "value", fields: list[str] | None = None) -> DataFrame:
    """The `tx` of every readable line, with all or the wanted fields."""
    return parse_audit_lines(lines, value, keep_errors=False, fields=fields).drop("_parse_error")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Number of good and skipped lines."""
    return parsed.agg(
        F.count_if(~F.col("_parse_error")).alias("parsed"),
        F.count_if(F.col("_parse_error")).alias("skipped"),
    )


def read_audit_json(spark: SparkSession, path: str | list[str], layout: str = "lines") -> DataFrame:
    """Transactions of JSON audit logs.

    `lines`: one object per line, splittable. `document`: a file is one JSON array or one
    (possibly pretty-printed) object, read with the multi-line reader.
    """
    if layout == "lines":
        return good_transactions(spark.read.text(path))
    if layout == "document":
        raw = spark.read.schema(transaction_schema()).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return raw.select(_unwrapped(F.struct("*")).alias("tx"))
    raise ValueError(f"layout must be 'lines' or 'document', got {layout!r}")
