"""Attack typing and log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.sources.schemas import MESSAGE

# Rule ids and their category.
RULE_CATEGORIES: dict[str, list[str]] = {
    "Scanner": ["913100", "913101", "913102"],
    "Protocol": ["920350"],
    "Path Traversal": ["930100", "930110"],
    "LFI": ["930120", "930130"],
    "RCE": ["932100", "932105", "932110", "932115", "932160", "932170", "932171"],
    "XSS": [
        "941100", "941101", "941110", "941120", "941130", "941140", "941150", "941160", "941170", "941180",
        "941190", "941200", "941210", "941220", "941230", "941240", "941250", "941260", "941270", "941280",
        "941290", "941300", "941310", "941320", "941330", "941340", "941350",
    ],
    "SQLi": [
        "942100", "942101", "942110", "942120", "942130", "942140", "942150", "942160", "942170", "942180",
        "942190", "942200", "942210", "942220", "942230", "942240", "942250", "942260", "942270", "942280",
        "942290", "942300", "942310", "942320", "942330", "942340", "942350", "942360", "942361", "942370",
        "942380", "942390", "942400", "942410", "942420", "942421", "942430", "942440", "942450", "942460",
        "942470", "942480",
    ],
    "Anomaly Threshold": ["949110", "980130"],
}
# Flag columns and the category each one stands for.
FEATURE_CATEGORIES = {
    "has_cve_2023_47271_upload": "Upload",
    "has_cve_2023_47271_rce": "RCE",
    "has_cve_2022_24181": "XSS",
    "has_cve_2021_32626": "RCE",
    "has_cve_2024_xss_privesc": "XSS PrivEsc",
    "has_sqli": "SQLi",
    "has_xss": "XSS",
    "has_path_traversal": "Path Traversal",
    "has_command_injection": "RCE",
}
THRESHOLD_CATEGORY = "Anomaly Threshold"
THRESHOLD_RULES = RULE_CATEGORIES[THRESHOLD_CATEGORY]
NOISE_RULES = ["920350"]


def rule_dimension(spark: SparkSession) -> DataFrame:
    """The fixed rule table: `rule_id`, `category`. Its size never depends on data."""
    rows = [(rule, category) for category, rules in RULE_CATEGORIES.items() for rule in rules]
    return spark.createDataFrame(rows, "rule_id STRING, category STRING")


def category_of(rule_id: Column) -> Column:
    """Category of a rule id, NULL when unknown."""
    found = F.when(F.lit(False), F.lit(""))
    for category, rules in RULE_CATEGORIES.items():
        found = found.when(rule_id.isin(rules), F.lit(category))
    return found


def message_rules(messages: Column) -> Column:
    """Rule ids of a message list, '' where a message has none."""
    return F.transform(
        F.coalesce(messages, F.array().cast(f"array<{MESSAGE}>")), lambda m: F.coalesce(m["details"]["ruleId"], F.lit(""))
    )


def log_attack_types(messages: Column) -> Column:
    """Distinct types of a transaction as the log summary counts them.

    Noise and threshold rules are ignored; an unknown rule is a type of its own, `Other (id)`.
    """
    rules = F.filter(F.array_distinct(message_rules(messages)), lambda r: ~r.isin(NOISE_RULES + THRESHOLD_RULES))
    return F.array_distinct(
        F.transform(rules, lambda r: F.coalesce(category_of(r), F.concat(F.lit("Other ("), r, F.lit(")"))))
    )


def rule_types(messages: Column) -> Column:
    """Distinct known categories of a transaction; unknown and threshold rules are ignored."""
    known = F.transform(F.array_distinct(message_rules(messages)), category_of)
    return F.array_distinct(F.filter(known, lambda c: c.isNotNull() & (c != THRESHOLD_CATEGORY)))


def feature_types() -> Column:
    """Categories of the set flags; the 2021 upload flag yields to the 2023 ones."""
    newer = (F.col("has_cve_2023_47271_upload") == 1) | (F.col("has_cve_2023_47271_rce") == 1)
    found = []
    for column, category in FEATURE_CATEGORIES.items():
        on = F.col(column) == 1
        if column == "has_cve_2021_32626":
            on = on & ~newer
        found.append(F.when(on, F.lit(category)))
    return F.array_compact(F.array(*found))


def attack_type_of_event(messages: Column, with_flags: bool = True) -> Column:
    """Sorted, comma-joined set of categories, `unknown` when there is none."""
    types = rule_types(messages)
    if with_flags:
        types = F.array_union(types, feature_types())
    joined = F.array_join(F.array_sort(F.array_distinct(types)), ", ")
    return F.when(joined == "", F.lit("unknown")).otherwise(joined)


def explode_rules(df: DataFrame) -> DataFrame:
    """One row per message that names a rule: other columns plus `rule_id`."""
    return df.select("*", F.explode(message_rules(F.col("tx.messages"))).alias("rule_id")).where("rule_id != ''")


def rule_category_join(df: DataFrame) -> DataFrame:
    """Adds `category` to rows with `rule_id`; unknown rules become `Other (id)`."""
    dim = F.broadcast(rule_dimension(df.sparkSession))
    return df.join(dim, "rule_id", "left").withColumn(
        "category", F.coalesce("category", F.concat(F.lit("Other ("), "rule_id", F.lit(")")))
    )


def percent(part: Column, whole: Column, places: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), places)


def log_summary(df: DataFrame) -> DataFrame:
    """Total, normal and malicious transactions with their shares, in one pass."""
    bad = F.size(log_attack_types(F.col("tx.messages"))) > 0
    return (
        df.select(bad.alias("bad"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(~F.col("bad")).alias("normal"),
            F.count_if("bad").alias("malicious"),
        )
        .withColumn("normal_pct", percent(F.col("normal"), F.col("total")))
        .withColumn("malicious_pct", percent(F.col("malicious"), F.col("total")))
    )


def attack_type_counts(df: DataFrame) -> DataFrame:
    """Transactions per attack type."""
    return (
        df.select(F.explode(log_attack_types(F.col("tx.messages"))).alias("attack_type"))
        .groupBy("attack_type")
        .agg(F.count("*").alias("transactions"))
    )


def rule_counts(df: DataFrame) -> DataFrame:
    """Message hits per rule, without the noise rule, with thresholds; `Unknown` when not listed."""
    counted = (
        explode_rules(df.select("tx")).where(~F.col("rule_id").isin(NOISE_RULES)).groupBy("rule_id").agg(F.count("*").alias("hits"))
    )
    return counted.withColumn("category", F.coalesce(category_of(F.col("rule_id")), F.lit("Unknown")))


def value_counts(df: DataFrame, column: Column | str, name: str, top: int | None = None) -> DataFrame:
    """Frequencies of a value; with `top`, the most frequent ones, ties by value."""
    value = F.col(column) if isinstance(column, str) else column
    counted = df.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), F.asc(name)).limit(top)


def log_value(field: Column) -> Column:
    """A log field as the summary shows it, `-` when absent."""
    return F.coalesce(field, F.lit("-"))
