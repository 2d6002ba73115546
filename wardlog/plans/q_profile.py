"""Queries: data quality and exploratory statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators import profile as pf
from wardlog.operators.heavy_hitters import heavy_hitters
from wardlog.operators.information import neighbour_information
from wardlog.plans.flat_sql import FEATURE_CTE
from wardlog.plans.frames import feature_rows
from wardlog.plans.registry import query, table

# Small on purpose: the checks run the bracketing selection that large tables take.
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = [
    "has_sqli", "has_xss", "has_suspicious_path", "has_path_traversal", "has_command_injection",
    "has_cve_2023_47271_upload", "has_cve_2023_47271_rce",
]


def holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with NULLs in two columns."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )


HOLED = """holed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders)"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query(
    "missing_profile",
    f"WITH {HOLED} SELECT * FROM ("
    + _union(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6)::DOUBLE AS missing_pct FROM holed"
        for c in ORDER_COLUMNS
    )
    + ") WHERE missing_count > 0",
)
def missing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.missing_profile(holed_orders(spark, sf_dir))


@query(
    "completeness",
    f"""WITH {HOLED}, c AS (SELECT count(*) * 5 AS total_cells,
      ({" + ".join(f"count(*) - count({c})" for c in ORDER_COLUMNS)})::BIGINT AS null_cells FROM holed)
    SELECT total_cells, null_cells, round((total_cells - null_cells) * 100.0::DOUBLE / total_cells, 6)::DOUBLE AS completeness_pct FROM c""",
)
def completeness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.completeness(holed_orders(spark, sf_dir))


@query(
    "duplicate_profile",
    """WITH d AS (SELECT lang, source, text, n_chars FROM documents), u AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM d)),
    t AS (SELECT count(*) AS total_rows FROM d)
    SELECT total_rows, total_rows - n AS duplicate_rows, round((total_rows - n) * 100.0::DOUBLE / total_rows, 6)::DOUBLE AS duplicate_pct FROM t, u""",
)
def duplicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.duplicate_profile(table(spark, sf_dir, "documents").drop("doc_id"))


@query(
    "describe_numeric",
    _union(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4)::DOUBLE AS std, min({c})::DOUBLE AS min,
        round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q1, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS median,
        round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q3, max({c})::DOUBLE AS max FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.describe_numeric(table(spark, sf_dir, "lineitem").select(*LINE_NUMBERS), LINE_NUMBERS)


TEXTS = ["c_mktsegment", "c_name"]


@query(
    "categorical_top10",
    "WITH v AS ("
    + _union(f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM customer GROUP BY 2" for c in TEXTS)
    + """), p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value)::INT AS place FROM v)
    SELECT * FROM p WHERE place <= 10""",
)
def categorical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.categorical_top10(table(spark, sf_dir, "customer").select(*TEXTS))


NUMERIC = ["user_agent_len", "uri_len", "severity_score", "rule_count", "status", "bytes_sent", *FLAGS]


@query(
    "correlation_with_label",
    f"WITH {FEATURE_CTE} "
    + _union(f"SELECT '{c}' AS feature, round(abs(corr({c}, label)), 6)::DOUBLE AS correlation FROM feat" for c in NUMERIC),
)
def label_correlation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.correlation_with_label(feature_rows(spark, sf_dir), "label", NUMERIC)


MATRIX = [*LINE_NUMBERS, "charge"]
LINES = "lines AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS charge FROM lineitem)"


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(*LINE_NUMBERS, charge.alias("charge"))


@query(
    "correlation_matrix",
    f"WITH {LINES} "
    + _union(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6)::DOUBLE AS correlation FROM lines" for a in MATRIX for b in MATRIX
    ),
)
def matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.correlation_matrix(line_numbers(spark, sf_dir), MATRIX)


@query(
    "high_correlation_pairs",
    f"WITH {LINES} SELECT * FROM ("
    + _union(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6)::DOUBLE AS correlation FROM lines"
        for a, b in combinations(MATRIX, 2)
    )
    + ") WHERE abs(correlation) > 0.9",
)
def high_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.high_correlation_pairs(line_numbers(spark, sf_dir), MATRIX)


OUTLIERS = ["value", "user_id"]


@query(
    "iqr_outliers",
    "WITH "
    + ", ".join(
        f"b{i} AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)" for i, c in enumerate(OUTLIERS)
    )
    + " SELECT * FROM ("
    + _union(
        f"""SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
        round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(*), 6)::DOUBLE AS outlier_pct,
        round(any_value(q1 - 1.5 * (q3 - q1)), 4)::DOUBLE AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4)::DOUBLE AS upper_bound FROM events, b{i}"""
        for i, c in enumerate(OUTLIERS)
    )
    + ") WHERE outliers > 0",
)
def outliers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.iqr_outliers(table(spark, sf_dir, "events").select(*OUTLIERS), OUTLIERS)


@query(
    "flag_distribution",
    f"WITH {FEATURE_CTE} "
    + _union(f"SELECT '{c}' AS feature, sum({c})::BIGINT AS ones, round(sum({c}) * 100.0::DOUBLE / count(*), 6)::DOUBLE AS pct FROM feat" for c in FLAGS),
)
def flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.flag_distribution(feature_rows(spark, sf_dir), FLAGS)


@query(
    "distinct_profile",
    f"""WITH {FEATURE_CTE} SELECT 'unique_source_ips' AS metric, NULL AS value, count(DISTINCT source_ip) AS n FROM feat
    UNION ALL SELECT 'unique_uris', NULL, count(DISTINCT uri) FROM feat
    UNION ALL SELECT 'method', method, count(*) FROM feat GROUP BY method
    UNION ALL SELECT * FROM (SELECT 'top_uri', uri, count(*) AS n FROM feat GROUP BY uri ORDER BY n DESC, uri LIMIT 5)""",
)
def distinct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.distinct_profile(feature_rows(spark, sf_dir).select("source_ip", "uri", "method"))


@query(
    "label_distribution",
    f"""WITH {FEATURE_CTE}, c AS (SELECT count(*) AS total, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS attack FROM feat)
    SELECT total, normal, attack, round(normal * 100.0::DOUBLE / total, 6)::DOUBLE AS normal_pct, round(attack * 100.0::DOUBLE / total, 6)::DOUBLE AS attack_pct,
    abs(normal - attack) < total * 0.1 AS balanced FROM c""",
)
def label_distribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.label_distribution(feature_rows(spark, sf_dir))


MI_FLAGS = ["has_sqli", "has_xss", "has_cve_2023_47271_upload", "status", "severity_score"]


def _mi(feature: str, value: str) -> str:
    return f"""SELECT '{feature}' AS feature, round(sum(n / total * ln(n * total / (nx * ny))), 6)::DOUBLE AS mi_score FROM (
      SELECT n, sum(n) OVER (PARTITION BY v) AS nx, sum(n) OVER (PARTITION BY label) AS ny, sum(n) OVER () AS total
      FROM (SELECT {value} AS v, label, count(*)::DOUBLE AS n FROM feat {"CROSS JOIN cuts" if "cuts" in value else ""} GROUP BY 1, 2))"""


@query(
    "mutual_information",
    f"WITH {FEATURE_CTE}, cuts AS (SELECT quantile_cont(bytes_sent + severity_score * 3 + uri_len::DOUBLE, "
    "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM feat) "
    + _union([*[_mi(c, c) for c in MI_FLAGS], _mi("mixed", "len([e for e in cuts.q if bytes_sent + severity_score * 3 + uri_len::DOUBLE > e])")]),
)
def mutual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = (F.col("bytes_sent") + F.col("severity_score") * 3 + F.col("uri_len")).cast("double")
    rows = feature_rows(spark, sf_dir).select("label", *MI_FLAGS, mixed.alias("mixed"))
    return pf.mutual_information(rows, "label", [*MI_FLAGS, "mixed"], ["mixed"], 10)


NEIGHBOUR_COLUMNS = {
    "uri_len": "uri_len", "user_agent_len": "user_agent_len", "bytes_sent": "bytes_sent", "status": "status", "user_id": "user_id",
    "seconds": "epoch(ts)", "mixed": "CASE WHEN event_id % 13 <> 4 THEN severity_score * 1000 + uri_len + (event_id % 97) * 0.37::DOUBLE END", "severity_score": "severity_score",
}


def _psi(x: str) -> str:
    s = f"({x} + 8)"
    parts = " - ".join(f"1 / ({x} + {i})::DOUBLE" for i in range(8))
    return f"(ln({s}) - 0.5 / {s} - 1 / (12 * {s} ** 2) + 1 / (120 * {s} ** 4) - 1 / (252 * {s} ** 6) + 1 / (240 * {s} ** 8) - {parts})"


@query(
    "neighbour_information",
    f"""WITH {FEATURE_CTE}, p AS ("""
    + _union(f"SELECT '{c}' AS feature, label AS y, coalesce(({sql})::DOUBLE, 0) AS x FROM feat" for c, sql in NEIGHBOUR_COLUMNS.items())
    + f"""), w AS (SELECT feature, y, x, least(3, count(*) OVER (PARTITION BY feature, y) - 1) AS k, count(*) OVER (PARTITION BY feature, y) AS nc,
      list(x) OVER (PARTITION BY feature, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM p),
    g AS (SELECT *, list_sort([{{'d': abs(v - x), 'v': v}} for v in near])[k + 1] AS s FROM w WHERE nc > 1),
    b AS (SELECT feature, y, x, k, nc, s.d AS d, CASE WHEN s.v > x THEN s.v ELSE x + s.d END AS hi,
      CASE WHEN s.v < x THEN s.v ELSE x - s.d END AS lo, count(*) AS n FROM g GROUP BY ALL),
    t AS (SELECT feature, x, sum(n)::BIGINT AS n FROM b GROUP BY ALL),
    m AS (SELECT b.feature, b.y, b.x, b.k, b.nc, b.n, sum(t.n)::DOUBLE AS m FROM b JOIN t ON b.feature = t.feature
      AND (t.x > b.lo OR b.d = 0 AND t.x = b.x) AND (t.x < b.hi OR b.d = 0 AND t.x = b.x) GROUP BY ALL)
    SELECT feature, round(greatest(0, {_psi("sum(n)::DOUBLE")} + sum(n * ({_psi("k")} - {_psi("nc")} - {_psi("m")})) / sum(n)), 6)::DOUBLE AS mi_score
    FROM m GROUP BY feature""",
)
def neighbour_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric request features ranked by the k-nearest-neighbour estimate; `mixed` has missing values."""
    mixed = F.when(F.col("event_id") % 13 != 4, F.col("severity_score") * 1000 + F.col("uri_len") + (F.col("event_id") % 97) * 0.37)
    rows = feature_rows(spark, sf_dir).withColumns({"seconds": F.col("ts").cast("timestamp").cast("double"), "mixed": mixed})
    return neighbour_information(rows, "label", list(NEIGHBOUR_COLUMNS))


@query(
    "eda_clean",
    """WITH d AS (SELECT DISTINCT * FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id,
        CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type FROM events
        UNION ALL SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END, user_id, CASE WHEN event_id % 3 <> 0 THEN event_type END
        FROM events WHERE user_id % 5 = 0)),
    m AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(user_id::DOUBLE, 0.5) AS mu FROM d),
    f AS (SELECT event_id, coalesce(value, mv) AS value, coalesce(user_id::DOUBLE, mu) AS user_id, coalesce(event_type, '') AS event_type FROM d, m),
    b AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3, quantile_cont(user_id, 0.25) AS u1,
      quantile_cont(user_id, 0.75) AS u3 FROM f),
    k AS (SELECT f.* FROM f, b WHERE value BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1)
      AND user_id BETWEEN u1 - 1.5 * (u3 - u1) AND u3 + 1.5 * (u3 - u1)),
    s AS (SELECT avg(value) AS va, stddev_pop(value) AS vs, avg(user_id) AS ua, stddev_pop(user_id) AS us FROM k)
    SELECT event_id, event_type, round((value - va) / vs, 6)::DOUBLE AS value, round((user_id - ua) / us, 6)::DOUBLE AS user_id FROM k, s""",
)
def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(eid % 7 != 0, F.col("value")).alias("value"), "user_id", F.when(eid % 3 != 0, F.col("event_type")).alias("event_type")
    )
    doubled = rows.unionByName(rows.where("user_id % 5 = 0"))
    cleaned = pf.eda_clean(doubled, ["event_id"])
    return cleaned.select("event_id", "event_type", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


@query(
    "heavy_words",
    """WITH words AS (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100""",
)
def heavy_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent words of all documents, with a certificate in place of a grouping of all words."""
    words = F.explode(F.split(F.lower("text"), "[^a-z0-9]+"))
    return heavy_hitters(table(spark, sf_dir, "documents").select(words.alias("word")).where("word <> ''"), "word", 100)


@query(
    "heavy_users",
    "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id NULLS FIRST LIMIT 50",
)
def heavy_users_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 busiest users of the event log, whose counts are nearly flat."""
    return heavy_hitters(table(spark, sf_dir, "events"), "user_id", 50)
