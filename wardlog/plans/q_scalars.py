"""Queries: parsing, normalisation and pattern families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.functions import patterns as P
from wardlog.functions import scalars as S
from wardlog.operators import flatten as fl
from wardlog.operators import labels as lb
from wardlog.plans.driver_log import AUDIT_CTE, CLIENT_SQL, audit_log, derived_events
from wardlog.plans.flat_sql import FEATURE_CTE, FLAGS, FLAT_COLUMNS, FLAT_CTE, hit, no_index, no_index_any_case
from wardlog.plans.frames import feature_rows
from wardlog.plans.registry import query, table
from wardlog.sources.schemas import EVENT_COLUMNS, FLAG_COLUMNS, NUMERIC_FEATURES

FLAT = [c for c in EVENT_COLUMNS if c not in FLAG_COLUMNS]


@query("flatten_transaction", f"WITH {FLAT_CTE} SELECT event_id, {FLAT_COLUMNS} FROM flat")
def flatten_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flatten_transaction(audit_log(spark, sf_dir)).select("event_id", *FLAT)


@query("audit_features", f"WITH {FEATURE_CTE} SELECT event_id, {FLAT_COLUMNS}, {FLAGS} FROM feat")
def audit_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).select("event_id", *EVENT_COLUMNS)


@query(
    "normalize_transaction",
    f"""WITH {AUDIT_CTE} SELECT event_id, time_stamp, {CLIENT_SQL} AS client_ip, method, uri, agent AS user_agent, host,
    referer, status::VARCHAR AS http_code, props AS body, len(messages)::INT AS rule_count FROM audit""",
)
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fl.normalize_transaction(audit_log(spark, sf_dir))
    return tx.select(
        "event_id",
        "tx.time_stamp",
        "tx.client_ip",
        "tx.request.method",
        "tx.request.uri",
        F.col("tx.request.headers")["User-Agent"].alias("user_agent"),
        F.col("tx.request.headers")["Host"].alias("host"),
        F.col("tx.request.headers")["Referer"].alias("referer"),
        "tx.response.http_code",
        "tx.response.body",
        F.size("tx.messages").alias("rule_count"),
    )


@query("resolve_client_ip", f"WITH {AUDIT_CTE} SELECT event_id, {CLIENT_SQL} AS client_ip FROM audit")
def client_ip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = F.col("tx")
    return audit_log(spark, sf_dir).select(
        "event_id", S.resolve_client_ip(tx["request"]["headers"], tx["client_ip"]).alias("client_ip")
    )


# Texts that orders hold where a log has its severity: a digit, a word, a large number; and names by priority.
SEVERITY_TEXT = """CASE o_orderstatus WHEN 'F' THEN substr(o_orderpriority, 1, 1) WHEN 'O' THEN
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Alert' WHEN '2-HIGH' THEN ' warning ' ELSE substr(o_orderpriority, 3) END
  ELSE '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END"""


@query(
    "severity_score",
    f"""SELECT o_orderkey, severity, CASE WHEN severity IN ('1', '2', '3', '4', '5') THEN severity::INT WHEN severity = 'Alert' THEN 5
    WHEN severity = ' warning ' THEN 2 ELSE 0 END::INT AS score FROM (SELECT o_orderkey, {SEVERITY_TEXT} AS severity FROM orders)""",
)
def severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SEVERITY_TEXT).alias("severity"))
    return rows.select("o_orderkey", "severity", S.severity_score(F.col("severity")).alias("score"))


@query(
    "anomaly_to_severity",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 WHEN value < 3 THEN 0 WHEN value < 7 THEN 1 WHEN value < 13 THEN 2
    WHEN value < 21 THEN 3 WHEN value < 27 THEN 4 ELSE 5 END::INT AS severity_score FROM events""",
)
def anomaly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", S.anomaly_to_severity(score).alias("severity_score"))


@query(
    "parse_event_time",
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL
      WHEN event_id % 6 = 4 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS parsed
    FROM events""",
)
def parse_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_id") % 6
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    text = (
        F.when(kind == 0, F.concat(F.date_format(ts, "EEE MMM "), day, F.date_format(ts, " HH:mm:ss yyyy")))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.lit("yesterday, about noon"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", S.parse_event_time(text).cast("timestamp_ntz").alias("parsed")
    )


@query(
    "to_local_time",
    """SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time,
    strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' WIB' AS label,
    strftime(ts + INTERVAL 7 HOUR, '%Y/%m/%d %H:%M') || ' WIB' AS history FROM events""",
)
def local_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        S.to_local_time(ts).alias("local_time"),
        S.to_local_label(ts).alias("label"),
        S.to_local_history(ts).alias("history"),
    )


@query(
    "coerce_types",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS as_text,
    CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN user_id WHEN 2 THEN 0 ELSE -7 END::BIGINT AS as_int,
    CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN value ELSE 0.0 END::DOUBLE AS as_float,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 0 END::INT AS as_prediction,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE (m // 10 + (m % 10 > 5 OR (m % 10 = 5 AND m // 10 % 2 = 1))::INT) / 100000.0 END::DOUBLE
      AS as_probability
    FROM (SELECT *, event_id * 7919 % 1000000 AS m FROM events)""",
)
def coerce_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    millionths = F.lpad((eid * 7919 % 1000000).cast("string"), 6, "0")
    return table(spark, sf_dir, "events").select(
        "event_id",
        S.text_or_null(F.when(eid % 5 == 0, F.lit("")).otherwise(F.col("event_type"))).alias("as_text"),
        S.int_or_zero(
            F.when(eid % 4 == 0, F.lit("")).when(eid % 4 == 1, F.col("user_id").cast("string")).when(eid % 4 == 2, F.lit("x1")).otherwise(F.lit(" -7 "))
        ).alias("as_int"),
        S.float_or_zero(F.when(eid % 3 == 1, F.col("value").cast("string")).when(eid % 3 == 2, F.lit("n/a"))).alias("as_float"),
        S.prediction_or_null(
            F.element_at(F.array(F.lit(""), F.lit("1"), F.lit("3"), F.lit("yes"), F.lit("0")), (eid % 5 + 1).cast("int"))
        ).alias("as_prediction"),
        S.probability_or_null(F.when(eid % 7 != 0, F.concat(F.lit("0."), millionths))).cast("double").alias("as_probability"),
    )


@query("decode_uri", f"WITH {AUDIT_CTE} SELECT event_id, url_decode(replace(uri, '+', ' ')) AS decoded FROM raw_log")
def decode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_events(spark, sf_dir).select("event_id", S.decode_uri(F.col("uri")).alias("decoded"))


@query(
    "length_features",
    f"WITH {FLAT_CTE} SELECT event_id, uri_len, user_agent_len FROM flat",
)
def length_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flatten_transaction(audit_log(spark, sf_dir)).select("event_id", "uri_len", "user_agent_len")


def plain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic requests with holes: NULL status, numbers and agents now and then."""
    eid = F.col("event_id")
    return derived_events(spark, sf_dir).select(
        "event_id",
        "method",
        "uri",
        F.when(eid % 10 != 0, F.col("http_code")).alias("status"),
        F.when(eid % 9 != 0, F.length("body")).alias("bytes_sent"),
        F.when(eid % 8 != 0, F.col("agent")).alias("user_agent"),
        F.when(eid % 6 != 0, F.size("messages")).alias("rule_count"),
        F.col("host").alias("host_header"),
        "referer",
    )


REQUEST_CTE = f"""{AUDIT_CTE},
req AS (
  SELECT event_id, upper(method) AS method, uri, CASE WHEN event_id % 10 = 0 THEN 200 ELSE status END::INT AS status,
    CASE WHEN event_id % 9 = 0 THEN 0 ELSE length(props) END::BIGINT AS bytes_sent, 0.0::DOUBLE AS request_time,
    CASE WHEN event_id % 8 = 0 THEN '' ELSE agent END AS ua,
    CASE WHEN event_id % 6 = 0 THEN 0 ELSE len(messages) END::INT AS rule_count, 0.0::DOUBLE AS severity_score,
    host, referer, url_decode(replace(uri, '+', ' ')) AS dec
  FROM audit
),
req_text AS (SELECT *, dec || ' ' || ua AS full_text FROM req)"""


@query(
    "request_defaults",
    f"""WITH {REQUEST_CTE} SELECT event_id, method, uri, status, bytes_sent, request_time, ua AS user_agent, rule_count,
    severity_score FROM req""",
)
def request_defaults_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.request_defaults(plain_requests(spark, sf_dir)).drop("host_header", "referer")


@query(
    "request_features",
    f"""WITH {REQUEST_CTE} SELECT event_id, method, uri, status, bytes_sent, request_time, rule_count, severity_score,
    length(ua)::INT AS user_agent_len, length(uri)::INT AS uri_len,
    {hit("sqli", "full_text")} AS has_sqli_pattern, {hit("xss", "full_text")} AS has_xss_pattern,
    {hit("suspicious_path", "uri")} AS has_suspicious_path, {hit("path_traversal", "dec")} AS has_path_traversal,
    {hit("command_injection", "dec")} AS has_command_injection, {hit("host_header_xss", "host")} AS has_cve_2022_24181,
    {hit("xml_upload_name", no_index_any_case("full_text"))} AS has_cve_2023_47271_upload,
    {hit("uploaded_php_access", "dec")} AS has_cve_2023_47271_rce, 1 - {hit("csrf_token", "full_text")} AS missing_csrf_token,
    (referer = '-')::INT AS has_suspicious_referer, {hit("xss", "full_text")} * {hit("privesc", "full_text")} AS has_cve_2024_xss_privesc,
    {hit("privesc", "full_text")} AS has_privesc_attempt, {hit("executable_ext", "dec")} AS has_executable_upload,
    {hit("upload_bypass", "dec")} AS has_file_upload_bypass,
    greatest({hit("executable_ext", "dec")}, {hit("upload_bypass", "dec")}) AS has_cve_2021_32626 FROM req_text""",
)
def request_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.request_features(plain_requests(spark, sf_dir))


LABELED_CTE = f"""{AUDIT_CTE},
csv AS (
  SELECT event_id, client_ip AS ip, upper(method) AS method, uri AS uri_full, string_split(uri, '?')[1] AS uri_norm,
    epoch(date_trunc('second', ts))::BIGINT AS timestamp, status::INT AS status,
    CASE WHEN event_id % 7 > 1 THEN 'malicious' ELSE 'normal' END AS label,
    CASE event_id % 7 WHEN 2 THEN 'attack-generic|attack-sqli|attack-protocol' WHEN 3 THEN 'attack-generic|attack-xss'
      WHEN 5 THEN 'attack-lfi' ELSE NULL END AS attack_tags,
    CASE WHEN event_id % 7 > 1 THEN round(value, 1) END AS anomaly_score
  FROM audit
)"""


def labeled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the labelled CSV layout, plus `event_id`."""
    eid = F.col("event_id")
    value = table(spark, sf_dir, "events").select("event_id", "value")
    rows = derived_events(spark, sf_dir).join(value, "event_id")
    return rows.select(
        "event_id",
        F.col("client_ip").alias("ip"),
        F.upper("method").alias("method"),
        F.col("uri").alias("uri_full"),
        F.split_part("uri", F.lit("?"), F.lit(1)).alias("uri_norm"),
        F.unix_seconds("ts").alias("timestamp"),
        F.col("http_code").alias("status"),
        F.when(eid % 7 > 1, "malicious").otherwise("normal").alias("label"),
        F.when(eid % 7 == 2, "attack-generic|attack-sqli|attack-protocol")
        .when(eid % 7 == 3, "attack-generic|attack-xss")
        .when(eid % 7 == 5, "attack-lfi")
        .alias("attack_tags"),
        F.when(eid % 7 > 1, F.round("value", 1)).alias("anomaly_score"),
    )


PREPARED = f"""method, uri_norm AS uri, status, 0 AS bytes_sent, 0.0::DOUBLE AS request_time, 0 AS rule_count,
    CASE WHEN anomaly_score IS NULL OR anomaly_score < 3 THEN 0 WHEN anomaly_score < 7 THEN 1 WHEN anomaly_score < 13 THEN 2
      WHEN anomaly_score < 21 THEN 3 WHEN anomaly_score < 27 THEN 4 ELSE 5 END::INT AS severity_score,
    0 AS user_agent_len, length(uri_norm)::INT AS uri_len, {hit("sqli", "uri_full")} AS has_sqli_pattern,
    {hit("xss", "uri_full")} AS has_xss_pattern, {hit("suspicious_path", "uri_norm")} AS has_suspicious_path,
    (label = 'malicious')::INT AS label"""


@query("label_from_text", f"WITH {LABELED_CTE} SELECT {PREPARED} FROM csv")
def label_from_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.prepare_labeled_csv(labeled_rows(spark, sf_dir))


@query(
    "attack_tags_split",
    f"""WITH {LABELED_CTE}, c AS (SELECT attack_tags AS tag, count(*) AS n FROM csv WHERE attack_tags IS NOT NULL GROUP BY 1)
    SELECT 'combination' AS kind, tag, n::BIGINT AS n FROM c
    UNION ALL SELECT 'tag', tag, sum(n)::BIGINT FROM (SELECT unnest(string_split(tag, '|')) AS tag, n FROM c) GROUP BY tag""",
)
def tags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.attack_tags_split(labeled_rows(spark, sf_dir))


@query(
    "raw_text_flags",
    f"""WITH {AUDIT_CTE} SELECT event_id, uri, length(uri)::INT AS uri_len,
    regexp_matches(lower(uri), 'union|select|sleep|drop|exec')::INT AS has_sqli,
    regexp_matches(lower(uri), '<script|javascript|onerror|alert')::INT AS has_xss FROM raw_log""",
)
def raw_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.raw_text_flags(derived_events(spark, sf_dir).select("event_id", "uri"))


TRAINING_SQL = ", ".join(
    {"has_sqli_pattern": "has_sqli AS has_sqli_pattern", "has_xss_pattern": "has_xss AS has_xss_pattern"}.get(c, c) for c in NUMERIC_FEATURES
)


@query(
    "harmonize_training_columns",
    f"""WITH {FEATURE_CTE} SELECT event_id, method, uri, label,
    {TRAINING_SQL.replace("has_cve_2022_24181", "0 AS has_cve_2022_24181").replace("has_privesc_attempt", "0 AS has_privesc_attempt")} FROM feat""",
)
def harmonize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean = feature_rows(spark, sf_dir).drop("has_cve_2022_24181", "has_privesc_attempt")
    return lb.harmonize_training_columns(lean).select("event_id", "method", "uri", "label", *NUMERIC_FEATURES)


@query(
    "normalize_scoring_row",
    f"""WITH {FEATURE_CTE} SELECT event_id, 'GET' AS method, uri,
    {TRAINING_SQL.replace("has_cve_2022_24181", "0 AS has_cve_2022_24181")} FROM feat""",
)
def scoring_row_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean = feature_rows(spark, sf_dir).drop("has_cve_2022_24181", "method")
    return lb.normalize_scoring_row(lean).select("event_id", "method", "uri", *NUMERIC_FEATURES)


@query(
    "truncate_uri",
    f"""WITH {AUDIT_CTE} SELECT event_id, CASE WHEN length(uri) > 46 THEN left(uri, 43) || '...' ELSE uri END AS shown FROM raw_log""",
)
def truncate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_events(spark, sf_dir).select("event_id", S.truncate_text(F.col("uri")).alias("shown"))


# Pattern families run over every page, every document and every request URI.
TEXTS_CTE = f"""{AUDIT_CTE},
corpus AS (
  SELECT 'event:' || event_id AS id, uri || ' ' || agent || ' ' || host AS body FROM raw_log
  UNION ALL SELECT 'page:' || page_id, url || ' ' || html FROM pages
  UNION ALL SELECT 'doc:' || doc_id, text FROM documents
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived_events(spark, sf_dir).select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"),
        F.concat_ws(" ", "uri", "agent", "host").alias("body"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.concat_ws(" ", "url", "html").alias("body")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body")
    )
    return requests.unionByName(pages).unionByName(documents)


def _register_family(family: str) -> None:
    body = no_index("body") if family == "xml_upload_name" else "body"

    @query(f"has_{family}", f"WITH {TEXTS_CTE} SELECT id, {hit(family, body)} AS hit FROM corpus")
    def family_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("body")
        if family == "xml_upload_name":
            text = P.without_front_controller(text)
        rows = corpus(spark, sf_dir).withColumn("body", text).withColumn("low", P.folded(F.col("body")))
        return rows.select("id", P.flag(P.matches(family, F.col("body"), "low")).alias("hit"))


for _family in P.FAMILIES:
    _register_family(_family)


DERIVED = {
    "missing_csrf_token": (
        lambda: P.missing_csrf_token(F.col("method"), F.col("uri")),
        f"(upper(method) = 'POST' AND {hit('csrf_token', 'uri')} = 0)::INT",
    ),
    "suspicious_referer": (
        lambda: P.suspicious_referer(F.col("method"), F.col("referer")),
        "(upper(method) = 'POST' AND referer IN ('', '-'))::INT",
    ),
    "xss_privesc": (lambda: P.xss_privesc(F.col("uri")), f"{hit('xss', 'uri')} * {hit('privesc', 'uri')}"),
    "upload_rce_2021": (
        lambda: P.upload_rce_2021(P.without_front_controller(F.col("uri"))),
        f"greatest({hit('executable_ext', no_index('uri'))}, {hit('upload_bypass', no_index('uri'))})",
    ),
}


def _register_derived(name: str) -> None:
    column, sql = DERIVED[name]

    @query(name, f"WITH {AUDIT_CTE} SELECT event_id, {sql} AS flag FROM raw_log")
    def derived_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived_events(spark, sf_dir).select("event_id", column().alias("flag"))


for _name in DERIVED:
    _register_derived(_name)


@query(
    "legit_upload_rows",
    f"""WITH {FLAT_CTE} SELECT event_id, method, uri FROM flat
    WHERE label = 0 AND method = 'POST' AND regexp_matches(uri, '/uploadFile|/importexport', 'i')""",
)
def legit_upload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.legit_upload_rows(fl.flatten_transaction(audit_log(spark, sf_dir))).select("event_id", "method", "uri")
