"""Queries: readers and sinks, over files that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators.flatten import flatten_transaction
from wardlog.plans.driver_log import AUDIT_CTE, audit_lines, audit_log, derived_events
from wardlog.plans.flat_sql import FEATURE_CTE, FLAGS, FLAT_COLUMNS, FLAT_CTE, TYPED_CTE, hit
from wardlog.plans.frames import decided_rows, feature_rows
from wardlog.plans.q_scalars import FLAT, LABELED_CTE, PREPARED, labeled_rows
from wardlog.plans.registry import query, table
from wardlog.session import scratch_path
from wardlog.sources import audit_json as aj
from wardlog.sources import audit_text as tx
from wardlog.sources import datasets as ds
from wardlog.sources.schemas import EVENT_COLUMNS


@query("read_audit_json", f"WITH {FLAT_CTE} SELECT {FLAT_COLUMNS} FROM flat")
def read_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with comments, blank and broken lines among them, read from files."""
    path = scratch_path(spark, "audit-json")
    noise = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 10 == 1, F.lit("# comment")
    )
    lines = audit_lines(spark, sf_dir)
    lines.select(F.explode(F.array_compact(F.array("value", noise))).alias("value")).write.text(path)
    return flatten_transaction(aj.read_audit_json(spark, path)).select(*FLAT)


@query(
    "read_audit_json_skipped",
    "SELECT count(*) AS parsed, count(*) FILTER (event_id % 10 = 0) AS skipped FROM events",
)
def skipped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.when(F.col("event_id") % 10 == 0, F.lit("[1, 2")).when(F.col("event_id") % 10 == 1, F.lit("#"))
    lines = audit_lines(spark, sf_dir)
    noisy = lines.select(F.explode(F.array_compact(F.array("value", noise))).alias("value"))
    return aj.parse_report(aj.parse_audit_lines(noisy))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction as a text block; some without end marker, some without response section.

    Some addresses look like a marker, and some blocks have a head and an end alone.
    """
    like_marker = F.when(F.col("event_id") % 12 == 5, F.concat(F.lit("/x--a-Boo?y=--"), F.lower(F.hex("event_id")), F.lit("-C--"))).otherwise(F.col("uri"))
    rows = derived_events(spark, sf_dir).withColumn("uri", like_marker)
    mark = F.lower(F.hex("event_id"))
    rule = F.try_element_at(F.col("messages"), F.lit(1))
    audit = F.when(
        F.size("messages") > 0,
        F.concat(
            F.lit('Message: Matched data "'), F.regexp_replace(rule["details"]["data"], "Matched ", ""), F.lit('" [id "'),
            rule["details"]["ruleId"], F.lit('"] [msg "'), rule["message"], F.lit('"] [severity "'),
            rule["details"]["severity"], F.lit('"]\n'),
            F.when(F.col("http_code") == 403, F.lit("Action: Intercepted (phase 2)\n")).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit("Stopwatch: 1\n"))
    block = F.concat(
        F.lit("--"), mark, F.lit("-A--\n["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), mark, F.lit(" "),
        F.col("client_ip"), F.lit(" 4711 10.9.9.9 80\n--"), mark, F.lit("-B--\n"), F.col("method"), F.lit(" "), F.col("uri"),
        F.lit(" HTTP/1.1\nHost: journal.example\nUser-Agent: "), F.col("agent"), F.lit("\n\n"),
        F.when(
            F.col("event_id") % 8 != 1,
            F.concat(F.lit("--"), mark, F.lit("-F--\nHTTP/1.1 "), F.col("http_code").cast("string"), F.lit(" X\nContent-Length: 7\n\n")),
        ).otherwise(F.lit("")),
        F.lit("--"), mark, F.lit("-H--\n"), audit, F.lit("\n"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("--"), mark, F.lit("-Z--"))).otherwise(F.lit("")),
    )
    bare = F.concat(
        F.lit("--"), mark, F.lit("-A--\n["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), mark, F.lit(" 10.8.8.8 1 10.9.9.9 80\n--"),
        mark, F.lit("-Z--"),
    )
    return rows.select("ts", F.explode(F.array_compact(F.array(F.when(F.col("event_id") % 10 == 3, bare), block))).alias("value"))


TEXT_SQL = f"""WITH {AUDIT_CTE},
blocks AS (
  SELECT event_id, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS timestamp, client_ip AS source_ip, method,
    CASE WHEN event_id % 12 = 5 THEN '/x--a-Boo?y=--' || lower(hex(event_id)) || '-C--' ELSE string_split(uri, ' ')[1] END AS uri,
    CASE WHEN event_id % 8 = 1 THEN 200 ELSE status END::INT AS status, agent AS user_agent,
    coalesce(messages[1].severity, '') AS severity, coalesce(messages[1].ruleId, '') AS rule_id,
    coalesce(replace(messages[1].data, 'Matched ', ''), '') AS matched_data, coalesce(messages[1].message, '') AS msg,
    len(messages) > 0 AND status = 403 AS is_blocked FROM audit
  UNION ALL SELECT event_id, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000'), '10.8.8.8', 'GET', '/', 200, '', '', '', '', '', false FROM audit WHERE event_id % 10 = 3),
texts AS (SELECT *, uri || ' ' || msg || ' ' || matched_data AS full_text FROM blocks)
SELECT timestamp, source_ip, method, uri, status, 0::BIGINT AS bytes_sent, 0.0::DOUBLE AS request_time, user_agent, severity, rule_id, matched_data,
  msg, is_blocked, length(user_agent)::INT AS user_agent_len, length(uri)::INT AS uri_len,
  CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'WARNING' THEN 2 ELSE 0 END::INT AS severity_score,
  {hit("sqli", "full_text")} AS has_sqli, {hit("xss", "full_text")} AS has_xss, {hit("suspicious_path", "uri")} AS has_suspicious_path,
  {hit("path_traversal", "uri")} AS has_path_traversal, {hit("command_injection", "uri")} AS has_command_injection, is_blocked::INT AS label
FROM texts"""


@query("read_audit_text", TEXT_SQL)
def read_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "audit-text")
    text_blocks(spark, sf_dir).select("value").write.text(path)
    return tx.read_audit_text(spark, path)


@query("read_audit_text_dir", TEXT_SQL)
def read_text_dir_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into three date folders."""
    base = scratch_path(spark, "audit-text-dir")
    blocks = text_blocks(spark, sf_dir)
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        part = blocks.where((F.col("ts") >= low) & (F.col("ts") < high)).select("value")
        part.write.text(f"{base}/{low}/modsec_audit.anon.log")
    return tx.read_audit_text_dir(spark, base)


@query(
    "read_dataset",
    f"""WITH {FEATURE_CTE} SELECT {FLAT_COLUMNS}, {FLAGS},
    CASE WHEN event_id % 2 = 0 THEN '2024-01-05' ELSE '6-Jan-2024' END AS source_date FROM feat""",
)
def read_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with JSON logs in one date folder and CSV tables in another."""
    base = scratch_path(spark, "dataset")
    audit_log(spark, sf_dir).where("event_id % 2 = 0").select("tx.*").write.json(f"{base}/2024-01-05/site")
    ds.write_dataset(feature_rows(spark, sf_dir).where("event_id % 2 = 1"), f"{base}/6-Jan-2024")
    kinds = feature_rows(spark, sf_dir).select(*EVENT_COLUMNS).schema
    rows = ds.read_dataset(spark, base, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds))
    texts = [f.name for f in kinds if f.dataType.simpleString() == "string"]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


# Paths are made of what the documents say: source as folder, language as file name.
PATH_SQL = """CASE lang WHEN 'en' THEN CASE WHEN n_chars > 4000 THEN 'audit.log' ELSE source || '/audit.log' END
  WHEN 'de' THEN source || CASE WHEN n_chars > 1500 THEN '/modsec_audit.json' ELSE '/events.json' END
  WHEN 'fr' THEN source || '/' || lang || '/audit.json' ELSE source || '.json' || CASE WHEN n_chars > 1500 THEN '.bak' ELSE '' END END"""


@query(
    "source_filter",
    f"""SELECT doc_id, path FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)
    WHERE path IN ('audit.log', 'audit.json') OR regexp_full_match(path, '[^/]*\\.json|[^/]*/(audit\\.log|audit\\.json|modsec_audit\\.json)')""",
)
def source_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH_SQL).alias("path")).where(ds.source_filter(F.col("path")))


@query(
    "read_labeled_csv",
    f"""WITH {LABELED_CTE}, quoted AS (SELECT * REPLACE (uri_full || ' "q", "' AS uri_full) FROM csv) SELECT {PREPARED} FROM quoted""",
)
def labeled_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files with the columns in different order, and quotes and commas in a text."""
    path = scratch_path(spark, "labeled-csv")
    rows = labeled_rows(spark, sf_dir).withColumn("uri_full", F.concat("uri_full", F.lit(' "q", "')))
    order = ["ip", "method", "uri_full", "uri_norm", "timestamp", "status", "label", "attack_tags", "anomaly_score"]
    for half, columns in ((0, order), (1, order[::-1])):
        part = rows.where(F.col("event_id") % 2 == half).select(*columns)
        part.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return ds.read_labeled_csv(spark, path)


@query(
    "write_event_store",
    f"""WITH {TYPED_CTE} SELECT event_id, date_trunc('second', ts) AS timestamp, nullif(user_agent, '') AS user_agent, nullif(rule_id, '') AS rule_id,
    status, bytes_sent, is_blocked::INT AS is_blocked, rule_count, {FLAGS}, prediction AS model_prediction, final_probability AS model_probability
    FROM decided""",
)
def event_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second written twice, read back."""
    path = scratch_path(spark, "event-store")
    rows = decided_rows(spark, sf_dir)
    for batch_id, low, high in ((0, "2000-01-01", "2024-01-16"), (1, "2024-01-16", "2100-01-01"), (1, "2024-01-16", "2100-01-01")):
        ds.write_event_store(rows.where((F.col("ts") >= low) & (F.col("ts") < high)), path, batch_id)
    stored = ds.read_store(spark, path)
    flags = [c for c in stored.columns if c.startswith("has_") or c.startswith("missing_")]
    return stored.select(
        "event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "user_agent", "rule_id", "status", "bytes_sent",
        "is_blocked", "rule_count", *flags, "model_prediction", F.col("model_probability").cast("double").alias("model_probability"),
    )


@query(
    "write_attack_store",
    f"""WITH {TYPED_CTE} SELECT sha256(id::VARCHAR) AS id, id AS event_id, date_trunc('second', detected_at) AS detected_at, attack_type, probability,
    attack_url, attacker_ip FROM attacks""",
)
def attack_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "attack-store")
    ds.write_attack_store(decided_rows(spark, sf_dir), path)
    return ds.read_store(spark, path).withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))


@query(
    "write_predictions",
    f"""WITH {TYPED_CTE} SELECT count(*) AS total_logs, count(*) FILTER (prediction = 0) AS normal_count,
    count(*) FILTER (prediction = 1) AS attack_count, round(sum(final_probability), 4)::DOUBLE AS total_probability FROM decided""",
)
def predictions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored CSV read back and counted."""
    path = scratch_path(spark, "predictions")
    scored = decided_rows(spark, sf_dir).select("event_id", "method", "uri", "probability", "prediction")
    ds.write_predictions(scored, path)
    back = ds.read_csv(spark, path, "event_id BIGINT, method STRING, uri STRING, probability DOUBLE, prediction INT")
    total = F.round(F.sum("probability"), 4).alias("total_probability")
    return back.agg(
        F.count("*").alias("total_logs"), F.count_if(F.col("prediction") == 0).alias("normal_count"),
        F.count_if(F.col("prediction") == 1).alias("attack_count"), total,
    )


@query(
    "write_dataset",
    f"""WITH {FEATURE_CTE}, broken AS (SELECT * REPLACE (CASE WHEN event_id % 6 = 0 THEN msg || chr(10) || '\\n,"' || chr(13) ELSE msg END AS msg) FROM feat)
    SELECT {FLAT_COLUMNS}, {FLAGS} FROM broken""",
)
def write_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back; some messages hold line breaks, quotes and backslashes."""
    path = scratch_path(spark, "events-csv")
    broken = F.when(F.col("event_id") % 6 == 0, F.concat("msg", F.lit('\n\\n,"\r'))).otherwise(F.col("msg"))
    rows = feature_rows(spark, sf_dir).withColumn("msg", broken)
    ds.write_dataset(rows, path)
    schema = rows.select(*EVENT_COLUMNS).schema
    back = ds.read_csv(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), breaks=True)
    texts = [f.name for f in schema if f.dataType.simpleString() == "string"]
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


