"""Queries: summaries, attack history, joins, exports, cool-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators import attack as at
from wardlog.operators import joins as jn
from wardlog.operators import metrics as mt
from wardlog.operators import labels as lb
from wardlog.operators import ranking as rk
from wardlog.operators import reports as rp
from wardlog.operators.cooldown import alert_cooldown
from wardlog.plans.driver_log import AUDIT_CTE, audit_log, demo_probability
from wardlog.plans.flat_sql import FEATURE_CTE, FLAGS, TYPED_CTE
from wardlog.plans.frames import attack_rows, decided_rows, feature_rows
from wardlog.plans.registry import query, table

LOG_TYPES_CTE = f"""{AUDIT_CTE},
logged AS (
  SELECT *, list_distinct([CASE r WHEN '942100' THEN 'SQLi' WHEN '941100' THEN 'XSS' WHEN '930120' THEN 'LFI'
      WHEN '932160' THEN 'RCE' ELSE 'Other (' || r || ')' END
      for r in rules if r NOT IN ('920350', '949110', '980130')]) AS log_types
  FROM audit
)"""


def pct(part: str, whole: str) -> str:
    return f"round(coalesce({part} * 100.0::DOUBLE / nullif({whole}, 0), 0), 6)::DOUBLE"


@query(
    "log_summary",
    f"""WITH {LOG_TYPES_CTE}, s AS (SELECT count(*) AS total, count(*) FILTER (len(log_types) = 0) AS normal,
      count(*) FILTER (len(log_types) > 0) AS malicious FROM logged)
    SELECT total, normal, malicious, {pct("normal", "total")} AS normal_pct, {pct("malicious", "total")} AS malicious_pct FROM s""",
)
def log_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.log_summary(audit_log(spark, sf_dir, "messages"))


@query(
    "attack_type_counts",
    f"""WITH {LOG_TYPES_CTE} SELECT attack_type, count(*) AS transactions
    FROM (SELECT unnest(log_types) AS attack_type FROM logged) GROUP BY 1""",
)
def attack_type_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.attack_type_counts(audit_log(spark, sf_dir, "messages"))


RULE_NAME = """CASE rule_id WHEN '942100' THEN 'SQLi' WHEN '941100' THEN 'XSS' WHEN '930120' THEN 'LFI' WHEN '932160' THEN 'RCE'
  WHEN '949110' THEN 'Anomaly Threshold' WHEN '920350' THEN 'Protocol' END"""


@query(
    "rule_counts",
    f"""WITH {AUDIT_CTE} SELECT rule_id, count(*) AS hits, coalesce({RULE_NAME}, 'Unknown') AS category
    FROM (SELECT unnest(rules) AS rule_id FROM audit) WHERE rule_id NOT IN ('', '920350') GROUP BY rule_id""",
)
def rule_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.rule_counts(audit_log(spark, sf_dir, "messages"))


@query(
    "rule_category_join",
    f"""WITH {AUDIT_CTE} SELECT event_id, rule_id, coalesce({RULE_NAME}, 'Other (' || rule_id || ')') AS category
    FROM (SELECT event_id, unnest(rules) AS rule_id FROM audit) WHERE rule_id <> ''""",
)
def rule_category_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at.explode_rules(audit_log(spark, sf_dir, "messages").select("event_id", "tx"))
    return at.rule_category_join(rows.drop("tx")).select("event_id", "rule_id", "category")


VALUES = {
    "top_uris": ("uri", "tx.request.uri", "uri", 10),
    "top_ips": ("client_ip", "tx.client_ip", "client_ip", 10),
    "method_counts": ("method", "tx.request.method", "method", None),
    "status_counts": ("status", "tx.response.http_code", "status::VARCHAR", None),
}


def _register_values(name: str) -> None:
    column, field, sql, top = VALUES[name]
    order = f" ORDER BY n DESC, {column} LIMIT {top}" if top else ""

    @query(name, f"WITH {AUDIT_CTE} SELECT {sql} AS {column}, count(*) AS n FROM audit GROUP BY 1{order}")
    def values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return at.value_counts(audit_log(spark, sf_dir, field.split(".")[1]), at.log_value(F.col(field)), column, top)


for _name in VALUES:
    _register_values(_name)


@query("attack_type_of_event", f"WITH {TYPED_CTE} SELECT event_id, attack_type FROM attack_typed")
def attack_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir)
    return rows.select("event_id", at.attack_type_of_event(F.col("tx.messages")).alias("attack_type"))


@query(
    "attack_window_counts",
    f"""WITH {TYPED_CTE}, m AS (SELECT max(detected_at) AS now FROM attacks)
    SELECT count(*) AS total_attacks, count(*) FILTER (detected_at >= date_trunc('day', now)) AS attacks_today,
      count(*) FILTER (detected_at >= now - INTERVAL 7 DAY) AS attacks_last_7_days,
      count(*) FILTER (detected_at >= now - INTERVAL 30 DAY) AS attacks_last_30_days FROM attacks, m""",
)
def window_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.attack_window_counts(attack_rows(spark, sf_dir))


@query(
    "top_attack_type",
    f"WITH {TYPED_CTE} SELECT attack_type, count(*) AS total FROM attacks GROUP BY 1 ORDER BY total DESC, attack_type LIMIT 1",
)
def top_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_attack_type(attack_rows(spark, sf_dir))


@query(
    "top_attacker_ip",
    f"WITH {TYPED_CTE} SELECT attacker_ip, count(*) AS total FROM attacks GROUP BY 1 ORDER BY total DESC, attacker_ip LIMIT 1",
)
def top_ip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_attacker_ip(attack_rows(spark, sf_dir))


@query(
    "recent_attacks",
    f"""WITH {TYPED_CTE} SELECT id, strftime(detected_at + INTERVAL 7 HOUR, '%Y/%m/%d %H:%M') || ' WIB' AS detected_local,
    attack_type, printf('%.1f%%', probability * 100) AS probability,
    CASE WHEN length(attack_url) > 46 THEN left(attack_url, 43) || '...' ELSE attack_url END AS attack_url
    FROM attacks ORDER BY detected_at DESC, id DESC LIMIT 5""",
)
def recent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.attack_history(attack_rows(spark, sf_dir))


@query(
    "status_metrics",
    f"""WITH {TYPED_CTE}, m AS (SELECT max(detected_at) AS now FROM attacks)
    SELECT (SELECT count(*) FROM events) AS overall_logs, count(*) AS attack_logs,
      (SELECT attack_type FROM attacks GROUP BY 1 ORDER BY count(*) DESC, attack_type LIMIT 1) AS most_attack_type,
      count(*) FILTER (detected_at >= date_trunc('day', now)) AS attacks_today,
      count(*) FILTER (detected_at >= now - INTERVAL 7 DAY) AS attacks_last_week,
      count(*) FILTER (detected_at >= now - INTERVAL 30 DAY) AS attacks_last_month FROM attacks, m""",
)
def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.status_metrics(audit_log(spark, sf_dir), attack_rows(spark, sf_dir))


@query(
    "scoring_summary",
    f"""WITH {TYPED_CTE} SELECT count(*) AS total_logs, count(*) FILTER (prediction = 0) AS normal_count,
    count(*) FILTER (prediction = 1) AS attack_count, {pct("count(*) FILTER (prediction = 1)", "count(*)")} AS attack_percentage
    FROM decided""",
)
def scoring_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.scoring_summary(decided_rows(spark, sf_dir))


PERIOD_SQL = f"""WITH {TYPED_CTE},
logs AS (SELECT date_trunc('hour', ts) AS period_start, CASE WHEN prediction = 1 THEN attack_type END AS attack_type FROM decided),
by_type AS (SELECT period_start, attack_type, count(*) AS n FROM logs WHERE attack_type IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY n DESC, attack_type) AS place FROM by_type),
best AS (SELECT period_start, string_agg(attack_type || '=' || n, '; ' ORDER BY place) AS top_attacks FROM ranked WHERE place <= 5 GROUP BY 1),
totals AS (SELECT period_start, count(*) AS total_logs, count(attack_type) AS attack_count FROM logs GROUP BY 1)"""


@query(
    "period_summary",
    f"""{PERIOD_SQL} SELECT period_start, total_logs, attack_count, {pct("attack_count", "total_logs")} AS attack_rate,
    coalesce(top_attacks, '') AS top_attacks FROM totals LEFT JOIN best USING (period_start)""",
)
def period_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided_rows(spark, sf_dir).select("ts", F.when(F.col("prediction") == 1, F.col("attack_type")).alias("attack_type"))
    return rp.period_summary(rows).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(
    "batch_max_severity",
    f"""WITH {TYPED_CTE}, b AS (
      SELECT event_id // 100 AS batch, event_id, method, uri,
        CASE WHEN final_probability < 0.6 THEN 'low' WHEN final_probability < 0.8 THEN 'medium' ELSE 'high' END AS band,
        row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS place
      FROM decided WHERE prediction = 1)
    SELECT batch, count(*) AS attack_count,
      CASE max(CASE band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
      string_agg(method || ' ' || uri || ' (' || upper(band) || ')', chr(10) ORDER BY place) FILTER (place <= 3) AS top_lines
    FROM b GROUP BY batch""",
)
def batch_severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 100).cast("bigint"))
    return rp.batch_max_severity(rows, "batch", ["event_id"])


# Decisions.
@query(
    "apply_threshold",
    """SELECT event_id, p AS probability, (p >= 0.45)::INT AS prediction, CASE WHEN p >= 0.45 THEN 'ATTACK' ELSE 'NORMAL' END AS decision
    FROM (SELECT event_id, (event_id * 7919 % 100000) / 100000.0::DOUBLE AS p FROM events)""",
)
def threshold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", demo_probability().alias("probability"))
    rows = rows.withColumn("prediction", S.apply_threshold(F.col("probability"), 0.45))
    return rows.withColumn("decision", S.decision(F.col("prediction")))


@query(
    "cve_override",
    f"WITH {TYPED_CTE} SELECT event_id, override_hit, final_probability AS probability, prediction FROM decided",
)
def override_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = S.override_hit(F.col("has_cve_2023_47271_upload"), F.col("has_cve_2023_47271_rce"))
    return decided_rows(spark, sf_dir).select("event_id", hit.alias("override_hit"), "probability", "prediction")


@query(
    "severity_band",
    """SELECT event_id, CASE WHEN p < 0.6 THEN 'low' WHEN p < 0.8 THEN 'medium' ELSE 'high' END AS pipeline_band,
    CASE WHEN p < 0.5 THEN 'normal' WHEN p < 0.7 THEN 'low' WHEN p < 0.85 THEN 'medium' ELSE 'high' END AS api_band
    FROM (SELECT event_id, (event_id * 7919 % 100000) / 100000.0::DOUBLE AS p FROM events)""",
)
def band_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo_probability()
    return table(spark, sf_dir, "events").select(
        "event_id",
        S.severity_band(p).alias("pipeline_band"),
        S.severity_band(p, S.apply_threshold(p), "api").alias("api_band"),
    )


@query(
    "confidence",
    """SELECT event_id, greatest(p, 1 - p) AS confidence, printf('%.1f%%', p * 100) AS shown
    FROM (SELECT event_id, (event_id * 7919 % 100000) / 100000.0::DOUBLE AS p FROM events)""",
)
def confidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo_probability()
    return table(spark, sf_dir, "events").select(
        "event_id", S.confidence(p).alias("confidence"), S.format_probability(p).alias("shown")
    )


# Feedback, audience, deliveries.
def attack_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attack per event with a stand-in probability of at least one half."""
    return (
        table(spark, sf_dir, "events")
        .where(demo_probability() >= 0.5)
        .select("event_id", (F.col("event_id") + 1000000).alias("attack_event_id"), demo_probability().alias("probability"))
    )


LINKS = """links AS (SELECT event_id, event_id + 1000000 AS attack_event_id, (event_id * 7919 % 100000) / 100000.0::DOUBLE AS probability
  FROM events WHERE (event_id * 7919 % 100000) / 100000.0::DOUBLE >= 0.5)"""


@query("link_attack_events", f"WITH {LINKS} SELECT event_id, user_id, attack_event_id FROM events LEFT JOIN links USING (event_id)")
def link_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return jn.link_attack_events(events, attack_links(spark, sf_dir))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback: two clicks on every eleventh event's attack, with different times and answers."""
    base = table(spark, sf_dir, "events").where("event_id % 11 = 0")
    eid = F.col("event_id")
    answers = [("attack_yes", 0, eid % 2 == 0), ("attack_no", 1, eid % 2 == 1)]
    first, second = (
        base.select(
            (eid + 1000000).alias("attack_event_id"),
            (eid * 2 + n).alias("click_id"),
            F.when(late, F.timestamp_add("HOUR", F.lit(2), F.col("ts").cast("timestamp")))
            .otherwise(F.timestamp_add("HOUR", F.lit(1), F.col("ts").cast("timestamp")))
            .alias("clicked_at"),
            F.lit(action).alias("action"),
        )
        for action, n, late in answers
    )
    return first.unionByName(second)


CLICKS = """clicks AS (
  SELECT event_id + 1000000 AS attack_event_id, event_id * 2 AS click_id, 'attack_yes' AS action,
    ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS clicked_at FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT event_id + 1000000, event_id * 2 + 1, 'attack_no',
    ts + CASE WHEN event_id % 2 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END FROM events WHERE event_id % 11 = 0),
last_click AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attack_event_id ORDER BY clicked_at DESC, click_id DESC) AS rn
  FROM clicks) WHERE rn = 1)"""


@query(
    "dedup_latest_feedback",
    f"WITH {CLICKS} SELECT attack_event_id, clicked_at, click_id, action FROM last_click",
)
def latest_feedback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.dedup_latest_feedback(clicks(spark, sf_dir)).withColumn("clicked_at", F.col("clicked_at").cast("timestamp_ntz"))


@query(
    "apply_feedback",
    f"""WITH {LINKS}, {CLICKS} SELECT event_id, user_id, l.attack_event_id, CASE action WHEN 'attack_yes' THEN 'yes' WHEN 'attack_no' THEN 'no' END AS assessment,
    CASE WHEN action = 'attack_no' THEN 0 END::INT AS human_label, CASE WHEN action = 'attack_no' THEN 'telegram' END AS label_source,
    CASE WHEN action = 'attack_no' THEN clicked_at END AS labeled_at
    FROM events LEFT JOIN links l USING (event_id) LEFT JOIN last_click c ON c.attack_event_id = l.attack_event_id""",
)
def feedback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    linked = jn.link_attack_events(events, attack_links(spark, sf_dir))
    return jn.apply_feedback(linked, clicks(spark, sf_dir)).withColumn("labeled_at", F.col("labeled_at").cast("timestamp_ntz"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand in for subscribers."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("telegram_chat_id"),
        F.col("s_name").alias("email"),
        F.when(key % 5 != 0, 0.8 + (key % 40) / F.lit(200.0)).alias("min_probability"),
        F.when(key % 3 == 1, F.lit(True)).when(key % 3 == 2, F.lit(False)).alias("is_subscribed"),
        (key % 4 == 0).alias("verified"),
    )


SUBSCRIBERS = """subs AS (SELECT s_suppkey AS telegram_chat_id, s_name AS email,
  coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN 0.8::DOUBLE + (s_suppkey % 40) / 200.0::DOUBLE END, 0.5) AS min_probability
  FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 2)"""


@query(
    "alert_audience",
    f"""WITH {LINKS}, {SUBSCRIBERS} SELECT attack_event_id, probability, telegram_chat_id, min_probability
    FROM links JOIN subs ON probability >= min_probability""",
)
def audience_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = attack_links(spark, sf_dir).select("attack_event_id", "probability")
    return jn.alert_audience(alerts, subscribers(spark, sf_dir)).drop("email")


@query(
    "audience_counts",
    f"""WITH {LINKS}, {SUBSCRIBERS} SELECT attack_event_id, probability, count(telegram_chat_id) AS audience, max(min_probability) AS cutoff
    FROM links LEFT JOIN subs ON probability >= min_probability GROUP BY ALL""",
)
def audience_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = attack_links(spark, sf_dir).select("attack_event_id", "probability")
    return jn.audience_counts(alerts, subscribers(spark, sf_dir))


@query(
    "alerts_without_audience",
    f"""WITH {LINKS}, {SUBSCRIBERS}, picky AS (SELECT * FROM subs WHERE min_probability > 0.5)
    SELECT attack_event_id, probability FROM links l WHERE NOT EXISTS (SELECT 1 FROM picky WHERE l.probability >= min_probability)""",
)
def no_audience_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = attack_links(spark, sf_dir).select("attack_event_id", "probability")
    picky = subscribers(spark, sf_dir).where("min_probability > 0.5")
    return jn.alerts_without_audience(alerts, picky)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery log: two attempts per attack of some events, not all successful."""
    links = attack_links(spark, sf_dir).where("event_id % 3 <> 0")
    tries = F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")
    return links.select("attack_event_id", "event_id", tries).select(
        "attack_event_id", ((F.col("event_id") + F.col("attempt")) % 4 == 0).alias("success")
    )


SENT = f"""{LINKS}, deliveries AS (SELECT attack_event_id, (event_id + attempt) % 4 = 0 AS success
  FROM links, (VALUES (0), (1)) t(attempt) WHERE event_id % 3 <> 0)"""


@query(
    "mark_sent",
    f"""WITH {SENT} SELECT attack_event_id, probability,
    (attack_event_id IN (SELECT attack_event_id FROM deliveries WHERE success))::INT AS is_sent FROM links""",
)
def mark_sent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.mark_sent(attack_links(spark, sf_dir).drop("event_id"), deliveries(spark, sf_dir))


@query(
    "unsent_alerts",
    f"""WITH {SENT} SELECT attack_event_id, probability FROM links
    WHERE attack_event_id NOT IN (SELECT attack_event_id FROM deliveries WHERE success)""",
)
def unsent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.unsent_alerts(attack_links(spark, sf_dir).drop("event_id"), deliveries(spark, sf_dir))


# Alerts with an even event are gated by a flag that is set, odd ones by one that is not.
PAUSED_BY = ("NATION_7", "ATLANTIS")


def pause_state(spark: SparkSession, sf_dir: str, nation: str) -> DataFrame:
    """A pause flag, set when there is a nation of that name."""
    return table(spark, sf_dir, "nation").agg(F.max(F.when(F.col("n_name") == nation, 1).otherwise(0)).alias("v")).select(
        F.lit(jn.PAUSE_KEY).alias("state_key"), F.col("v").cast("string").alias("state_value")
    )


GATE_SQL = f"""WITH {LINKS} SELECT attack_event_id, probability FROM links
  WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = CASE WHEN event_id % 2 = 0 THEN '{PAUSED_BY[0]}' ELSE '{PAUSED_BY[1]}' END)"""


@query("notification_gate", GATE_SQL)
def gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the alerts while paused, the other while not."""
    links = attack_links(spark, sf_dir)
    halves = [
        jn.notification_gate(links.where(F.col("event_id") % 2 == half).drop("event_id"), pause_state(spark, sf_dir, nation))
        for half, nation in enumerate(PAUSED_BY)
    ]
    return halves[0].unionByName(halves[1])


# Training runs: one per nation and customer segment, with metrics from balances.
def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("experiment"),
        key.alias("run_id"),
        key.alias("version"),
        F.timestamp_seconds(1700000000 + (key * 7919) % 1000003).alias("start_time"),
        (0.9 + (key * 31 % 1000) / F.lit(10000.0)).alias("accuracy"),
        (0.8 + (key * 17 % 1000) / F.lit(10000.0)).alias("f1_score"),
    )


RUNS = """runs AS (SELECT c_mktsegment AS experiment, c_custkey AS run_id, c_custkey AS version, (c_custkey * 7919) % 1000003 AS started,
  0.9::DOUBLE + (c_custkey * 31 % 1000) / 10000.0::DOUBLE AS accuracy, 0.8::DOUBLE + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS f1_score FROM customer)"""


@query(
    "run_trend",
    f"""WITH {RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY started DESC, run_id DESC) AS position FROM runs)
    SELECT experiment, run_id, position::INT AS position, round(accuracy, 6) AS accuracy,
      round(accuracy - lead(accuracy) OVER (PARTITION BY experiment ORDER BY position), 6) AS accuracy_delta
    FROM (SELECT * FROM p WHERE position <= 5)""",
)
def trend_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jn.run_trend(training_runs(spark, sf_dir), 5)
    return rows.select("experiment", "run_id", "position", F.round("accuracy", 6).alias("accuracy"), "accuracy_delta")


@query(
    "compare_versions",
    f"""WITH {RUNS} SELECT round(a.accuracy, 6) AS accuracy_v1, round(a.f1_score, 6) AS f1_score_v1, round(b.accuracy, 6) AS accuracy_v2,
    round(b.f1_score, 6) AS f1_score_v2, round(b.accuracy - a.accuracy, 6) AS accuracy_gain, round(b.f1_score - a.f1_score, 6) AS f1_score_gain
    FROM runs a, runs b WHERE a.version = 3 AND b.version = 17""",
)
def versions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.compare_versions(training_runs(spark, sf_dir), 3, 17)


# Metric files of the training runs: the metric lies at another depth, under another name, or is missing, by segment.
@query(
    "metric_lookup",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END::DOUBLE AS f1 FROM customer""",
)
def metric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    none = F.lit(None).cast("double")
    deep = F.struct(F.struct(none.alias("f1")).alias("train"), F.array(F.struct(F.struct(value.alias("f1_score"), F.lit(-1.0).alias("auc")).alias("test"))).alias("parts"))
    text = (
        F.when(segment == "BUILDING", F.to_json(F.struct(F.struct(value.alias("auc")).alias("test"))))
        .when(segment == "MACHINERY", F.to_json(F.struct(value.alias("f1"), F.struct(F.lit(-1.0).alias("f1")).alias("old"))))
        .otherwise(F.to_json(deep, {"ignoreNullFields": "false"}))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", mt.metric_value(text, "f1_score", "f1").alias("f1"))


# Cool-down: the greedy rule as a recursive query.
@query(
    "alert_cooldown",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 37 <> 5),
    kept AS (
      SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
      UNION ALL
      SELECT k.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 3600 SECOND) AS ts
      FROM kept k WHERE k.ts IS NOT NULL)
    SELECT e.event_id, e.user_id FROM e JOIN kept k ON e.user_id = k.user_id AND e.ts = k.ts""",
)
def cooldown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = F.when(F.col("event_id") % 37 != 5, F.col("ts"))  # some times could not be read
    events = table(spark, sf_dir, "events").select("event_id", "user_id", timed.alias("ts"))
    return alert_cooldown(events, "ts", ["event_id"], "user_id", gap_seconds=3600).select("event_id", "user_id")


# Exports.
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-store rows with holes and human labels."""
    eid = F.col("event_id")
    rows = feature_rows(spark, sf_dir).drop("tx", "label")
    return (
        rows.withColumn("timestamp", S.parse_event_time(F.col("timestamp")))
        .withColumn("is_blocked", F.col("is_blocked").cast("int"))
        .withColumn("user_agent", F.when(eid % 5 != 0, F.col("user_agent")))
        .withColumn("rule_count", F.when(eid % 17 != 0, F.col("rule_count")))
        .withColumn("severity", F.when(eid % 19 != 0, F.col("severity")))
        .withColumn("human_label", F.when(eid % 11 == 0, F.lit(0)).when(eid % 11 == 1, F.lit(1)))
        .withColumnRenamed("event_id", "id")
    )


EXPORT_CTE = f"""{FEATURE_CTE},
stored AS (
  SELECT event_id AS id, date_trunc('second', ts) AS t, source_ip, method, uri, status, bytes_sent, request_time,
    CASE WHEN event_id % 5 <> 0 THEN user_agent END AS user_agent, user_agent_len, uri_len,
    CASE WHEN event_id % 19 <> 0 THEN severity END AS severity, severity_score, rule_id, matched_data, msg, is_blocked::INT AS is_blocked,
    CASE WHEN event_id % 17 <> 0 THEN rule_count END AS rule_count, {FLAGS},
    CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 END::INT AS human_label
  FROM feat),
export AS (
  SELECT id, strftime(t, '%a %b %-d %H:%M:%S %Y') AS timestamp, source_ip, method, uri, status, bytes_sent, request_time,
    coalesce(user_agent, '') AS user_agent, user_agent_len, uri_len, coalesce(severity, 'INFO') AS severity, severity_score, rule_id,
    matched_data, msg, is_blocked, coalesce(rule_count, 0) AS rule_count, {FLAGS},
    CASE WHEN human_label IS NOT NULL THEN human_label WHEN coalesce(rule_count, 0) > 0 THEN 1 ELSE 0 END::INT AS label
  FROM stored)"""


@query("training_export", f"WITH {EXPORT_CTE} SELECT * FROM export")
def training_export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.training_export(stored_events(spark, sf_dir))


@query(
    "labeled_export",
    f"""WITH {EXPORT_CTE} SELECT id, t AS timestamp, source_ip, method, uri, status, bytes_sent, request_time, user_agent, user_agent_len,
    uri_len, severity, severity_score, rule_id, matched_data, msg, is_blocked, rule_count, {FLAGS}, human_label AS label
    FROM stored WHERE human_label IS NOT NULL""",
)
def labeled_export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.labeled_export(stored_events(spark, sf_dir)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("export_first_n", f"WITH {EXPORT_CTE} SELECT * FROM export ORDER BY id LIMIT 100")
def first_n_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.export_first_n(stored_events(spark, sf_dir), 100)


@query("export_last_n", f"WITH {EXPORT_CTE} SELECT * FROM (SELECT * FROM export ORDER BY id DESC LIMIT 100) ORDER BY id")
def last_n_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.export_last_n(stored_events(spark, sf_dir), 100)


@query("export_row_range", f"WITH {EXPORT_CTE} SELECT * FROM export ORDER BY id LIMIT 301 OFFSET 199")
def row_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.export_row_range(stored_events(spark, sf_dir), 200, 500)


@query("sample_rows", "SELECT event_id, event_type, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500")
def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.sample_rows(table(spark, sf_dir, "events"), 500, ["event_id"]).select("event_id", "event_type", "value")


# Merges.
@query(
    "merge_datasets",
    """WITH m AS (SELECT doc_id, lang, source, text, true AS is_blocked FROM documents UNION ALL
      SELECT doc_id, lang, source, text, doc_id % 5 <> 0 FROM documents WHERE n_chars > 400)
    SELECT DISTINCT doc_id, lang, source, md5(text) AS text_md5, is_blocked,
      TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS timestamp FROM m""",
)
def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at_time = F.timestamp_seconds(F.col("doc_id") + 1704067200)
    old = docs.select(
        F.date_format(at_time, "EEE MMM d HH:mm:ss yyyy").alias("timestamp"), "doc_id", "lang", "source", "text", F.lit(True).alias("is_blocked")
    )
    new = docs.where("n_chars > 400").select(
        "text", "source", "lang", (F.col("doc_id") % 5 != 0).cast("int").alias("is_blocked"), "doc_id",
        F.date_format(at_time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
    merged = lb.merge_datasets(old, new)
    return merged.withColumn("text_md5", F.md5("text")).drop("text").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "source_date",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '/raw/' || strftime(o_orderdate, '%Y-%m-%d') || '/audit.log'
        WHEN 'O' THEN '/raw/' || strftime(o_orderdate, '%d-%b-%Y') || '/x/log_' || strftime(o_orderdate, '%Y%m%d') || '.json'
        ELSE '/raw/' || strftime(o_orderdate, '%d-%b-%Y') || '/' || o_orderpriority || '.log' END AS path,
      CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d-%b-%Y') END AS source_date FROM orders""",
)
def source_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that orders would have: date, status and priority decide folder and file name."""
    day, named, digits = (F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "dd-MMM-yyyy", "yyyyMMdd"))
    status = F.col("o_orderstatus")
    path = (
        F.when(status == "F", F.concat(F.lit("/raw/"), day, F.lit("/audit.log")))
        .when(status == "O", F.concat(F.lit("/raw/"), named, F.lit("/x/log_"), digits, F.lit(".json")))
        .otherwise(F.concat(F.lit("/raw/"), named, F.lit("/"), "o_orderpriority", F.lit(".log")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return rows.withColumn("source_date", lb.source_date(F.col("path")))


@query(
    "union_sources",
    """SELECT doc_id AS id, lang, NULL AS url, '2026-01-01' AS source_date FROM documents
    UNION ALL SELECT page_id, NULL, url, '2026-01-02' FROM pages""",
)
def union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("2026-01-01").alias("source_date"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("2026-01-02").alias("source_date"))
    return lb.union_sources(docs, pages)

