"""The audit log derived from the `events` table, in Spark and as SQL for the checks.

The driver tables hold no HTTP traffic, so every event becomes one transaction. The Spark side
renders real log lines (JSON or sectioned text), which then take the normal reading path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.plans.registry import table
from wardlog.session import stage
from wardlog.sources.audit_json import good_transactions

# One row per event_id % 24: uri, user agent, host, referer. Twelve benign, twelve hostile.
PAYLOADS = [
    ("/index.php/journal/index", "Mozilla/5.0 (X11; Linux)", "journal.example", "https://journal.example/"),
    ("/index.php/journal/about", "Mozilla/5.0 (Macintosh)", "journal.example", "-"),
    ("/index.php/journal/user/register", "client", "journal.example", "https://journal.example/"),
    ("/index.php/journal/login/signIn", "", "journal.example", ""),
    ("/index.php/journal/search?q=water+quality", "Mozilla/5.0", "journal.example", "https://search.example/?q=1"),
    ("/index.php/journal/article/view/12/7", "Wget/1.21 wget http", "journal.example", ""),
    ("/public/journals/1/cover_issue_3_en.jpg", "Mozilla/5.0", "journal.example", "-"),
    ("/index.php/journal/search?q=%C3%A9tude%20a%zz", "Mozilla/5.0", "journal.example", ""),
    ("/index.php/journal/search?q=étude", "Mozilla/5.0 é", "journal.example", ""),
    ("/index.php/journal/management/importexport/plugin/Native/uploadImportXML", "Mozilla/5.0", "journal.example", "-"),
    ("/index.php/journal/submit?csrfToken=ab12", "client", "journal.example", "https://journal.example/"),
    ("/index.php/journal/$$$call$$$/wizard/uploadFile?stage=1", "Mozilla/5.0", "journal.example", "-"),
    ("/index.php/press/catalog/list?series=7' or 'b'='b", "Opera/9", "press.example", ""),
    ("/index.php/press/note/add?body=<ScRiPt>confirm(document.title)</sCrIpT>", "Opera/9", "press.example", ""),
    ("/wp-admin/setup.php?x=1", "scanner", "journal.example", "-"),
    ("/index.php/press/issue/galley?name=../../conf/..%2f..%2fetc/passwd", "Opera/9", "press.example", ""),
    ("/cgi-bin/test?x=1; cat /etc/hosts|bash", "curl/8", "journal.example", "-"),
    ("/index.php/journal/index", "Mozilla/5.0", "\"><script>alert(1)</script>", ""),
    ("/index.php/journal/user/profile?role_id=1&bio=<img src=x onerror=alert(1)>", "qt", "journal.example", ""),
    ("/files/avatar.php.jpg", "qt", "journal.example", "-"),
    ("/public/journals/1/shell-178.PHTML?cacheBust=17", "qt", "journal.example", ""),
    ("/index.php/journal/search?q=%3Cscript%3Ealert%281%29%3C%2Fscript%3E+union+select", "qt", "journal.example", ""),
    ("/index.php/press/search?term=%2527%2520or%25202%253D2%2520--", "Opera/9", "press.example", ""),
    ("/index.php/journal/users?sort=1%20UNION%20SELECT%20password--", "sqlmap", "journal.example", "-"),
]
SEVERITIES = ["CRITICAL", "2", "WARNING", "", "bogus", "9"]
#: Events that a file of the log holds about, so that files grow in number and not in size.
FILE_EVENTS = 250_000


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _pick(position: int) -> str:
    return _list([row[position] for row in PAYLOADS]) + "[(event_id % 24 + 1)::INT]"


# The same log as flat SQL columns, with `messages` as a list of structs.
AUDIT_CTE = f"""
raw_log AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(ts, '%a %b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y') END AS time_stamp,
    '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS client_ip,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'get' WHEN 'error' THEN 'PUT' ELSE 'POST' END AS method,
    {_pick(0)} AS uri, {_pick(1)} AS agent, {_pick(2)} AS host, {_pick(3)} AS referer,
    event_id % 3 <> 0 AS titled,
    CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 302 ELSE 200 END AS status,
    CASE event_id % 7 WHEN 2 THEN ['942100'] WHEN 3 THEN ['941100', '949110'] WHEN 4 THEN ['920350']
      WHEN 5 THEN ['930120', '932160'] WHEN 6 THEN ['999999'] ELSE []::VARCHAR[] END
      || CASE WHEN event_id % 7 > 1 AND event_id % 13 = 0 THEN [''] ELSE []::VARCHAR[] END AS rules,
    (event_id * 7919 % 100000) / 100000.0::DOUBLE AS probability
  FROM events
),
audit AS (
  SELECT *,
    [{{'ruleId': rules[i], 'severity': {_list(SEVERITIES)}[((event_id + i - 1) % 6 + 1)::INT],
       'message': 'Rule ' || rules[i] || ' fired',
       'data': CASE WHEN i = 1 THEN 'Matched value ' || (event_id % 10)
                 || CASE WHEN event_id % 9 = 0 THEN ' promote union select' ELSE '' END ELSE '' END}}
     for i in range(1, len(rules) + 1)] AS messages,
    CASE WHEN titled THEN agent ELSE '' END AS user_agent
  FROM raw_log
)
"""


def _choose(position: int) -> Column:
    return F.element_at(F.array(*[F.lit(row[position]) for row in PAYLOADS]), (F.col("event_id") % 24 + 1).cast("int"))


def derived_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """`events` with the fields of one transaction each, made in that many parts or as the table lies."""
    eid = F.col("event_id")
    slot = eid % 7
    rules = (
        F.when(slot == 2, F.array(F.lit("942100")))
        .when(slot == 3, F.array(F.lit("941100"), F.lit("949110")))
        .when(slot == 4, F.array(F.lit("920350")))
        .when(slot == 5, F.array(F.lit("930120"), F.lit("932160")))
        .when(slot == 6, F.array(F.lit("999999")))
        .otherwise(F.array().cast("array<string>"))
    )
    tail = F.when((slot > 1) & (eid % 13 == 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    severities = F.array(*[F.lit(s) for s in SEVERITIES])
    ts = F.col("ts").cast("timestamp")
    asctime = F.concat(
        F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy")
    )
    messages = F.transform(
        F.col("rules"),
        lambda rule, i: F.struct(
            F.concat(F.lit("Rule "), rule, F.lit(" fired")).alias("message"),
            F.struct(
                rule.alias("ruleId"),
                F.element_at(severities, ((eid + i) % 6 + 1).cast("int")).alias("severity"),
                F.when(
                    i == 0,
                    F.concat(
                        F.lit("Matched value "),
                        (eid % 10).cast("string"),
                        F.when(eid % 9 == 0, F.lit(" promote union select")).otherwise(F.lit("")),
                    ),
                )
                .otherwise(F.lit(""))
                .alias("data"),
            ).alias("details"),
        ),
    )
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events")
    return (
        (events.repartition(parts) if parts else events)
        .withColumn("ts", ts)
        .withColumn("rules", F.concat(rules, tail))
        .select(
            "event_id",
            "ts",
            "user_id",
            F.when(eid % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(asctime).alias("time_stamp"),
            F.concat(
                F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")
            ).alias("client_ip"),
            F.when(kind == "view", "GET").when(kind == "click", "get").when(kind == "error", "PUT").otherwise("POST").alias("method"),
            _choose(0).alias("uri"),
            _choose(1).alias("agent"),
            _choose(2).alias("host"),
            _choose(3).alias("referer"),
            F.when(kind == "error", 403).when(kind == "signup", 302).otherwise(200).alias("http_code"),
            F.col("props").alias("body"),
            messages.alias("messages"),
        )
    )


def _headers() -> Column:
    """Header map: two spellings, and the three kinds of proxy headers."""
    eid, ip = F.col("event_id"), F.col("client_ip")
    none = F.create_map().cast("map<string,string>")
    titled = F.create_map(F.lit("User-Agent"), F.col("agent"), F.lit("Host"), F.col("host"), F.lit("Referer"), F.col("referer"))
    lower = F.create_map(F.lit("user-agent"), F.col("agent"), F.lit("host"), F.col("host"), F.lit("referer"), F.col("referer"))
    proxy = (
        F.when(eid % 5 == 0, F.create_map(F.lit("X-Real-IP"), F.concat(F.lit("r"), ip)))
        .when(eid % 5 == 1, F.create_map(F.lit("x-real-ip"), F.concat(F.lit("s"), ip)))
        .when(eid % 5 == 2, F.create_map(F.lit("X-Forwarded-For"), F.concat(F.lit(" f"), ip, F.lit(" , 172.16.0.1"))))
        .when(eid % 5 == 3, F.create_map(F.lit("X-Real-IP"), F.lit(""), F.lit("X-Forwarded-For"), F.lit("")))
        .otherwise(none)
    )
    return F.map_concat(F.when(eid % 3 != 0, titled).otherwise(lower), proxy)


# What the proxy headers resolve to, for the checks.
CLIENT_SQL = """CASE event_id % 5 WHEN 0 THEN 'r' || client_ip WHEN 1 THEN 's' || client_ip
  WHEN 2 THEN 'f' || client_ip ELSE client_ip END"""


def render_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The derived log as JSON lines: `event_id`, `ts`, `user_id`, `value`. Every fourth line is unwrapped."""
    tx = F.struct(
        "time_stamp",
        "client_ip",
        F.struct("method", "uri", _headers().alias("headers")).alias("request"),
        F.struct("http_code", "body").alias("response"),
        "messages",
    )
    line = F.when(F.col("event_id") % 4 == 3, F.to_json(tx)).otherwise(F.to_json(F.struct(tx.alias("transaction"))))
    return derived_events(spark, sf_dir, parts).select("event_id", "ts", "user_id", line.alias("value"))


_STAGED: dict[tuple[str, str], DataFrame] = {}


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered log, written once per application to the shared folder, as a log would lie there.

    The narrow events are dealt out before they become lines, so lines are not shuffled.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        files = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "events").count() // FILE_EVENTS))
        _STAGED[key] = stage(render_lines(spark, sf_dir, files), "audit-lines")
    return _STAGED[key]


def audit_log(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The derived log after parsing: `event_id`, `ts`, `user_id`, `tx` with all or the wanted fields."""
    return good_transactions(audit_lines(spark, sf_dir), fields=list(fields) or None)


def demo_probability(event_id: Column | str = "event_id") -> Column:
    """A stand-in model probability used where a check needs the same value in SQL."""
    eid = F.col(event_id) if isinstance(event_id, str) else event_id
    return (eid * 7919 % 100000) / F.lit(100000.0)
