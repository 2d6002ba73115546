"""Audit transactions to flat event rows and feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions import patterns as P
from wardlog.functions import scalars as S
from wardlog.sources.schemas import FLAG_COLUMNS, MESSAGE

SEP = " | "


def _messages(tx: Column) -> Column:
    return F.coalesce(tx["messages"], F.array().cast(f"array<{MESSAGE}>"))


def normalize_transaction(df: DataFrame) -> DataFrame:
    """Canonical nested record of the live path: header spellings resolved, defaults filled.

    The status defaults to 0 here while the flat parser defaults to 200.
    """
    tx = F.col("tx")
    headers = tx["request"]["headers"]
    canonical = F.struct(
        tx["time_stamp"].alias("time_stamp"),
        S.resolve_client_ip(headers, tx["client_ip"]).alias("client_ip"),
        F.struct(
            F.coalesce(tx["request"]["method"], F.lit("GET")).alias("method"),
            F.coalesce(tx["request"]["uri"], F.lit("/")).alias("uri"),
            F.create_map(
                F.lit("User-Agent"),
                S.or_empty(S.first_header(headers, "User-Agent", "user-agent")),
                F.lit("Host"),
                S.or_empty(S.first_header(headers, "Host", "host")),
                F.lit("Referer"),
                S.or_empty(S.first_header(headers, "Referer", "referer")),
            ).alias("headers"),
        ).alias("request"),
        F.struct(
            F.coalesce(tx["response"]["http_code"], F.lit("0")).alias("http_code"),
            S.or_empty(tx["response"]["body"]).alias("body"),
        ).alias("response"),
        _messages(tx).alias("messages"),
    )
    return df.withColumn("tx", canonical)


def flatten_transaction(df: DataFrame) -> DataFrame:
    """Adds the flat event columns (without flags) and the two headers the flags need.

    `rule_id` is the last non-empty one; `severity` belongs to the first message that reaches the
    highest score; label and is_blocked say that at least one rule fired.
    """
    tx = F.col("tx")
    msgs = F.col("_msgs")
    filled = F.filter(msgs, lambda m: m.isNotNull())
    staged = df.withColumn("_msgs", _messages(tx)).withColumn(
        "_scored",
        F.transform(
            F.filter(F.col("_msgs"), lambda m: m["details"].isNotNull()),
            lambda m: F.struct(
                S.severity_score(m["details"]["severity"]).alias("score"),
                S.or_empty(m["details"]["severity"]).alias("severity"),
            ),
        ),
    ).withColumn("severity_score", F.coalesce(F.array_max(F.col("_scored.score")), F.lit(0)))
    top = F.try_element_at(
        F.filter(F.col("_scored"), lambda s: s["score"] == F.col("severity_score")), F.lit(1)
    )["severity"]
    rule_ids = F.filter(F.transform(msgs, lambda m: m["details"]["ruleId"]), lambda r: r != "")
    data = F.filter(F.transform(msgs, lambda m: m["details"]["data"]), lambda d: d != "")
    headers = tx["request"]["headers"]
    return staged.select(
        *df.columns,
        S.or_empty(tx["time_stamp"]).alias("timestamp"),
        F.coalesce(tx["client_ip"], F.lit("0.0.0.0")).alias("source_ip"),
        F.coalesce(tx["request"]["method"], F.lit("GET")).alias("method"),
        F.coalesce(tx["request"]["uri"], F.lit("/")).alias("uri"),
        F.coalesce(tx["response"]["http_code"].try_cast("int"), F.lit(200)).alias("status"),
        F.length(S.or_empty(tx["response"]["body"])).cast("bigint").alias("bytes_sent"),
        F.lit(0.0).alias("request_time"),
        S.or_empty(F.try_element_at(headers, F.lit("User-Agent"))).alias("user_agent"),
        F.length(S.or_empty(F.try_element_at(headers, F.lit("User-Agent")))).alias("user_agent_len"),
        F.length(F.coalesce(tx["request"]["uri"], F.lit("/"))).alias("uri_len"),
        F.when((F.col("severity_score") > 0) & (top != ""), top).otherwise(F.lit("INFO")).alias("severity"),
        "severity_score",
        S.or_empty(F.try_element_at(rule_ids, F.lit(-1))).alias("rule_id"),
        F.array_join(data, SEP).alias("matched_data"),
        F.array_join(F.transform(filled, lambda m: S.or_empty(m["message"])), SEP).alias("msg"),
        (F.size(msgs) > 0).alias("is_blocked"),
        F.size(msgs).alias("rule_count"),
        (F.size(msgs) > 0).cast("int").alias("label"),
        S.or_empty(F.try_element_at(headers, F.lit("Host"))).alias("_host"),
        S.or_empty(F.try_element_at(headers, F.lit("Referer"))).alias("_referer"),
    )


def audit_flags(flat: DataFrame) -> DataFrame:
    """Adds the 13 flags to flat events carrying `_host` and `_referer`. Searches raw text."""
    uri, full = F.col("uri"), F.col("_full")
    staged = (
        flat.withColumn("_full", F.concat_ws(" ", "uri", "msg", "matched_data"))
        .withColumn("_full_low", P.folded(full))
        .withColumn("_uri_low", P.folded(uri))
        .withColumn("_upload_uri", P.without_front_controller(uri))
        .withColumn("_upload_full", P.without_front_controller(full))
        .withColumn("_upload_uri_low", P.folded(F.col("_upload_uri")))
        .withColumn("_upload_full_low", P.folded(F.col("_upload_full")))
        .withColumn("_host_low", P.folded(F.col("_host")))
        .withColumn("_xss", P.matches("xss", full, "_full_low"))
        .withColumn("_privesc", P.matches("privesc", full, "_full_low"))
    )
    is_post = F.upper("method") == "POST"
    flags = {
        "has_sqli": P.matches("sqli", full, "_full_low"),
        "has_xss": F.col("_xss"),
        "has_suspicious_path": P.matches("suspicious_path", uri, "_uri_low"),
        "has_path_traversal": P.matches("path_traversal", uri, "_uri_low"),
        "has_command_injection": P.matches("command_injection", uri, "_uri_low"),
        "has_cve_2022_24181": P.matches("host_header_xss", F.col("_host"), "_host_low"),
        "has_cve_2023_47271_upload": P.matches("xml_upload_name", F.col("_upload_full"), "_upload_full_low"),
        "has_cve_2023_47271_rce": P.matches("uploaded_php_access", uri, "_uri_low"),
        "missing_csrf_token": is_post & ~P.matches("csrf_token", full, "_full_low"),
        "has_suspicious_referer": is_post & F.col("_referer").isin("", "-"),
        "has_cve_2024_xss_privesc": F.col("_xss") & F.col("_privesc"),
        "has_privesc_attempt": F.col("_privesc"),
        "has_cve_2021_32626": P.matches("executable_ext", F.col("_upload_uri"), "_upload_uri_low")
        | P.matches("upload_bypass", F.col("_upload_uri"), "_upload_uri_low"),
    }
    keep = [c for c in flat.columns if c not in ("_host", "_referer", "label")]
    return staged.select(*keep, *[P.flag(flags[name]).alias(name) for name in FLAG_COLUMNS], "label")


def audit_features(df: DataFrame) -> DataFrame:
    """`tx` rows to the complete event row: flat columns, 13 flags, label."""
    return audit_flags(flatten_transaction(df))


def request_features(df: DataFrame, parity: bool = False) -> DataFrame:
    """Feature row of plain requests: searches the decoded URI plus user agent.

    Absent columns take defaults. `parity=True` gives `missing_csrf_token` as the bitwise
    complement (-1/-2) instead of 0/1.
    """
    if "uri" not in df.columns:
        raise ValueError("column 'uri' is required")
    filled = request_defaults(df)
    decoded, full, uri = F.col("_decoded"), F.col("_full"), F.col("uri")
    staged = (
        filled.withColumn("_decoded", S.decode_uri(uri))
        .withColumn("_full", F.concat_ws(" ", "_decoded", "user_agent"))
        .withColumn("_decoded_low", P.folded(decoded))
        .withColumn("_full_low", P.folded(full))
        .withColumn("_uri_low", P.folded(uri))
        .withColumn("_host_low", P.folded(F.col("host_header")))
        .withColumn("_upload_full_low", P.without_front_controller(F.col("_full_low")))
        .withColumn("_xss", P.matches("xss", full, "_full_low"))
        .withColumn("_privesc", P.matches("privesc", full, "_full_low"))
        .withColumn("_exec", P.matches("executable_ext", decoded, "_decoded_low"))
        .withColumn("_bypass", P.matches("upload_bypass", decoded, "_decoded_low"))
    )
    has_token = P.flag(P.matches("csrf_token", full, "_full_low"))
    columns = {
        "user_agent_len": F.length("user_agent"),
        "uri_len": F.length("uri"),
        "has_sqli_pattern": P.flag(P.matches("sqli", full, "_full_low")),
        "has_xss_pattern": P.flag(F.col("_xss")),
        "has_suspicious_path": P.flag(P.matches("suspicious_path", uri, "_uri_low")),
        "has_path_traversal": P.flag(P.matches("path_traversal", decoded, "_decoded_low")),
        "has_command_injection": P.flag(P.matches("command_injection", decoded, "_decoded_low")),
        "has_cve_2022_24181": P.flag(P.matches("host_header_xss", F.col("host_header"), "_host_low")),
        "has_cve_2023_47271_upload": P.flag(
            P.matches("xml_upload_name", P.without_front_controller(full, ignore_case=True), "_upload_full_low")
        ),
        "has_cve_2023_47271_rce": P.flag(P.matches("uploaded_php_access", decoded, "_decoded_low")),
        "missing_csrf_token": F.bitwise_not(has_token) if parity else 1 - has_token,
        "has_suspicious_referer": P.flag(F.col("referer") == "-"),
        "has_cve_2024_xss_privesc": P.flag(F.col("_xss") & F.col("_privesc")),
        "has_privesc_attempt": P.flag(F.col("_privesc")),
        "has_executable_upload": P.flag(F.col("_exec")),
        "has_file_upload_bypass": P.flag(F.col("_bypass")),
        "has_cve_2021_32626": P.flag(F.col("_exec") | F.col("_bypass")),
    }
    passed = [c for c in df.columns if c not in REQUEST_TEXT and c not in REQUEST_NUMBERS and c not in columns]
    return staged.select(
        *passed,
        "method",
        "uri",
        *REQUEST_NUMBERS,
        *[expr.alias(name) for name, expr in columns.items()],
    )


REQUEST_TEXT = {"method": "GET", "uri": "", "user_agent": "", "host_header": "", "referer": ""}
REQUEST_NUMBERS = {
    "status": ("int", 200),
    "bytes_sent": ("bigint", 0),
    "request_time": ("double", 0.0),
    "rule_count": ("int", 0),
    "severity_score": ("double", 0.0),
}


def request_defaults(df: DataFrame) -> DataFrame:
    """Fills absent or NULL request columns; the method is upper-cased."""
    have = set(df.columns)
    text = {
        name: F.coalesce(F.col(name).cast("string"), F.lit("" if name == "method" else default))
        if name in have
        else F.lit(default)
        for name, default in REQUEST_TEXT.items()
    }
    text["method"] = F.upper(text["method"])
    numbers = {
        name: F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)
        for name, (kind, default) in REQUEST_NUMBERS.items()
    }
    return df.withColumns({**text, **numbers})
