"""Schemas of logs, stores and datasets."""

from __future__ import annotations

# Leaves stay text: logs mix numbers and strings, so casting is done per column with try_cast.
_REQUEST = "STRUCT<method: STRING, uri: STRING, headers: MAP<STRING, STRING>>"
_RESPONSE = "STRUCT<http_code: STRING, body: STRING>"
MESSAGE = "STRUCT<message: STRING, details: STRUCT<ruleId: STRING, severity: STRING, data: STRING>>"
_MESSAGES = f"ARRAY<{MESSAGE}>"
FIELDS = [
    ("time_stamp", "STRING"),
    ("client_ip", "STRING"),
    ("request", _REQUEST),
    ("response", _RESPONSE),
    ("messages", _MESSAGES),
]
TX_FIELDS = [name for name, _ in FIELDS]


def transaction_schema(fields: list[str] | None = None) -> str:
    """Schema of a record that is a transaction or wraps one, with the wanted fields alone."""
    wanted = [(name, kind) for name, kind in FIELDS if fields is None or name in fields]
    inner, outer = (", ".join(f"{name}{mark} {kind}" for name, kind in wanted) for mark in (":", ""))
    return f"transaction STRUCT<{inner}>, {outer}"

FLAG_COLUMNS = [
    "has_sqli",
    "has_xss",
    "has_suspicious_path",
    "has_path_traversal",
    "has_command_injection",
    "has_cve_2022_24181",
    "has_cve_2023_47271_upload",
    "has_cve_2023_47271_rce",
    "missing_csrf_token",
    "has_suspicious_referer",
    "has_cve_2024_xss_privesc",
    "has_privesc_attempt",
    "has_cve_2021_32626",
]

BASE_COLUMNS = [
    "timestamp",
    "source_ip",
    "method",
    "uri",
    "status",
    "bytes_sent",
    "request_time",
    "user_agent",
    "user_agent_len",
    "uri_len",
    "severity",
    "severity_score",
    "rule_id",
    "matched_data",
    "msg",
    "is_blocked",
    "rule_count",
]

EVENT_COLUMNS = [*BASE_COLUMNS, *FLAG_COLUMNS, "label"]

TEXT_COLUMNS = ["source_ip", "method", "uri", "user_agent", "severity", "rule_id", "matched_data", "msg"]
INT_COLUMNS = ["status", "bytes_sent", "user_agent_len", "uri_len", "severity_score", "rule_count", *FLAG_COLUMNS]

LABELED_CSV = (
    "ip STRING, method STRING, uri_full STRING, uri_norm STRING, timestamp BIGINT, "
    "status INT, label STRING, attack_tags STRING, anomaly_score DOUBLE"
)

# Numeric inputs of the training pipeline.
NUMERIC_FEATURES = [
    "status",
    "bytes_sent",
    "request_time",
    "user_agent_len",
    "uri_len",
    "has_sqli_pattern",
    "has_xss_pattern",
    "has_suspicious_path",
    "has_path_traversal",
    "has_command_injection",
    "has_cve_2022_24181",
    "has_cve_2023_47271_upload",
    "has_cve_2023_47271_rce",
    "missing_csrf_token",
    "has_suspicious_referer",
    "has_cve_2024_xss_privesc",
    "has_privesc_attempt",
    "has_cve_2021_32626",
]
