"""SQL of the flat event row and its flags, for the checks."""

from __future__ import annotations

from wardlog.functions.patterns import alternation
from wardlog.plans.driver_log import AUDIT_CTE


def hit(family: str, text: str) -> str:
    """1 where a family matches a text."""
    pattern = alternation(family).replace("'", "''")
    return f"regexp_matches({text}, '{pattern}', 'i')::INT"


def no_index(text: str) -> str:
    return f"replace(replace({text}, '/index.php', ''), 'index.php', '')"


def no_index_any_case(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '/index\\.php', '', 'gi'), 'index\\.php', '', 'gi')"


FLAT_CTE = (
    AUDIT_CTE
    + """,
scored AS (
  SELECT *, [CASE m.severity WHEN 'CRITICAL' THEN 4 WHEN '2' THEN 2 WHEN 'WARNING' THEN 2 WHEN '9' THEN 5 ELSE 0 END
             for m in messages] AS scores
  FROM audit
),
flat AS (
  SELECT event_id, ts, user_id, probability, messages, rules, titled,
    time_stamp AS timestamp, client_ip AS source_ip, method, uri, status, length(props)::BIGINT AS bytes_sent,
    0.0::DOUBLE AS request_time, user_agent, length(user_agent)::INT AS user_agent_len, length(uri)::INT AS uri_len,
    CASE WHEN coalesce(list_max(scores), 0) > 0 THEN messages[list_position(scores, list_max(scores))].severity
         ELSE 'INFO' END AS severity,
    coalesce(list_max(scores), 0)::INT AS severity_score,
    coalesce([r for r in rules if r <> ''][-1], '') AS rule_id,
    coalesce(array_to_string([m.data for m in messages if m.data <> ''], ' | '), '') AS matched_data,
    coalesce(array_to_string([m.message for m in messages], ' | '), '') AS msg,
    len(messages) > 0 AS is_blocked, len(messages)::INT AS rule_count, (len(messages) > 0)::INT AS label,
    CASE WHEN titled THEN host ELSE '' END AS host_h, CASE WHEN titled THEN referer ELSE '' END AS referer_h,
    agent, host, referer
  FROM scored
)
"""
)

FLAT_COLUMNS = """timestamp, source_ip, method, uri, status, bytes_sent, request_time, user_agent, user_agent_len, uri_len,
  severity, severity_score, rule_id, matched_data, msg, is_blocked, rule_count, label"""

FEATURE_CTE = (
    FLAT_CTE
    + f""",
texts AS (SELECT *, uri || ' ' || msg || ' ' || matched_data AS full_text FROM flat),
feat AS (
  SELECT *,
    {hit("sqli", "full_text")} AS has_sqli,
    {hit("xss", "full_text")} AS has_xss,
    {hit("suspicious_path", "uri")} AS has_suspicious_path,
    {hit("path_traversal", "uri")} AS has_path_traversal,
    {hit("command_injection", "uri")} AS has_command_injection,
    {hit("host_header_xss", "host_h")} AS has_cve_2022_24181,
    {hit("xml_upload_name", no_index("full_text"))} AS has_cve_2023_47271_upload,
    {hit("uploaded_php_access", "uri")} AS has_cve_2023_47271_rce,
    (upper(method) = 'POST' AND {hit("csrf_token", "full_text")} = 0)::INT AS missing_csrf_token,
    (upper(method) = 'POST' AND referer_h IN ('', '-'))::INT AS has_suspicious_referer,
    {hit("xss", "full_text")} * {hit("privesc", "full_text")} AS has_cve_2024_xss_privesc,
    {hit("privesc", "full_text")} AS has_privesc_attempt,
    greatest({hit("executable_ext", no_index("uri"))}, {hit("upload_bypass", no_index("uri"))}) AS has_cve_2021_32626
  FROM texts
)
"""
)
FLAGS = """has_sqli, has_xss, has_suspicious_path, has_path_traversal, has_command_injection, has_cve_2022_24181,
  has_cve_2023_47271_upload, has_cve_2023_47271_rce, missing_csrf_token, has_suspicious_referer,
  has_cve_2024_xss_privesc, has_privesc_attempt, has_cve_2021_32626"""

# Types per event: rules first, then flags, as sorted text.
TYPE_OF_RULE = """CASE WHEN {r} = '942100' THEN 'SQLi' WHEN {r} = '941100' THEN 'XSS' WHEN {r} = '920350' THEN 'Protocol'
  WHEN {r} = '930120' THEN 'LFI' WHEN {r} = '932160' THEN 'RCE' WHEN {r} = '949110' THEN 'Anomaly Threshold' END"""

TYPED_CTE = (
    FEATURE_CTE
    + f""",
typed AS (
  SELECT *, list_distinct([x for x in [{TYPE_OF_RULE.format(r="r")} for r in rules]
      || [CASE WHEN has_cve_2023_47271_upload = 1 THEN 'Upload' END, CASE WHEN has_cve_2023_47271_rce = 1 THEN 'RCE' END,
          CASE WHEN has_cve_2022_24181 = 1 THEN 'XSS' END,
          CASE WHEN has_cve_2021_32626 = 1 AND has_cve_2023_47271_upload = 0 AND has_cve_2023_47271_rce = 0 THEN 'RCE' END,
          CASE WHEN has_cve_2024_xss_privesc = 1 THEN 'XSS PrivEsc' END, CASE WHEN has_sqli = 1 THEN 'SQLi' END,
          CASE WHEN has_xss = 1 THEN 'XSS' END, CASE WHEN has_path_traversal = 1 THEN 'Path Traversal' END,
          CASE WHEN has_command_injection = 1 THEN 'RCE' END]
      if x IS NOT NULL AND x <> 'Anomaly Threshold']) AS types
  FROM feat
),
attack_typed AS (
  SELECT *, CASE WHEN len(types) = 0 THEN 'unknown' ELSE array_to_string(list_sort(types), ', ') END AS attack_type
  FROM typed
),
decided AS (
  SELECT *, (has_cve_2023_47271_upload = 1 OR has_cve_2023_47271_rce = 1) AS override_hit,
    CASE WHEN has_cve_2023_47271_upload = 1 OR has_cve_2023_47271_rce = 1 THEN greatest(probability, 0.99)
         ELSE probability END AS final_probability,
    (probability >= 0.5 OR has_cve_2023_47271_upload = 1 OR has_cve_2023_47271_rce = 1)::INT AS prediction
  FROM attack_typed
),
attacks AS (
  SELECT event_id AS id, ts AS detected_at, attack_type, final_probability AS probability, uri AS attack_url,
    source_ip AS attacker_ip
  FROM decided WHERE prediction = 1
)
"""
)
