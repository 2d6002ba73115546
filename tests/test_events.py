"""JSON and text logs to events, including every odd input."""

import json

import pytest
from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators.attack import attack_type_of_event, log_attack_types
from wardlog.operators.flatten import audit_features, flatten_transaction, normalize_transaction, request_features
from wardlog.plans import driver_log
from wardlog.sources.audit_json import good_transactions, parse_audit_lines, parse_report, read_audit_json
from wardlog.sources.audit_text import parse_audit_blocks, read_audit_text
from wardlog.sources.datasets import read_csv, read_dataset, write_dataset
from wardlog.sources.schemas import EVENT_COLUMNS


def line(uri="/", method="GET", headers=None, messages=(), **more):
    request = {"method": method, "uri": uri, "headers": headers or {}}
    return json.dumps({"transaction": {"client_ip": "10.0.0.1", "request": request, "response": {"http_code": 200, "body": "é1"}, "messages": list(messages), **more}})


def message(rule="942100", severity="CRITICAL", text="m", data=""):
    return {"message": text, "details": {"ruleId": rule, "severity": severity, "data": data}}


def events(rows_of, *lines):
    df = rows_of([(i, v) for i, v in enumerate(lines)], "i int, value string")
    return audit_features(good_transactions(df)).orderBy("i")


def test_bad_lines_are_counted_not_fatal(rows_of):
    lines = ["", "  ", "# note", "{broken", "[1]", "3", '"x"', "null", '{"transaction": 5}', line(), '{"client_ip": "1.2.3.4"}', "{}"]
    parsed = parse_audit_lines(rows_of([(v,) for v in lines], "value string"))
    assert parse_report(parsed).first().asDict() == {"parsed": 3, "skipped": 6}


def test_defaults_and_columns(rows_of):
    row = events(rows_of, "{}").first()
    assert set(EVENT_COLUMNS) <= set(row.asDict())
    assert (row.method, row.uri, row.status, row.source_ip, row.timestamp, row.severity) == ("GET", "/", 200, "0.0.0.0", "", "INFO")
    assert (row.label, row.is_blocked, row.rule_count, row.bytes_sent) == (0, False, 0, 0)


def test_messages(rows_of):
    several = [message("941100", "2", "a", "d1"), message("", "9", "b"), message("949110", "CRITICAL", "c", "d2"), message("", "", "d")]
    row = events(rows_of, line(messages=several)).first()
    assert (row.rule_id, row.severity, row.severity_score, row.rule_count) == ("949110", "9", 5, 4)
    assert (row.msg, row.matched_data, row.label, row.is_blocked, row.bytes_sent) == ("a | b | c | d", "d1 | d2", 1, True, 2)


def test_zero_score_keeps_info(rows_of):
    row = events(rows_of, line(messages=[message(severity="bogus")])).first()
    assert (row.severity, row.severity_score) == ("INFO", 0)


def test_odd_message_lists(rows_of):
    rows = events(rows_of, line(messages=["x", message()]), '{"messages": "abc", "client_ip": "1.1.1.1"}', '{"request": 5, "messages": []}').collect()
    assert (rows[0].rule_count, rows[0].label, rows[0].rule_id) == (2, 1, "942100")
    assert (rows[1].rule_count, rows[1].source_ip) == (0, "1.1.1.1")
    assert rows[2].uri == "/"


def test_header_spelling(rows_of):
    df = rows_of([(line(headers={"user-agent": "ua", "host": "h", "X-Real-IP": "8.8.8.8"}),)], "value string")
    direct = flatten_transaction(good_transactions(df)).first()
    live = flatten_transaction(normalize_transaction(good_transactions(df))).first()
    assert (direct.user_agent, live.user_agent) == ("", "ua")
    assert (direct.source_ip, live.source_ip) == ("10.0.0.1", "8.8.8.8")
    empty = flatten_transaction(normalize_transaction(good_transactions(rows_of([("{}",)], "value string")))).first()
    assert empty.status == 0


def test_json_flags(rows_of):
    site = "/index.php/journal"
    rows = events(
        rows_of,
        line(f"{site}/article/submit?title=<script>alert(1)</script>", "POST", {"User-Agent": "qt", "Referer": ""}),
        line(f"{site}/article/download?file=../../../../etc/passwd"),
        line(f"{site}/user/register?username=admin' OR '1'='1", "post"),
        line(f"{site}/search?q=<img src=x onerror=alert(1)>"),
        line(f"{site}/article/submit?filename=../../../config.inc.php", "POST"),
        line(f"{site}/login/signIn", "POST", {"Referer": "https://x/"}),
        line("/public/journals/1/shell.php?x=1"),
        line(f"{site}/x", headers={"Host": "<script>"}),
        line(f"{site}/x?csrfToken=1", "POST", {"Referer": "-"}),
        line("/INDEX.PHP/x"),
        line("/x?role_id=1&a=<svg"),
    ).collect()
    on = [{c for c in EVENT_COLUMNS if (c.startswith("has_") or c.startswith("missing_")) and r[c] == 1} for r in rows]
    assert on[0] == {"has_xss", "missing_csrf_token", "has_suspicious_referer"}
    assert on[1] == {"has_suspicious_path", "has_path_traversal"}
    assert on[2] == {"has_sqli", "missing_csrf_token", "has_suspicious_referer"}
    assert on[3] == {"has_xss"}
    assert on[4] == {"has_path_traversal", "missing_csrf_token", "has_suspicious_referer", "has_cve_2021_32626", "has_cve_2023_47271_upload"}
    assert on[5] == {"missing_csrf_token"}
    assert on[6] == {"has_cve_2021_32626", "has_cve_2023_47271_upload", "has_cve_2023_47271_rce"}
    assert on[7] == {"has_cve_2022_24181"}
    assert on[8] == {"has_suspicious_referer"}
    assert on[9] == {"has_cve_2021_32626", "has_cve_2023_47271_upload"}
    assert on[10] == {"has_xss", "has_privesc_attempt", "has_cve_2024_xss_privesc"}


def test_request_flags(rows_of):
    df = rows_of([("/index.php/a?q=%3Cscript%3E", None, "-"), ("/INDEX.PHP/a", "csrftoken", "")], "uri string, user_agent string, referer string")
    first, second = request_features(df).collect()
    assert (first.has_xss_pattern, first.missing_csrf_token, first.has_suspicious_referer, first.method, first.status) == (1, 1, 1, "GET", 200)
    assert (second.missing_csrf_token, second.has_cve_2021_32626, second.has_cve_2023_47271_upload) == (0, 1, 0)
    assert [r.missing_csrf_token for r in request_features(df, parity=True).collect()] == [-1, -2]
    with pytest.raises(ValueError):
        request_features(df.drop("uri"))


def test_attack_types(rows_of):
    lines = [
        line(messages=[message("941100"), message("949110"), message("930120")]), line(messages=[message("999999"), message("920350")]), line(),
        line("/public/journals/1/a.php"), line("/a/b.phtml.sh", messages=[message("980130")]),
    ]
    rows = events(rows_of, *lines).select(
        attack_type_of_event(F.col("tx.messages")).alias("event"), F.array_sort(log_attack_types(F.col("tx.messages"))).alias("log")
    ).collect()
    assert [r.event for r in rows] == ["LFI, XSS", "Protocol", "unknown", "RCE, Upload", "Upload"]
    assert [r.log for r in rows] == [["LFI", "XSS"], ["Other (999999)"], [], [], []]


def test_document_layout(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([json.loads(line("/a")), json.loads(line("/b"))["transaction"]], indent=1))
    (tmp_path / "single.json").write_text(json.dumps(json.loads(line("/c")), indent=2))
    rows = read_audit_json(spark, str(tmp_path), "document").select("tx.request.uri").collect()
    assert sorted(r.uri for r in rows) == ["/a", "/b", "/c"]
    with pytest.raises(ValueError):
        read_audit_json(spark, str(tmp_path), "other")


BLOCKS = """--1a-A--
[02/Aug/2025:00:02:35 +0200] id1 10.1.1.1 40 10.2.2.2 80
--1a-B--
POST /x?a=1 HTTP/1.1
Host: h
User-Agent: ua: 1

--1a-F--
HTTP/1.1 403 Forbidden

--1a-H--
Message: Matched phrase "<script" [id "941100"] [msg "XSS found"] [severity "CRITICAL"]
Action: Intercepted (phase 2)

--1a-Z--

--2b-A--
[03/Aug/2025:00:02:35 +0200] id2 10.1.1.2 40 10.2.2.2 80
--2b-B--
GET /short
--2b-H--
Stopwatch: 1

--3c-A--
[04/Aug/2025:00:02:35 +0200] id3 10.1.1.3 40 10.2.2.2 80
--3c-B--
GET /wp-admin HTTP/1.1
--3c-F--
HTTP/1.1 abc Odd
--3c-Z--
"""


def test_text_blocks(spark, tmp_path, rows_of):
    (tmp_path / "audit.log").write_text(BLOCKS)
    rows = {r.source_ip: r for r in read_audit_text(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["10.1.1.1", "10.1.1.2", "10.1.1.3"]
    a, b, c = (rows[k] for k in sorted(rows))
    assert (a.timestamp, a.method, a.uri, a.status, a.user_agent, a.rule_id, a.msg, a.matched_data) == (
        "02/Aug/2025:00:02:35 +0200", "POST", "/x?a=1", 403, "ua: 1", "941100", "XSS found", "<script",
    )
    assert (a.severity, a.severity_score, a.label, a.is_blocked, a.has_xss) == ("CRITICAL", 4, 1, True, 1)
    assert (b.method, b.uri, b.status, b.label, b.severity) == ("GET", "/", 200, 0, "")
    assert (c.uri, c.status, c.has_suspicious_path) == ("/wp-admin", 200, 1)
    blank = parse_audit_blocks(rows_of([(BLOCKS,)], "value string"), parity=True).select("timestamp", "source_ip").distinct().collect()
    assert [tuple(r) for r in blank] == [("", "0.0.0.0")]


def test_text_severity_is_not_numeric(rows_of):
    got = rows_of([("2",), ("alert",)], "v string").select(S.severity_from_name(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 5]


def test_datasets_in_all_layouts(spark, tmp_path):
    """Arrays, suffixes in capitals, folders without CSV, headers in another order, quotes and line breaks."""
    one = '{"transaction": {"request": {"method": "GET", "uri": "/%s"}, "response": {"http_code": 200}}}'
    (tmp_path / "2024-01-05").mkdir()
    (tmp_path / "2024-01-05" / "A.LOG").write_text(one % "a" + "\n" + one % "b" + "\n")
    (tmp_path / "2024-01-05" / "c.Json").write_text("[" + one % "c" + ", " + one % "d" + "]")
    (tmp_path / "e.json").write_text("\n[\n" + one % "e" + ",\n" + one % "f" + "\n]\n")
    (tmp_path / "g.json").write_text('{\n "transaction": {\n "request": {"method": "GET", "uri": "/g"}}}\n')
    rows = read_dataset(spark, str(tmp_path)).collect()
    assert sorted(r.uri for r in rows) == ["/a", "/b", "/c", "/d", "/e", "/f", "/g"]
    assert {r.source_date for r in rows if r.uri < "/e"} == {"2024-01-05"}
    (tmp_path / "x.CSV").write_text('uri,method\n"/x ""q"", y",POST\n')
    (tmp_path / "y.csv").write_text("method,uri\nPUT,/y\\nz\n")
    both = read_dataset(spark, str(tmp_path), "method STRING, uri STRING")
    found = {(r.method, r.uri) for r in both.where("method <> 'GET'").collect()}
    assert found == {("POST", '/x "q", y'), ("PUT", "/y\nz")} and both.count() == 9


def test_line_breaks_survive_a_csv(spark, tmp_path):
    texts = ["a\nb", "\\n", "\\\n\r", 'q"\n,"', "", "\\\\", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    write_dataset(df, str(tmp_path / "out"), ["i", "t"])
    back = read_csv(spark, str(tmp_path / "out"), "t STRING, i INT", breaks=True).collect()
    assert {r.i: r.t or "" for r in back} == dict(enumerate(texts))


def test_sections_end_at_their_own_hash(spark):
    block = "--ab12-A--\n[05/Jan/2024:00:00:00 +0000] ab12 1.2.3.4 1 5.6.7.8 80\n--ab12-B--\nGET /x--a-Boo--cd-C-- HTTP/1.1\nHost: h\n\n--ab12-H--\nAction: Intercepted\n--ab12"
    bare = "--cd34-A--\n[05/Jan/2024:00:00:00 +0000] cd34 9.9.9.9 1 5.6.7.8 80\n--cd34"
    rows = parse_audit_blocks(spark.createDataFrame([(block,), (bare,)], "value string")).collect()
    assert sorted((r.uri, r.source_ip, r.is_blocked) for r in rows) == [("/", "9.9.9.9", False), ("/x--a-Boo--cd-C--", "1.2.3.4", True)]


def test_log_files_follow_the_events(spark, sf_dir, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    monkeypatch.setattr(driver_log, "FILE_EVENTS", -(-events // 9))
    monkeypatch.setattr(driver_log, "_STAGED", {})
    lines = driver_log.audit_lines(spark, sf_dir)
    assert len(lines.inputFiles()) == 9 and lines.count() == events
