import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators import labels as lb


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_severity(rows_of):
    values = ["2", "CRITICAL", "", "9", "bogus", "-1", " alert ", None, "+3", "99999999999999999999", "EMERGENCY", "debug"]
    assert one(rows_of([(v,) for v in values], "v string"), S.severity_score(F.col("v"))) == [2, 4, 0, 5, 0, 0, 5, 0, 3, 5, 5, 0]


def test_anomaly_steps(rows_of):
    values = [None, float("nan"), -1.0, 2.99, 3.0, 7.0, 12.9, 13.0, 21.0, 26.9, 27.0, 1e9]
    assert one(rows_of([(v,) for v in values], "v double"), S.anomaly_to_severity(F.col("v"))) == [0, 0, 0, 0, 1, 2, 2, 3, 4, 4, 5, 5]


def test_event_time(rows_of):
    values = [
        "Tue May  5 04:12:06 2026", "2026-05-07T00:00:00Z", "2026-05-18 13:25:54", "2026-05-18T13:25:54", "2026-05-18T13:25:54+02:00",
        "2026-05-18T13:25:54.123456", " 2026-05-18 13:25:54 ", "yesterday", "", None, "Tue Foo 5 04:12:06 2026",
    ]
    got = one(rows_of([(v,) for v in values], "v string"), S.parse_event_time(F.col("v")).cast("string"))
    assert got == [
        "2026-05-05 04:12:06", "2026-05-07 00:00:00", "2026-05-18 13:25:54", "2026-05-18 13:25:54", "2026-05-18 11:25:54",
        "2026-05-18 13:25:54.123456", "2026-05-18 13:25:54", None, None, None, None,
    ]


def test_local_time_is_applied_once(rows_of):
    df = rows_of([("2026-05-18 20:25:54",)], "v string").select(S.parse_event_time(F.col("v")).alias("t"))
    assert one(df, S.to_local_label(F.col("t"))) == ["2026-05-19 03:25:54 WIB"]
    assert one(df, S.to_local_history(F.col("t"))) == ["2026/05/19 03:25 WIB"]
    assert one(df, S.to_local_history(F.lit(None).cast("timestamp"))) == ["N/A"]


def test_client_ip_order(rows_of):
    rows = [
        ({"X-Real-IP": "1.1.1.1", "X-Forwarded-For": "2.2.2.2"}, "9.9.9.9"), ({"x-real-ip": "3.3.3.3"}, "9.9.9.9"),
        ({"X-Real-IP": "", "X-Forwarded-For": " 4.4.4.4 , 5.5.5.5"}, "9.9.9.9"), ({"X-Forwarded-For": ""}, "9.9.9.9"), (None, "9.9.9.9"), ({}, ""), ({}, None),
    ]
    got = one(rows_of(rows, "h map<string,string>, c string"), S.resolve_client_ip(F.col("h"), F.col("c")))
    assert got == ["1.1.1.1", "3.3.3.3", "4.4.4.4", "9.9.9.9", "9.9.9.9", "0.0.0.0", "0.0.0.0"]


def test_decode(rows_of):
    values = ["a%zz+b%ff", "%27%20or", "plain", "%", "%2527", "é+%C3%A9"]
    assert one(rows_of([(v,) for v in values], "v string"), S.decode_uri(F.col("v"))) == ["a%zz b\ufffd", "' or", "plain", "%", "%27", "é é"]


def test_coercion(rows_of):
    df = rows_of([("",), (None,), ("7",), ("x",), ("0.123455",), ("1",), ("0",)], "v string")
    assert one(df, S.text_or_null(F.col("v"))) == [None, None, "7", "x", "0.123455", "1", "0"]
    assert one(df, S.int_or_zero(F.col("v"))) == [0, 0, 7, 0, 0, 1, 0]
    assert one(df, S.prediction_or_null(F.col("v"))) == [None, None, 0, 1, 1, 1, 0]
    assert one(df, S.probability_or_null(F.when(F.col("v").startswith("0."), F.col("v"))))[4] == Decimal("0.12346")
    assert one(rows_of([("0.123445",)], "v string"), S.probability_or_null(F.col("v"))) == [Decimal("0.12344")]


def test_bands_and_override(rows_of):
    df = rows_of([(0.2,), (0.6,), (0.7,), (0.8,), (0.85,)], "p double")
    p = F.col("p")
    assert one(df, S.severity_band(p)) == ["low", "medium", "medium", "high", "high"]
    assert one(df, S.severity_band(p, S.apply_threshold(p), "api")) == ["normal", "low", "medium", "medium", "high"]
    assert one(df, S.override_probability(p, p < 0.5)) == [0.99, 0.6, 0.7, 0.8, 0.85]
    assert one(df, S.format_probability(p * 0 + 0.4765)) == ["47.6%"] * 5 or one(df, S.format_probability(p))[0] == "20.0%"


def test_truncate(rows_of):
    df = rows_of([("a" * 46,), ("a" * 47,), ("b",)], "v string")
    assert one(df, S.truncate_text(F.col("v"))) == ["a" * 46, "a" * 43 + "...", "b"]


def test_source_date(rows_of):
    paths = ["/d/2026-03-13/a.log", "/d/20260313/x/a.log", "/d/27-Jul-2025/a.log", "/2020-01-01/d/log_2026_01_02.json", "/d/a.log"]
    got = one(rows_of([(p,) for p in paths], "p string"), lb.source_date(F.col("p")))
    assert got == ["2026-03-13", "2026-03-13", "27-Jul-2025", "2026-01-02", ""]


def test_export_time(rows_of):
    df = rows_of([(dt.datetime(2026, 5, 5, 4, 12, 6),)], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    assert one(df, lb.export_time(F.col("t"))) == ["Tue May 5 04:12:06 2026"]
