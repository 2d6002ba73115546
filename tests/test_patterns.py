"""Every pattern of every family has a hit, and both search paths agree with Python's engine."""

import re

import pytest
from pyspark.sql import functions as F

from wardlog.functions import patterns as P

# One text per pattern, in the order of the lists.
HITS = {
    "sqli": [
        "1 UNION  select 2", "select a, b from", "insert into t", "DELETE from t", "or 1 = 1", "or '1'='1", "and 1=1", "sleep (5)",
        "waitfor delay", "benchmark(9)", "information_schema", "sysobjects", "group_concat", "drop table", "x --  ", "a/* c */",
    ],
    "xss": [
        "<script", "</SCRIPT>", "javascript:", "vbscript:", "onerror =", "onload=", "onmouseover =", "alert (1)", "prompt(1)", "confirm (2)",
        "document.cookie", "<iframe", "<svg", "<img", "eval (x)",
    ],
    "suspicious_path": [
        "/wp-admin", "/wp-login", "/phpMyAdmin", "/etc/passwd", "/.env", "/admin", "/.git", "/.svn", "/.hg", "/.bzr", "/node_modules", "/.aws",
        "/.config", "/backup", "/.bak",
    ],
    "path_traversal": [
        "../", "..\\", "%2e%2E/", "%2e%2e\\", "..%2F", "%2e%2e%2f", "/etc/", "/proc/", "/sys/", "/root/", "C:\\Windows", "c:\\winnt",
    ],
    "command_injection": [
        "; cat x", ";ls  -l", "; whoami", ";id -u", "; uname -a", "$(x)", "`ls`", "| nc host", "|bash", "& cat x", "> /dev/null", "wget x",
        "curl x", "ping -c", "cmd.exe", "PowerShell",
    ],
    "host_header_xss": ["<script", "javascript:", "onerror=", "onload =", "alert(", "eval (", "expression ("],
    "csrf_token": ["csrfToken", "csrf_token", "authenticity_token", "__RequestVerificationToken"],
    "privesc": ["role = admin", "role=Manager", "role_id=1", "privilege= admin", "author_to_admin", "escalate", "promote"],
    "executable_ext": [
        ".php", ".php3", ".php4", ".php5", ".phtml", ".jsp", ".jspx", ".py", ".sh", ".exe", ".dll", ".so",
    ],
    "upload_bypass": [
        ".php%00", ".php.jpg", ".php.png", ".php.gif", ".php.txt", "%2EPHP", ".jpg.php", ".gif.php",
    ],
    "xml_upload_name": ["a/b.phar x"],
    "uploaded_php_access": ["/public/journals/3/x.PHP?a=1"],
}
MISSES = [
    "", " ", "/index/journal/about", "reunion selected", "select", "script>", "java script", "alerting", "or 12", "order by 1", "role", "rolex admin",
    "php", "a.pht1x", "/public/journals/x/a.php", "public/journals/1/", "-- x", "été", "selectéfrom", "cat;", "%2e%2e", "evaluate (", "/wpadmin",
]
ODD = ["union\u00a0select", "be\u017fore union \u017felect", "inform\u0061tion_\u017fchema", "CURL\u2003x", "\u212aiwi promote", "İ<SCRIPT", "select a\nb from c", "select a \u2028 from t", "insert \u0131nto", "\u0130nsert into", "a.php\u00e9", "a.php-\u00e9", "SLEEP\u3000(", "; \u0130D x"]


def expected(family, text):
    return int(any(re.search(p, text, re.IGNORECASE) for p in P.FAMILIES[family]))


@pytest.mark.parametrize("family", list(P.FAMILIES))
def test_each_pattern_has_a_hit(family):
    assert len(HITS[family]) == len(P.FAMILIES[family])
    for pattern, text in zip(P.FAMILIES[family], HITS[family]):
        assert re.search(pattern, text, re.IGNORECASE), (pattern, text)


def test_families_agree_with_python(spark, rows_of):
    texts = [t for family in HITS.values() for t in family] + MISSES + ODD
    texts += [t.upper() for t in texts] + [f"{t} é" for t in texts]
    df = rows_of([(t,) for t in texts], "t string").withColumn("low", P.folded(F.col("t")))
    rows = df.select(
        "t",
        *[P.flag(P.matches(f, F.col("t"), "low")).alias(f) for f in P.FAMILIES],
        *[P.has_family(f, F.col("t")).alias(f"{f}_plain") for f in P.FAMILIES],
    ).collect()
    for row in rows:
        for family in P.FAMILIES:
            assert row[family] == row[f"{family}_plain"] == expected(family, row["t"]), (family, row["t"])


def test_null_never_matches(rows_of):
    row = rows_of([(None,)], "t string").select(P.has_sqli(F.col("t")).alias("a"), P.has_csrf_token(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (0, 0)


def test_front_controller_removal(rows_of):
    df = rows_of([("/index.php/a/INDEX.PHP index.php",)], "t string")
    row = df.select(P.without_front_controller(F.col("t")).alias("a"), P.without_front_controller(F.col("t"), True).alias("b")).first()
    assert (row.a, row.b) == ("/a/INDEX.PHP ", "/a ")
