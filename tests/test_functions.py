"""Tokens, types and times, line by line."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import classify, patterns, tokenize


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fields(spark):
    lines = ["[Thu Jun 09 06:07:04 2005] [notice] LDAP: Built with OpenLDAP", "20171223-22:15:29:606|Step_LSC|30002312|onStandStepChanged 3579", "[t] a , b :; -- 12.5 \"q r\" 'x' [] [open", "  ", "", None, "|x|y", "a||b", "a|b|"]
    assert column(spark, lines, tokenize.fields) == [
        ["Thu Jun 09 06:07:04 2005", "notice", "LDAP:", "Built", "with", "OpenLDAP"],
        ["20171223-22:15:29:606", "Step_LSC", "30002312", "onStandStepChanged 3579"],
        ["t", "a", "b", "--", "12.5", "q r", "x", "[]", "[open"],
        [], [], [], ["|x|y"], ["a||b"], ["a", "b", ""],
    ]


def test_types_and_places(spark):
    (types,) = column(spark, ['[t] a , 12 "q"'], tokenize.token_types)
    assert types == ["bracket", "word", "punctuation", "number", "quoted"]
    (tokens,) = column(spark, ["ab  [c]"], tokenize.tokens)
    assert [tuple(t) for t in tokens] == [("word", "ab", 0, 2), ("whitespace", "  ", 2, 4), ("bracket", "[c]", 4, 7)]
    (tokens,) = column(spark, ["a | b|c"], tokenize.tokens)
    assert [tuple(t) for t in tokens] == [("word", "a", 0, 2), ("pipe", "|", 2, 3), ("word", "b", 3, 5), ("pipe", "|", 5, 6), ("word", "c", 6, 7)]


def test_tokens_cover_the_line(spark):
    lines = ["[a b] x", "p 'q' [r]:s , t", "x\ty  z", "don't stop"]
    for line, tokens in zip(lines, column(spark, lines, tokenize.tokens)):
        assert "".join(t.value for t in tokens) == line


@pytest.mark.parametrize(
    "value, kind, name, confidence",
    [
        ("2024-11-23 10:15:32", "TIMESTAMP", "iso8601", 95), ("[Thu Jun 09 06:07:04 2005]", "TIMESTAMP", "syslog", 90), ("192.168.1.1", "IP_ADDRESS", "ipv4", 95), ("ERROR", "SEVERITY", "standard_levels", 95), ("error", "SEVERITY", "standard_levels", 95),
        ("Step_LSC", "MODULE", "prefixed_component", 90), ("30002312", "MESSAGE", "default_message", 50), ("nova.compute.manager", "HOST", "fqdn", 90), ("[req-7a738b84-d574-43c6-a6c4-68c164365101]", "REQUEST_ID", "bracketed_uuid", 95),
        ("0.54 seconds", "METRIC_VALUE", "time_metric", 90), ("proxy.cse.cuhk.edu.hk:5070", "HOST", "fqdn", 90), ("Authentication failed for user admin", "USER_ID", "user_keyword", 95), ("17:41:41,536", "TIMESTAMP", "time_ms", 85), ("2015-07-29", "MESSAGE", "default_message", 50), ("", "UNKNOWN", "no_match", 0),
    ],
)
def test_best_match(spark, value, kind, name, confidence):
    (m,) = column(spark, [value], classify.best_match)
    assert (m.type, m.pattern_name, round(m.confidence * 100)) == (kind, name, confidence)


def test_all_matches_are_sorted_and_placed(spark):
    (found,) = column(spark, ["user=bob from 10.0.0.1 port 80"], classify.recognize)
    assert [m.confidence for m in found] == sorted((m.confidence for m in found), reverse=True)
    by = {m.pattern_name: m for m in found}
    assert (by["ipv4"].start, by["ipv4"].end, by["user_keyword"].value, by["port_keyword"].value) == (14, 22, "bob", "80")
    assert column(spark, [" ", None], classify.recognize) == [[], []]


def test_patterns_agree_with_python(spark):
    values = ["a.b.c", "x.log", "pid=12", "[2931]", "50%", "12 KB", "TXN 123", "uid: 7", "status: 404", "closing", "::1", "fe80::", "10.30 16:49:06", "error code: E7", "request_id=ab-1", "main.py"]
    found = column(spark, values, classify.recognize)
    for value, matches in zip(values, found):
        expect = {p.name for p in patterns.PATTERNS if re.search(p.regex, value, re.I if p.ignore_case else 0)} or {"default_message"}
        assert {m.pattern_name for m in matches} == expect


def test_custom_types_win(spark):
    values = ["ERR-1234", "TXN-ABCD1234", "CUST-12345678", "ORDER-123456", "ERR-ABC", "TXN-123", "CUSTOMER-12345678"]
    found = column(spark, values, lambda v: classify.best_match(v, patterns.with_custom()))
    assert [m.type for m in found[:4]] == ["ERROR_CODE", "TRANSACTION_ID", "CUSTOMER_ID", "TRANSACTION_ID"]
    assert not any(m.pattern_name.startswith("custom") for m in found[4:])
    more = patterns.Registry().add_pattern("TICKET", "ticket", 0.99, r"^T-\d+$")
    assert column(spark, ["T-12"], lambda v: classify.best_type(v, more)) == ["TICKET"]


def test_times(spark):
    values = ["2024-12-01 10:00:00", "2024-12-01T10:00:00.123Z", "2024-11-23 10:15:32.123", "20171223-22:15:29:606", "Thu Jun 09 06:07:04 2005", "Wed Jun 15 06:07:04 2005", "2015-07-29 17:41:41,536", "10.30 16:49:06", "1514038529606", "1717891200", "", None, "x"]
    assert column(spark, values, classify.epoch_ms) == [1733047200000, 1733047200123, 1732356932123, 1514067329606, 1118297224000, 1118815624000, 1438191701536, None, 1514038529606, 1717891200000, None, None, None]
    assert column(spark, values, classify.epoch_ms_compat) == [1733047200000, 1733047200123, 0, 0, 0, 0, 0, 0, 1514038529606, 1717891200000, 0, 0, 0]
    assert column(spark, values, classify.is_valid_timestamp) == [True, False, False, True, True, True, True, False, True, True, False, False, False]


def test_validity(spark):
    assert column(spark, ["1.2.3.4", "1.2.3.256", "1.2.3", "1:2:3:4:5:6:7:8", "", None], classify.is_valid_ip) == [True, False, False, True, False, False]
    assert column(spark, ["WARN", "Verbose", "loud", None], classify.is_valid_severity) == [True, True, False, False]


@settings(max_examples=25, deadline=None)
@given(lines=st.lists(st.text(alphabet=st.sampled_from("ab1.,:;- \t|"), max_size=24), min_size=1, max_size=8))
def test_fields_match_a_plain_reading(spark, lines):
    def plain(line):
        if not line.strip():
            return []
        if re.match(r"^([^|]+\|){2,}", line):
            return [x.strip() for x in line.split("|")]
        return [t for t in line.split() if t not in ",:;-"]

    assert column(spark, lines, tokenize.fields) == [plain(x) for x in lines]
