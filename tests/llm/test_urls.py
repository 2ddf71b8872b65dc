"""URL rules against a loop over all of them."""

from __future__ import annotations

import re

from millrace.llm import urls
from millrace.llm.queries import URL_RULES

URLS = [
    "http://www.example.org/es/750?x", "https://EXAMPLE.org/en/1", "http://a.example.org/en/12/", "http://notexample.org/es/1", "http://b.com/fr/", "ftp://x.com/de",
    "http://x.com/de/?q", "http://org", "http://org/", "http://a.org?x/", "no scheme", "", None, "http://user@h.com/fr/1", "x://a.b.c.com/de/#t", "http://../fr/",
    "http://" + "a." * 500 + "com/de/" + "p" * 5000, "a://b.org/1://c.com/de/", "http://x.com/de/?q", "http://é.org/ß", "http://x.org\n/en",
]


def plain(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


def run(spark, rules, rows, schema="page_id long, url string, host string, short int"):
    got = urls.judge(spark.createDataFrame(rows, schema), urls.rules_table(spark, rules))
    return sorted(map(tuple, got.collect()), key=str)


def test_against_all_rules(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "clash", 1)]
    want = sorted(((i, *plain(u, URL_RULES)) for i, u, _, _ in rows), key=str)
    assert run(spark, URL_RULES, rows) == want


def test_precedence_and_ties(spark):
    rules = [("allow", "a.com/x"), ("block", "com/x"), ("block", "a.com/x"), ("allow", "b.a.com"), ("block", "a.com/xy/z"), ("allow", "com/")]
    rows = [(i, u, "", 0) for i, u in enumerate(["h://a.com/x", "h://b.a.com/x", "h://b.a.com/xy/z1", "h://q.com/x", "h://q.com/y", "h://b.a.com", "h://net/"])]
    assert run(spark, rules, rows) == sorted(((i, *plain(u, rules)) for i, u, _, _ in rows), key=str)


def test_large_rule_sets_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    rows = [(i, u, "", 0) for i, u in enumerate(URLS)]
    assert run(spark, URL_RULES, rows) == sorted(((i, *plain(u, URL_RULES)) for i, u, _, _ in rows), key=str)


def test_hash_prefix_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urls, "PREFIX_DIGITS", 1)
    rows = [(i, f"http://h{i}.com/p{i}", "", 0) for i in range(60)]
    rules = [("block", f"h{i}.com/p{i}") for i in range(0, 60, 3)]
    assert run(spark, rules, rows) == sorted(((i, *plain(u, rules)) for i, u, _, _ in rows), key=str)


def test_no_rules_no_pages(spark):
    assert [r[3:] for r in run(spark, [("allow", "x/")], [(1, "http://a.org/", "", 0)])] == [(None, "allow")]
    assert run(spark, URL_RULES, []) == []
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = urls.rules_table(spark, [("allow", "a/")]).where("false")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
