"""URL rules against a plain rule loop."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexweave.llm import urls
from lexweave.llm.queries import URL_RULES

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(UPPER.get(c, c) for c in rest[:cut]), tail[:end]


def judge(url, rules=URL_RULES):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")))


URLS = [
    "http://a.com/x", "http://A.Example.COM/en/1?q#f", "https://www.example.com/en/", "https://www.example.com/en", "http://a.net/es/1",
    "http://net/fr/", "http://xnet/fr/", "http://a.com", "http://a.com?x=/en/", "http://example.com#/en/", "no scheme", "", None, "://", "http:///en/",
    "http://É.Com/é/", "ftp://x.com/http://y.net/es/", "http://a..com/x", "http://example.com/en/",
]


def run(spark, rows, rules=URL_RULES, **settings):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, frame, **settings).collect()), key=str)


def expect(rows, rules=URL_RULES):
    return sorted(((i, u, *judge(u, rules)) for i, u, _ in rows), key=str)


def test_each_case_and_repeats(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(0, URLS[0], "x"), (0, URLS[0], "x"), (None, URLS[1], None), (0, URLS[4], "x")]
    assert run(spark, rows) == expect(rows)
    assert run(spark, rows, broadcast_rows=0) == expect(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"\Ahttps?://([a-c]\.){0,3}(net|com|Example\.com)(/(en|es|fr)){0,2}/?[?#]?x?\Z"), min_size=40, max_size=40))
def test_many(spark, texts):
    rows = [(k, u, None) for k, u in enumerate(texts)]
    rules = URL_RULES + [("b.com", "/en/es", "block"), ("com", "", "allow"), ("a.net", "/", "block")]
    assert run(spark, rows, rules) == expect(rows, rules)


def test_many_rules_pass_the_filter_exactly(spark):
    rules = [(f"h{k}.org", f"/p{k % 7}/", "block" if k % 2 else "allow") for k in range(2000)]
    rows = [(k, f"http://h{k}.org/p{k % 5}/x", None) for k in range(3000)]
    assert run(spark, rows, rules) == expect(rows, rules)


def test_empty_tables(spark):
    assert run(spark, []) == []
    rows = [(1, "http://a.com/", None)]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]


def test_conflicting_and_null_rules(spark):
    rules = [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("net", None, "block")]
    assert run(spark, [(1, "http://a.com/", None)], rules)[0][-1] == "block"
