from helpers import CLASHING

from millrace.llm.queries import URL_RULES
from millrace.llm.url_filter import filter_urls

CASES = [
    (1, "https://a.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://example.org", "example.org", "", None, "allow"),
    (4, "x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (5, "http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
    (6, "http://b.com/fr/x", "b.com", "/fr/x", "com/fr/", "allow"),
    (7, "http://com/de/", "com", "/de/", "com/de/", "block"),
    (8, "no scheme", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (9, "", "", "", None, "allow"),
    (None, "://h.com/de/://x.org/", "h.com", "/de/://x.org/", "com/de/", "block"),
    (10, "http:///path", "", "/path", None, "allow"),
    (11, "http://ex\nample.org/\nz", "ex\nample.org", "/\nz", "org/", "allow"),
    (12, "http://a..org/x", "a..org", "/x", "org/", "allow"),
]


def test_cases(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(c[0], c[1], *["clash"] * len(CLASHING)) for c in CASES], ", ".join(["page_id long", "url string", *(f"`{c}` string" for c in CLASHING)]))
    got = [tuple(r) for r in filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted([(c[0], *c[2:]) for c in CASES], key=str)
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_rule_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    rules = spark.createDataFrame([("b.c", "/x/", "allow"), ("b.c", "/x/", "block"), (None, "/", "block"), ("c", None, "block")], "host string, path string, verdict string")
    assert filter_urls(pages, rules).first().verdict == "block"
    assert filter_urls(pages, rules.limit(0)).first().verdict == "allow"
    assert filter_urls(pages, rules.limit(0), default="block").first().verdict == "block"
