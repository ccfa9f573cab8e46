"""Rules, aliases and explicit allows."""

from winnow.llm import url_filters as U

SCHEMA = "page_id long, url string, html string"


def judge(spark, pages, redirects=None, rules=U.RULES):
    rows = [(i, *(p if isinstance(p, tuple) else (p, ""))) for i, p in enumerate(pages)]
    red = spark.createDataFrame(redirects, "src string, dst string") if redirects else None
    out = U.judge_urls(spark.createDataFrame(rows, SCHEMA), U.rule_table(spark, rules), red)
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(out.collect())]


def test_parts_and_rules(spark):
    got = judge(spark, ["HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://a.example.org/en/2", "x://exampleorg/", "x://org?q=/es/", None, "no scheme", "a://b://c/d", "x://com/fr/", "x://m.com/de/x", "x://m.com/DE/x"])
    assert got == [
        ("www.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.example.org", "/en/2", "org/", "allow"),
        ("exampleorg", "/", None, "allow"), ("org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("com", "/fr/", "com/fr/", "allow"), ("m.com", "/de/x", "com/de/", "block"), ("m.com", "/DE/x", None, "allow"),
    ]


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    pages = [
        "http://bad.com/de/x", ("http://copy.net/a", link("http://bad.com/de/x")), ("https://www.copy2.net/b/", "<meta http-equiv=refresh content='0; url=http://copy.net/a?utm_source=q'>"),
        "http://copy2.net/b?ref=z#f", "http://copy2.net/b?page=2", ("http://mixed.net/1", link("http://bad.com/de/y")), ("http://good.org/1", link("http://mixed.net/1")), "http://bad.com/de/y", "http://far.net/r",
    ]
    got = [v for *_, v in judge(spark, pages, [("http://far.net/r", "http://hop.net/"), ("http://hop.net", "http://copy.net/a")])]
    assert got == ["block", "block", "block", "block", "allow", "allow", "allow", "block", "block"]


def test_odd_tables(spark):
    assert judge(spark, ["x://com/de/1"] * 3) == [("com", "/de/1", "com/de/", "block")] * 3
    assert U.judge_urls(spark.createDataFrame([], SCHEMA), U.rule_table(spark)).count() == 0
    d = spark.createDataFrame([(1, "x://m.com/de/", 5, "v")], "page_id long, url string, host int, verdict string")
    out = U.judge_urls(d, U.rule_table(spark))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and out.first().verdict == "block"
    assert judge(spark, ["x://a.b/"], rules=()) == [("a.b", "/", None, "allow")]


def test_targets_that_are_no_pages(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [("http://a.net/1", link("http://example.org/es/5")), "http://b.net/1", ("http://c.com/fr2/", link("//m.com/de/1")), ("http://m.com/fx/y/z?q", link("../../de/./k")), ("http://m.com/q", link("/de/7")),
             ("http://d.net/1", link("http://d.net/2") + link("http://m.com/de/9")), ("http://e.net/1", link("http://m.com/de/8") + link("http://x.org/")), ("http://f.net/", link("mailto:a@m.com/de/"))]
    got = [v for *_, v in judge(spark, pages, [("http://b.net/1", "http://m.com/de/2")])]
    assert got == ["block", "block", "block", "block", "block", "block", "allow", "allow"]
