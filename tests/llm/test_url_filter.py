from tidemark.llm.common import connected_components
from tidemark.llm.url_filter import judge


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_aliases_and_rules(spark):
    link = '<html><LINK href="%s" rel="canonical"><p>x</p>'
    fresh = "<meta http-equiv='Refresh' content='0; URL=%s'>"
    rows = [
        (1, "http://a.net/es/1", None),
        (2, "http://b.org/x?u=1&v=2#f", link % "https://c.org/y"),
        (3, "https://C.org/y", fresh % "http://a.net/es/1"),
        (4, "http://d.org/1", link % "//b.org/x?u=1&amp;v=2"),
        (5, "http://www.example.com/en/z", link % "http://a.net/es/1"),
        (6, "http://example.com/en/", ""),
        (7, "http://e.org/a/b", link % "c"),
        (8, "http://e.org/a/c", None),
        (9, None, link % "http://a.net/es/1"),
        (10, "no scheme", "canonical"),
        (10, "no scheme", "canonical"),
        (11, "x://h.com", "y" * 300_000),
        (12, "http://notexample.net/fr", None),
        (None, "http://m.NET/fr/é?#", None),
    ]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, Host string, _key int")
    got = judge(df)
    assert got.columns == ["page_id", "url", "html", "_key", "host", "path", "rule", "verdict"]
    had = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got.collect())
    assert had == sorted(
        [
            ("1", "a.net", "/es/1", "net/es/", "block"),
            ("2", "b.org", "/x", None, "block"),
            ("3", "c.org", "/y", None, "block"),
            ("4", "d.org", "/1", None, "block"),
            ("5", "www.example.com", "/en/z", "www.example.com/en/", "allow"),
            ("6", "example.com", "/en/", "example.com/en/", "block"),
            ("7", "e.org", "/a/b", None, "allow"),
            ("8", "e.org", "/a/c", None, "allow"),
            ("9", "", "", None, "allow"),
            ("10", "", "", None, "allow"),
            ("10", "", "", None, "allow"),
            ("11", "h.com", "", None, "allow"),
            ("12", "notexample.net", "/fr", None, "allow"),
            ("None", "m.net", "/fr/é", "net/fr/", "block"),
        ]
    )
    seen = spark.createDataFrame([("http://e.org/a/c", "http://z.net/fr/")], "source string, target string")
    assert {r.page_id: r.verdict for r in judge(df, redirects=seen).where("page_id in (7, 8)").collect()} == {7: "block", 8: "block"}
    assert judge(df.limit(0)).count() == 0
