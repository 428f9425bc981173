from quarrystone.llm import urls as U

SCHEMA = "page_id long, url string, html string, reason string, `a.b` int"
LINK = '<link rel="canonical" href="{}">'


def _pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash", 1) for k, u, h in rows], SCHEMA)


def _decide(spark, rows, blocked, allowed=(), redirects=None):
    t = lambda r: spark.createDataFrame(list(r), "kind string, value string")
    r = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    got = U.filter_urls(_pages(spark, rows), t(blocked), t(allowed), r)
    assert got.columns.count("reason") == 1 and "a.b" in got.columns
    return {x["page_id"]: (x["decision"], x["reason"]) for x in got.collect()}


def test_block_reaches_aliases_and_allow_wins(spark):
    rows = [(1, "http://bad.com/x", None), (2, "https://mirror.org/x", LINK.format("https://bad.com/x")), (3, "https://third.org/p?utm_source=q", "<p>"), (4, "https://good.org/", ""), (5, "https://ok.org/a", LINK.format("http://www.bad.com/x/"))]
    got = _decide(spark, rows, [("host", "bad.com")], [("prefix", "https://ok.org/a")], [("https://third.org/p", "https://mirror.org/x")])
    assert got == {1: ("block", "block rule"), 2: ("block", "alias of blocked"), 3: ("block", "alias of blocked"), 4: ("keep", "none"), 5: ("allow", "allow rule")}


def test_allowed_address_passes_no_block_on(spark):
    rows = [(1, "https://bad.com/fine", None), (2, "https://alias.org/", LINK.format("https://bad.com/fine"))]
    assert _decide(spark, rows, [("host", "bad.com")], [("url", "https://bad.com/fine")]) == {1: ("allow", "allow rule"), 2: ("keep", "none")}


def test_chain_as_brute_force_closure(spark):
    n = 40
    rows = [(k, f"https://h{k}.org/", LINK.format(f"https://h{k + 1}.org/") if k % 10 != 9 else None) for k in range(n)]
    got = _decide(spark, rows, [("host", "h13.org")])
    assert {k for k, v in got.items() if v[0] == "block"} == set(range(10, 20))


def test_path_boundaries_and_subdomains(spark):
    rows = [(1, "https://a.com/de", None), (2, "https://a.com/dex", None), (3, "https://x.b.com/", None), (4, "https://xb.com/", None), (5, "https://a.com/de/1?z=1&a=2", None)]
    got = _decide(spark, rows, [("prefix", "https://a.com/de/"), ("host", "b.com")])
    assert {k for k, v in got.items() if v[0] == "block"} == {1, 3, 5}


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "  ", "x"), (4, "ftp://a/b", LINK.format("")), (5, "https://a.org/", LINK.format("https://a.org")), (None, "https://bad.com", None), (7, "https://bad.com/", "y" * 3_000_000), (7, "https://bad.com/", "y")]
    got = _decide(spark, rows, [("host", "bad.com"), ("host", "bad.com"), (None, "q"), ("host", None), ("host", " ")])
    assert got == {1: ("keep", "none"), 2: ("keep", "none"), 3: ("keep", "none"), 4: ("keep", "none"), 5: ("keep", "none"), None: ("block", "block rule"), 7: ("block", "block rule")}
    assert _decide(spark, [], [("host", "bad.com")]) == {} and len(_decide(spark, rows, [])) == 7
