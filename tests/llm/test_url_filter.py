from pyspark.sql import functions as F

from seclog.llm.url_filter import DAMPING, STEPS, UNIT, blocked_hosts, host_edges, judged_by_rules, propagated

CASES = {
    "http://A.Example.NET/en/x?q=/de/#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "https://w.example.com/de/1": ("w.example.com", "/de/1", "example.com/de/", "block"),
    "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.org/FR/": ("x.org", "/FR/", None, None),
    "http://a.net": ("a.net", "", None, None),
    "http://a.net?x=/": ("a.net", "", None, None),
    "//a.net/": ("", "", None, None),
    "http://É.Org/fr/\n?": ("É.org", "/fr/\n", "org/fr/", "allow"),
    "a://b://c/": ("b:", "//c/", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    for r in judged_by_rules(df).collect():
        assert (r.host, r.path, r.rule, r.ruled) == CASES[r.url], r.url


def test_edges(spark):
    pages = spark.createDataFrame(
        [("a.org", '<a href="http://B.com/x"><a HREF=//c.com><img src=\'https://b.com\'><a href="/own"><a href="http://a.org/">'), ("www.a.org", None), ("x.y.a.org", ""), ("", '<a href="http://b.com">')], "host string, html string"
    )
    got = {(r.src, r.dst): r.w for r in host_edges(pages, pages.select("host")).collect()}
    assert got == {("a.org", "b.com"): 2, ("a.org", "c.com"): 1, ("www.a.org", "a.org"): 1, ("a.org", "www.a.org"): 1, ("x.y.a.org", "a.org"): 1, ("a.org", "x.y.a.org"): 1}


def test_propagation(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "a", 1), ("c", "d", 2), ("d", "c", 5)]
    seeds = [("trust", "a", 2 * UNIT), ("distrust", "d", UNIT)]
    got = {(r.kind, r.host): r.mass for r in propagated(spark.createDataFrame(edges, "src string, dst string, w long"), spark.createDataFrame(seeds, "kind string, host string, mass long")).collect()}
    want = {}
    for kind, ways in (("trust", edges), ("distrust", [(d, s, w) for s, d, w in edges])):
        wave = {h: float(m) for k, h, m in seeds if k == kind}
        for _ in range(STEPS + 1):
            for h, m in wave.items():
                want[kind, h] = want.get((kind, h), 0) + m
            new = {}
            for s, d, w in ways:
                new[d] = new.get(d, 0) + wave.get(s, 0) * DAMPING * w / sum(x for t, _, x in ways if t == s)
            wave = new
    assert got.keys() == {k for k, v in want.items() if v} and all(abs(got[k] - want[k]) < 100 for k in got)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    link = lambda h: f'<a href="http://{h}/">'
    rows = [("bad.net", "block", "")] * 20 + [("farm.com", None, link("bad.net"))] * 10 + [("good.com", None, link("fine.com"))] * 10 + [("fine.com", "allow", "")] * 5
    df = spark.createDataFrame(rows, "host string, ruled string, html string")
    assert {r.host for r in blocked_hosts(df).where("bad").collect()} == {"bad.net", "farm.com"}
    assert blocked_hosts(df.where(F.lit(False))).count() == 0
