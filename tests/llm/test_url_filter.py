"""URL filters: against DuckDB SQL and union-find on planted links, and hand cases."""

import duckdb
import pytest

from tests.test_oracle import rows
from tidemark.llm import registry, url_filter

A = "http://a.example.org/x/"
#: page_id, url, html, the addresses that it leads to, and what it must get where no rule of its own fits
PLANTED = [
    (1, "https://b.example.com/de/1", "<link rel=canonical href='http://a.example.org/x/1'>", ["http://a.example.org/x/1"], None),
    (2, A + "1", "<p>no links</p>", [], "block"),
    (3, A + "2?q=1#top", '<META http-equiv="Refresh" content="0; URL=\'1\'">', [A + "1"], "block"),
    (4, "http://a.example.org/x/y/z", '<link href="../1" rel="alternate Canonical">', [A + "1"], "block"),
    (5, "HTTP://A.Example.ORG/x/1#s", "", [], "block"),
    (6, "http://lone.example.org/", "<!-- <link rel=canonical href='http://a.example.org/x/1'> --><script>'<link rel=canonical href=/x>'</script>", [], "allow"),
    (7, "http://c.example.org/p", "<link rel='canonical' href='//d.example.net/en/7'>", ["http://d.example.net/en/7"], "allow"),
    (8, "http://c.example.org/q", "<link rel='canonical' href='http://d.example.net/zz'><link rel=canonical href='?a=1&amp;b=2'>", ["http://d.example.net/zz", "http://c.example.org/q?a=1&b=2"], "block"),
    (9, "http://c.example.org/q?a=1&b=2", None, [], "block"),
    (10, "http://e.example.org/r", "<link rel=canonical href='http://d.example.net/zz/9'><link rel=canonical href='http://d.example.net/en/zz'>", ["http://d.example.net/zz/9", "http://d.example.net/en/zz"], "allow"),
    (11, "mailto:x", "<link rel=canonical href='http://d.example.net/zz'>", [], "allow"),
    (12, None, "<link rel=canonical href='http://d.example.net/zz'>", [], "allow"),
    (13, "http://f.example.org", "<link rel=canonical href='mailto:a@b'><link rel=canonical href=''><link rel=canonical href='#x'><link rel=stylesheet href='http://d.example.net/zz'>", [], "allow"),
    (14, "http://f.example.org/a/b", "<link rel=canonical href='./../../../g/./h/..'>", ["http://f.example.org/g/"], "block"),
    (15, "http://f.example.org/g/", "<meta content='5;url=http://x.net/' http-equiv=refresh>", ["http://x.net/"], "block"),
    (None, "http://x.net", "", [], "allow"), (2, A + "1", "<p>no links</p>", [], "block"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([r[:3] for r in PLANTED], "page_id long, url string, html string")


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_planted_links_by_hand_and_by_sql(pages):
    found = sorted((r["source"], r["target"]) for r in url_filter.links(pages).collect())
    plain = lambda u: u.replace("HTTP:", "http:").replace("A.Example.ORG", "a.example.org").partition("#")[0]
    assert found == sorted((plain(u), t) for _, u, _, to, _ in PLANTED for t in to)
    got = url_filter.judge(pages)
    by_row = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got.collect())
    want = []
    for i, url, _, _, method in PLANTED:
        rest = (url or "").partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        rule, says = plain_rule(host.lower(), slash + path)
        want.append((i or 0, host.lower(), slash + path, rule or "", says or method))
    assert by_row == sorted(want)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert rows(got.toPandas()) == rows(con.sql(registry.oracle_sql()["op13_url_filter"]).df())


def test_rules_as_a_table_say_the_same(spark, pages):
    rules = spark.createDataFrame([*url_filter.RULES, ("x.net", "", "allow"), ("net", "/", "block")], "host string, path string, verdict string")
    more = [*url_filter.RULES, ("x.net", "", "allow")]
    assert rows(url_filter.judge(pages, rules).toPandas()) == rows(url_filter.judge(pages, more).toPandas())
    with pytest.raises(ValueError, match="table"):
        url_filter.judge(pages, [("a", str(i), "block") for i in range(1001)])


def test_redirects_long_chains_and_a_hot_address(spark):
    """Components against union-find: a chain in shuffled order, a star whose centre is neither first nor last, many pairs."""
    order = [(i * 7919) % 500 for i in range(500)]
    edges = [(f"http://c.org/{order[i]}", f"http://c.org/{order[i + 1]}") for i in range(499)]
    edges += [(f"http://s.org/{i}", "http://s.org/300") for i in range(600)] + [(f"http://p.org/{i}", f"http://p.org/{i}a") for i in range(100)]
    edges += [("http://c.org/499", "http://blocked.net/1"), ("http://s.org/5", "http://example.net/en/1"), ("http://s.org/9", "http://blocked.net/2"), (None, "http://a.org/"), ("x", None)]
    redirects = spark.createDataFrame(edges, "source string, target string")
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        if a and b and a != b:
            up[top(a)] = top(b)
    groups = {}
    for x in list(up):
        groups.setdefault(top(x), set()).add(x)
    pairs = redirects.dropna().filter("source <> 'x'").selectExpr("source as a", "target as b")
    got = {}
    for r in url_filter.components(pairs).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(sorted(up))], "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, redirects=redirects).collect()}
    for i, u in enumerate(sorted(up)):
        want = "block" if "/c.org" in u or "blocked" in u else "allow"
        assert verdicts[i] == want, u


def test_empty_and_clashing(spark, pages):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(none).count() == 0
    from pyspark.sql import functions as F

    names = ["host", "path", "fits", "rule", "verdict", "node", "_node", "alias", "source", "target", "tag", "label"]
    assert rows(url_filter.judge(pages.select("*", *(F.lit(1).alias(n) for n in names))).toPandas()) == rows(url_filter.judge(pages).toPandas())
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000, "<p>canonical " + "y " * 500_000 + "</p>" + "<!-- " * 50_000 + "<link rel=canonical href='http://b.net/'>")], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filter.judge(long).collect()] == ["allow"]  # the comment never ends
