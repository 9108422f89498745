"""Url filter against a plain version: rules by hand, aliases by a union-find."""

import re

import duckdb

from pairlace.llm import url_filter
from pairlace.llm.queries import QUERIES, RULES, SQL


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules):
    fit = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, 0, None, None))[2:]


def node(url):
    """The name that redirecting forms of a url share, by hand."""
    host, path = parts((url or "").split("#")[0])
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", host))
    if not host:
        return None
    scheme, _, rest = url.split("#")[0].partition("://")
    query = "&".join(x for x in rest.partition("?")[2].split("&") if x and not re.match("(?i)(utm_[a-z]+|gclid|fbclid|msclkid)=", x))
    return ("" if scheme.lower() in ("http", "https") else scheme.lower() + "://") + host + path.rstrip("/") + ("?" + query if query else "")


def brute(pages, rules, links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(node(a))] = root(node(b))
    groups = {}
    for u in {u for _, u in pages} | {x for e in links for x in e}:
        groups.setdefault(root(node(u)), []).append(rule_of(*parts(u), rules)[1])
    out = []
    for i, url in pages:
        host, path = parts(url)
        rule, v = rule_of(host, path, rules)
        near = groups.get(root(node(url)), []) if node(url) else []
        out.append((i, host, path, rule, v or ("allow" if "allow" in near else "block" if "block" in near else "allow")))
    return sorted(out, key=str)


def judged(spark, pages, rules, links=()):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = spark.createDataFrame(list(links), "src string, dst string") if links else None
    got = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), edges).collect()
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str)


def test_aliases_against_brute_force(spark):
    canon = lambda u: f'<html><LINK href="{u}" rel="canonical">'
    pages = [
        (1, "http://WWW.Example.com/en/1?x", None), (2, "http://mirror.test/a", canon("http://www.example.com/en/1")), (3, "http://mirror.test/b", canon("http://mirror.test/a")),
        (4, "http://example.com/en/77", ""), (5, "http://else.test/c", canon("http://example.com/en/77")), (6, "http://a.org/es/", "<meta http-equiv='refresh' content='0; url=/es2/'>"),
        (7, "http://a.org/es2/", None), (8, "http://a.org/es/", None), (9, None, "x"), (10, "no scheme", canon("http://a.org/es/")), (11, "http://host.example.net/de/8", None), (12, "http://x.net/de/8", None),
        (None, "http://notexample.com/en/7", None), (13, "ftp://com", None), (14, "http://com/en/", canon("http://com/en/")), (15, "http://both.test/1", canon("http://example.com/en/7x")), (15, "http://both.test/1", canon("http://a.org/es/")),
    ]
    links = [("http://mirror.test/a", "http://www.example.com/en/1"), ("http://mirror.test/b", "http://mirror.test/a"), ("http://else.test/c", "http://example.com/en/77"), ("http://a.org/es/", "http://a.org/es2/"), ("http://both.test/1", "http://example.com/en/7x"), ("http://both.test/1", "http://a.org/es/")]
    more = [("http://chain.test/0", "http://com/en/"), *[(f"http://chain.test/{k}", f"http://chain.test/{k + 1}") for k in range(30)]]
    pages += [(100 + k, f"http://chain.test/{k}", None) for k in range(31)]
    want = brute([(i, u) for i, u, _ in pages], RULES, links + more)
    assert judged(spark, pages, RULES, more) == want
    by = {p: v for p, *_, v in want}
    assert by[2] == by[3] == by[130] == "block" and by[5] == "allow" and by[7] == "allow"  # the allowed page's alias has the component's allow


def test_links_of_every_form(spark):
    """Relative links, entities, several tags, tokens in rel, and forms of one url that redirect to each other."""
    head = lambda tag: f"<html><head><link rel=stylesheet href=x.css>{tag}</head>" + "x" * 200_000
    pages = [
        (1, "http://a.test/d/e?q=1", head('<link rel="shortlink canonical" href="../f?a=1&amp;b=2">')), (2, "https://www.a.test:443/f/?a=1&utm_source=x&b=2#top", None),
        (3, "http://b.test/x/y", head("<meta http-equiv=refresh content='5;url=?z=1'><link href='z.html' rel='canonical'>")), (4, "http://b.test/x/y?z=1", None), (5, "http://b.test/x/z.html", None),
        (6, "http://c.test/", head("<link rel=canonical href='mailto:x@y'><link rel=canonical href='#top'><link rel=canonical href='//com/en/'>")), (7, "ftp://c.test", None), (8, "http://C.test:80", None), (9, "http://com/en", None),
    ]
    links = [(pages[0][1], "http://a.test/f?a=1&b=2"), (pages[2][1], pages[3][1]), (pages[2][1], pages[4][1]), (pages[5][1], "http://com/en/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted((r.src, r.dst) for r in url_filter.page_links(df).collect()) == sorted(links)
    rules = [("a.test", "/f", "block"), ("b.test", "/x/z", "block"), ("com", "/en/", "block"), ("b.test", "/x/y?", "allow")]
    want = brute([(i, u) for i, u, _ in pages], rules, links)
    assert judged(spark, pages, rules) == want
    assert {i: v for i, *_, v in want} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block"}


def test_extra_columns_and_the_sql(spark, tmp_path):
    """Columns with names used inside, and the query's SQL on pages that have links."""
    canon = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [(1, "http://x.com/en/1", None), (2, "http://m.test/a/b/c", canon("../../q/./r")), (3, "http://m.test/q/r", canon("https://x.com/en/1/")), (4, "http://m.test/q/r/?utm_campaign=1", ""), (5, "http://example.com/en/7", canon("?p=2&#38;gclid=3")), (6, "http://example.com/en/7?p=2", None), (7, None, None), (8, "http://n.test", canon("http://www.example.com/en/7?p=2"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for name in ("host", "path", "rule", "node", "component", "verdict", "src", "a", "n"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "by").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict, \"by\" FROM ({SQL['op1_url_filter']})").fetchall())
    assert [(r[4], r[5]) for r in got] == [("block", "rule"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("allow", "rule"), ("allow", "rule"), ("allow", "default"), ("allow", "alias")]


def test_edges(spark):
    assert judged(spark, [], RULES) == []
    one = judged(spark, [(1, "http://a.com/en/", None), (1, "http://a.com/en/", None)], RULES)
    assert len(one) == 2 and one[0] == one[1] == (1, "a.com", "/en/", "com/en/", "block")
    tie = [("a.com", "/", "block"), ("a.com", "/", "allow")]
    assert judged(spark, [(1, "http://a.com/x", None)], tie)[0][-1] == "allow"
