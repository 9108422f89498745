"""URL filter with redirect equivalence.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Urls tied by redirects or canonical links are aliases, and so are the forms of one url that commonly redirect to each other,
which share a node: connected components over nodes carry a block to aliases without a rule of their own. An explicit allow
in the component comes first, and a url's own rule before all.

Null urls, and urls without ``://``, have an empty host and path; no rule fits them and they have no aliases. Null and empty
pages have no links; a very long page is searched where it is read. Repeated
rows get a row each, repeated rules count once, and of equally long rules allow wins. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import components, lower_ascii, meet, only, stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Parameters that only trace where a visitor came from.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid)="


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """One name for the forms of a url that commonly redirect to each other: http and https, with and without ``www.``, a
    default port, slashes at the path's end, a fragment and tracking parameters. Null without a host."""
    u = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(url_host(u), r":(80|443)$", ""), r"^www\.", "")
    scheme = F.lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(u, r"(?s)^.*?://[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    name = F.concat(F.when(scheme.isin("http", "https"), "").otherwise(F.concat(scheme, F.lit("://"))), host, F.regexp_replace(url_path(u), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when((F.locate("://", url) > 0) & (host != ""), name)


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as an absolute url: absolute, from the scheme, from the host's root, a query alone, or relative to
    the page's path, with ``.`` and ``..`` taken out. Null for other schemes, such as mail, and for fragments."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(bare, r"(?s)^.*?://[^/]*(/(?:.*/)?)", 1)
    rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0)
    parts = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), rest), "/")
    none = F.array().cast("array<string>")
    path = F.aggregate(parts, none, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    relative = F.concat(origin, F.array_join(path, "/"), F.regexp_replace(link, r"(?s)^[^?#]*", ""))
    return (
        F.when(F.locate("://", link) > 0, link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(bare, link)).when(link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(relative)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``src, dst``: canonical links and meta refreshes of pages, each of them. Only pages that name one are searched."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'>\s]+)", 1)
    head = only(pages, "url", "html").where(F.locate("://", url) > 0).where(html.rlike(r"(?i)canonical|http-equiv"))
    canon = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b)"))
    fresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    to = F.concat(F.transform(canon, lambda t: attr(t, "href")), F.transform(fresh, lambda t: attr(t, "url")))
    each = head.select(url.alias("src"), F.explode(to).alias("link")).where("link <> ''")
    plain = F.regexp_replace(F.col("link"), r"(?i)&(?:amp|#38|#x26);", "&")
    return each.select("src", resolved(plain, F.col("src")).alias("dst")).where("dst is not null")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` of each distinct (host, path) that a rule fits. A host meets the rules of
    its own name and of each name it lies under, by equi-join."""
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(above).alias("_h"))
    met = each.join(r, "_h").where(F.col("path").startswith(F.col("_p")))
    rule = F.concat("_h", "_p")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("_v") == "allow").cast("int").alias("a"), rule.alias("rule"), F.col("_v").alias("v"))).alias("m")
    return met.groupBy("host", "path").agg(best).select("host", "path", F.col("m.rule").alias("rule"), F.col("m.v").alias("rule_verdict"))


def alias_verdicts(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, alias_verdict``: what a url inherits: allow if its component has an explicit allow, else block if it has a
    block. ``urls`` are ``node, rule_verdict`` of all urls known, ``edges`` are ``src, dst`` nodes. Nodes without a
    verdict have no row."""
    said = lambda v: F.max((F.col("rule_verdict") == v).cast("int"))
    flags = urls.where("node is not null").groupBy("node").agg(said("allow").alias("a"), said("block").alias("b"))
    links = stored(edges.where("src is not null and dst is not null and src <> dst").distinct())
    if not links.isEmpty():
        comp = stored(components(links, "src", "dst"))
        tied = stored(flags.join(comp, "node", "full").withColumn("component", F.coalesce("component", "node")))
        whole = tied.groupBy("component").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))
        flags = meet(tied.select("node", "component"), stored(whole), "component", "n")
    return flags.select("node", F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").alias("alias_verdict")).where("alias_verdict is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, by`` of each page; ``by`` is rule, alias or default. ``redirects(src,
    dst)`` adds edges known from elsewhere, such as HTTP redirects."""
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(only(redirects, "src", "dst"))
    edges = stored(edges)
    parted = lambda df: df.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "node": url_node(F.col("url"))})
    rows = parted(only(pages, "page_id", "url").withColumn("url", F.col("url").cast("string")))
    rows = stored(rows.join(fitting_rules(rows, rules), ["host", "path"], "left").drop("url"))
    ends = parted(edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct())
    known = rows.select("node", "rule_verdict").unionByName(ends.join(fitting_rules(ends, rules), ["host", "path"], "left").select("node", "rule_verdict"))
    verdicts = alias_verdicts(known, edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")))
    own, open_ = rows.where("rule is not null"), rows.where("rule is null")
    out = own.withColumn("alias_verdict", F.lit(None).cast("string")).unionByName(open_.join(verdicts, "node", "left"))
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"), by.alias("by"))
