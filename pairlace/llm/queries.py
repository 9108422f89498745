"""The operators' registered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlace.llm import decontaminate, filter_audit, language_id, maxent_lm, mixing, near_dedup, phrase_mining, pii, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_changes(expected: str, found: str) -> str:
    """The least edit distance of the string ``expected`` to ``found`` with ``{d}`` from -2 to 2."""
    return "least(" + ", ".join(f"levenshtein({expected}, {found.format(d=d)})" for d in range(-2, 3)) + ")"


# Words of the whole text, and each window of each item, met in DuckDB by the windows' joined words; windows with changes by any
# two words next to each other, then by edit distance before and after them, a letter for each word of the window.
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(list_slice(w, i, i + 9), ' ') s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON bw.s = dw.s AND bw.k = dw.k),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM hit) GROUP BY doc_id),
two AS (SELECT item_id, ws, off, ws[off + 1] a, ws[off + 2] b FROM (SELECT item_id, string_split(s, ' ') ws, unnest([0, 2, 4, 6, 8]) off FROM bw WHERE k = 10)),
dp AS (SELECT doc_id, i, w[i] a, w[i + 1] b, list_slice(w, greatest(i - 10, 1), i + 11) c, least(i, 11) p FROM (SELECT doc_id, w, unnest(range(1, len(w))) i FROM d)),
met AS (SELECT doc_id, item_id, off, p, array_to_string(list_transform(c, lambda x: chr(64 + coalesce(list_position(ws, x), 0)::INT)), '') c, array_to_string(list_transform(ws, lambda x: chr(64 + list_position(ws, x)::INT)), '') s
  FROM dp JOIN two ON two.a = dp.a AND two.b = dp.b),
nr AS (SELECT doc_id, count(DISTINCT item_id) n_near_items FROM met
  WHERE {least_changes("substr(s, 1, off)", "substr(c, least(greatest(p - off + {d}, 1), p)::INT, (p - least(greatest(p - off + {d}, 1), p))::INT)")}
  + {least_changes("substr(s, off + 3, 8 - off)", "substr(c, (p + 2)::INT, greatest(8 - off + {d}, 0)::INT)")} <= 2 GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN nr ON nr.doc_id = d.doc_id LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(s, d):
    c = decontaminate.contamination(read(s, d, "documents"), read(s, d, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


@query("op5_mixing")
def op5_mixing(s, d):
    m = mixing.mixture(read(s, d, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op6_quality")
def op6_quality(s, d):
    q = quality_classifier.score_quality(read(s, d, "documents"), read(s, d, "labels"))
    return q.withColumn("kept", F.col("score") >= 0.5)


@query("op7_sharding")
def op7_sharding(s, d):
    a = sharding.assign_shards(read(s, d, "documents"))
    return a.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
two AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, t) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.v, two.y FROM r JOIN two ON two.x = r.t),
comp AS (SELECT v, min(t) c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.v = d.doc_id"""


@query("op10_near_dedup", OP10_SQL)
def op10_near_dedup(s, d):
    n = near_dedup.near_duplicates(read(s, d, "documents"), width=2, similarity=0.8)
    return n.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def node_sql(url: str) -> str:
    """The url's node: forms that commonly redirect to each other have one."""
    u = f"regexp_replace(trim({url}), '(?s)#.*$', '')"
    host = f"regexp_replace(regexp_replace(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), {UPPER_TO_LOWER}), ':(80|443)$', ''), '^www\\.', '')"
    scheme = f"lower(regexp_extract({u}, '(?s)^(.*?)://', 1))"
    query = f"array_to_string(list_filter(string_split(regexp_extract({u}, '(?s)^.*?://[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}')), '&')"
    path = f"regexp_replace(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"CASE WHEN strpos({url}, '://') > 0 AND {host} <> '' THEN CASE WHEN {scheme} IN ('http', 'https') THEN '' ELSE {scheme} || '://' END || {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


FOLDED = """list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(CASE WHEN dir = '' THEN '/' ELSE dir END || regexp_extract(link, '(?s)^[^?#]*'), '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END)"""
OP1_SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
tag AS (SELECT url, 'href' k, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) t FROM pages WHERE strpos(url, '://') > 0 UNION ALL SELECT url, 'url', unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) FROM pages WHERE strpos(url, '://') > 0),
link AS (SELECT url src, regexp_replace(CASE k WHEN 'href' THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) ELSE regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END, '(?i)&(?:amp|#38|#x26);', '&', 'g') link FROM tag
  WHERE CASE k WHEN 'href' THEN regexp_matches(t, '(?is)\brel\s*=\s*(?:["''][^"''>]*\bcanonical\b|canonical\b)') ELSE regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') END),
base AS (SELECT src, link, regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) origin, regexp_extract(src, '(?s)^(.*?://[^?#]*)', 1) bare, regexp_extract(regexp_extract(src, '(?s)^(.*?://[^?#]*)', 1), '(?s)^.*?://[^/]*(/(?:.*/)?)', 1) dir FROM link WHERE link <> ''),
edge AS (SELECT src, CASE WHEN strpos(link, '://') > 0 THEN link WHEN starts_with(link, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || link WHEN starts_with(link, '/') THEN origin || link WHEN starts_with(link, '?') THEN bare || link
  WHEN starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE origin || array_to_string({FOLDED}, '/') || regexp_replace(link, '(?s)^[^?#]*', '') END dst FROM base),
two AS (SELECT {node_sql("src")} s, {node_sql("dst")} t FROM edge WHERE dst IS NOT NULL UNION SELECT {node_sql("dst")}, {node_sql("src")} FROM edge WHERE dst IS NOT NULL),
u AS (SELECT url FROM pages UNION SELECT src FROM edge WHERE dst IS NOT NULL UNION SELECT dst FROM edge WHERE dst IS NOT NULL),
ruled AS (SELECT url, {node_sql("url")} node, host, path, (SELECT max((length(h || p), CASE v WHEN 'allow' THEN 1 ELSE 0 END, h || p, v)) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) m
  FROM (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {UPPER_TO_LOWER}) host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path FROM u)),
reach(v, t) AS (SELECT node, node FROM ruled WHERE node IS NOT NULL UNION SELECT r.v, two.t FROM reach r JOIN two ON two.s = r.t WHERE two.t IS NOT NULL),
inh AS (SELECT r.v, max(CASE WHEN m[4] = 'allow' THEN 1 ELSE 0 END) a, max(CASE WHEN m[4] = 'block' THEN 1 ELSE 0 END) b FROM reach r JOIN ruled ON ruled.node = r.t GROUP BY r.v)
SELECT page_id, host, path, m[3] AS rule, CASE WHEN m IS NOT NULL THEN m[4] WHEN a = 1 THEN 'allow' WHEN b = 1 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN m IS NOT NULL THEN 'rule' WHEN a = 1 OR b = 1 THEN 'alias' ELSE 'default' END AS by
FROM pages JOIN ruled ON ruled.url IS NOT DISTINCT FROM pages.url LEFT JOIN inh ON inh.v = ruled.node"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(s, d):
    rules = s.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(read(s, d, "pages"), rules)


@query("op3_quality_rules")
def op3_quality_rules(s, d):
    return quality_rules.judge(read(s, d, "documents"))


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


@query("op9_language_id")
def op9_language_id(s, d):
    docs = read(s, d, "documents")
    model = language_id.train(docs.where(fold() != 0))
    return language_id.identify(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), model, ("held_out",))


@query("op4_maxent_lm")
def op4_maxent_lm(s, d):
    return maxent_lm.score(read(s, d, "documents"), fold() == 1)


@query("op8_pii")
def op8_pii(s, d):
    found = pii.find(read(s, d, "documents"), pii.train(pii.labelled_table(s)))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM w, range(1, 6) r(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, g, k, CAST(count(*) AS HUGEINT) n FROM g GROUP BY lang, g, k HAVING count(*) >= 100),
sub AS (SELECT lang, string_split(g, ' ') s, k, n FROM f WHERE k > 2),
inner_ AS (SELECT lang, array_to_string(list_slice(s, i, i + m - 1), ' ') g, max(n) m FROM sub, range(2, 5) a(m), range(1, 5) b(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
c AS (SELECT f.lang, f.g, f.k, f.n a, string_split(f.g, ' ') s FROM f LEFT JOIN inner_ x ON x.lang = f.lang AND x.g = f.g WHERE f.k > 1 AND (x.m IS NULL OR 100 * x.m < 100 * f.n)),
cut AS (SELECT c.lang, c.g, c.a, q.cut, l.n l, r.n r, tot.n, (1000 * c.a * tot.n) // (l.n * r.n) score FROM c JOIN range(1, 5) q(cut) ON q.cut < c.k
  JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.s[1:q.cut], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.s[q.cut + 1:], ' ') JOIN tot ON tot.lang = c.lang),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) o FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) rank FROM worst WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


@query("op11_phrase_mining", OP11_SQL)
def op11_phrase_mining(s, d):
    return phrase_mining.collocations(read(s, d, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, min(doc_id) OVER (PARTITION BY t) m FROM d),
f AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > m, false)::INT mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) g, max((toxic = 1)::INT) x FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) n, sum(coalesce(g, 0)) g, sum(coalesce(x, 0)) x FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) f, unnest([1, 2, 4, 8, 16]) b),
orders AS (SELECT o.f || p.f || q.f || r.f || s.f o, [o.b, p.b, q.b, r.b, s.b] bs FROM letters o JOIN letters p ON p.f <> o.f JOIN letters q ON q.f NOT IN (o.f, p.f) JOIN letters r ON r.f NOT IN (o.f, p.f, q.f) JOIN letters s ON s.f NOT IN (o.f, p.f, q.f, r.f)),
steps AS (SELECT o, s step, bs[s] b, coalesce(list_sum(bs[1:s - 1]), 0) pre FROM orders, range(1, 6) t(s)),
r AS (SELECT part, o, step, b, sum(CASE WHEN mask & (pre + b)::BIGINT = 0 THEN n ELSE 0 END) kept, sum(CASE WHEN mask & pre::BIGINT = 0 AND mask & b > 0 THEN n ELSE 0 END) removed,
  sum(CASE WHEN mask & pre::BIGINT > 0 AND mask & b > 0 THEN n ELSE 0 END) redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END) unique_fails,
  sum(CASE WHEN mask & pre::BIGINT = 0 AND mask & b > 0 THEN g ELSE 0 END) good_lost, sum(CASE WHEN mask & pre::BIGINT = 0 AND mask & b > 0 THEN x ELSE 0 END) toxic_lost FROM c, steps GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(s, d):
    return filter_audit.audit(read(s, d, "documents"), read(s, d, "labels"))


# Each string of 50 bytes as 100 hexadecimal digits, cut from parts of 500 starts, met by equality; runs of places that are not removed by islands.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
part AS (SELECT k, doc_id, i, substr(h, 1000 * i + 1, 1098) b FROM (SELECT k, doc_id, h, unnest(range(0, length(h) // 1000 + 1)) i FROM d)),
s AS (SELECT k, doc_id, 500 * i + p p, substr(b, 2 * p + 1, 100) s FROM (SELECT k, doc_id, i, b, unnest(range(0, greatest(length(b) // 2 - 49, 0))) p FROM part)),
m AS (SELECT s, min(doc_id) m FROM s GROUP BY s HAVING count(*) > 1),
hit AS (SELECT k, p, p - lag(p) OVER (PARTITION BY k ORDER BY p) gap FROM s JOIN m ON m.s = s.s WHERE s.doc_id > m.m),
run AS (SELECT k, p, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) r FROM hit),
span AS (SELECT k, min(p) a, max(p) + 50 b FROM run GROUP BY k, r),
edge AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) c FROM span),
cut AS (SELECT e.k, sum(b - a) n, count(*) s, string_agg(substr(d.h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) kept, max(b) z FROM edge e JOIN d ON d.k = e.k GROUP BY e.k)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.k = d.k"""


@query("op13_suffix_dedup", OP13_SQL)
def op13_suffix_dedup(s, d):
    return suffix_dedup.dedup(read(s, d, "documents"))
