"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlace.config import CouplingConfig
from pairlace.functions import scalars as fn
from pairlace.functions.sql_surface import register
from pairlace.operators import alignment as al
from pairlace.operators import aracne as ar
from pairlace.operators import mi as m
from pairlace.operators import outliers as ou
from pairlace.operators import plotdata as pl
from pairlace.operators import threshold as th
from pairlace.operators import weights as we
from pairlace.operators.lineage import shared_copy
from pairlace.operators.packed import pack
from pairlace.plans.fixtures import from_documents, from_embeddings, from_lineitem, from_parts, wide_lineitem
from pairlace.plans.pipeline import Network, analyse
from pairlace.sources import readers, writers

GENOME, LD, KEEP, TOP, TOL = 64, 2, 200, 200, 1e-9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL building blocks -------------------------------------------------------------------------------------

E1 = """cells AS (SELECT CAST(vec_id AS BIGINT) AS sample, CAST(p AS INTEGER) AS pos,
  CASE WHEN abs(x) < 0.02 THEN 4 WHEN x < -0.08 THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.08 THEN 2 ELSE 3 END AS state
  FROM (SELECT vec_id, p, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(p)) t)"""
SYMBOL = "CASE upper(c) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS state"
E2 = f"""cells AS (SELECT CAST(doc_id AS BIGINT) AS sample, CAST(p AS INTEGER) AS pos, {SYMBOL}
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) p FROM documents) t)"""
E4 = f"""txt AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) t FROM part), longest AS (SELECT max(length(t)) m FROM txt),
  cells AS (SELECT CAST(p_partkey AS BIGINT) AS sample, CAST(p AS INTEGER) AS pos, {SYMBOL}
  FROM (SELECT p_partkey, substring(t, p, 1) c, p FROM (SELECT p_partkey, t, unnest(range(1, m + 1)) p FROM txt, longest) u) v)"""
E3 = """rows_ AS (SELECT CAST(l_orderkey AS BIGINT) * 1000 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS sample,
    l_returnflag rf, l_linestatus ls, CAST(l_linenumber AS INTEGER) ln, CAST(l_discount AS DOUBLE) di, CAST(l_tax AS DOUBLE) tx, CAST(l_quantity AS DOUBLE) q FROM lineitem),
  cells AS (SELECT sample, p AS pos, state FROM (
    SELECT sample, 1 p, CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END state FROM rows_ UNION ALL
    SELECT sample, 2, CASE WHEN ls = 'F' THEN 0 ELSE 1 END FROM rows_ UNION ALL SELECT sample, 3, ln % 5 FROM rows_ UNION ALL
    SELECT sample, 4, CAST(floor(di * 100 + 0.5) AS INTEGER) % 4 FROM rows_ UNION ALL
    SELECT sample, 5, CAST(floor(tx * 100 + 0.5) AS INTEGER) % 5 FROM rows_ UNION ALL
    SELECT sample, 6, CAST(floor(q) AS INTEGER) % 4 FROM rows_ UNION ALL
    SELECT sample, 7, CASE WHEN rf = 'A' THEN 0 WHEN ls = 'F' THEN 1 ELSE 2 END FROM rows_ UNION ALL
    SELECT sample, 8, CASE WHEN ls = 'F' THEN ln % 5 ELSE 3 END FROM rows_) u)"""
PROFILE = """prof AS (SELECT pos, count(*) n, sum(CASE WHEN state = 4 THEN 1 ELSE 0 END) n_gap,
    sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) c0, sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) c1,
    sum(CASE WHEN state = 2 THEN 1 ELSE 0 END) c2, sum(CASE WHEN state = 3 THEN 1 ELSE 0 END) c3 FROM cells GROUP BY pos),
  prof2 AS (SELECT pos, CAST(n AS BIGINT) n, CAST(n_gap AS BIGINT) n_gap, CAST((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT AS INTEGER) alleles,
    CAST(c0 + c1 + c2 + c3 - greatest(c0, c1, c2, c3) - (SELECT s[1] + s[2] FROM (SELECT list_sort([c0, c1, c2, c3]) s) z) AS BIGINT) AS second FROM prof),
  kept AS (SELECT * FROM prof2 WHERE alleles > 1 AND second >= 0.01 * n AND n_gap <= 0.15 * n)"""
FREE = "freecells AS (SELECT * FROM cells WHERE state <> 4)"


def xt_sql(name: str = "xt", cells: str = "cells", weights: str | None = None) -> str:
    w = f" JOIN {weights} w ON w.sample = l.sample" if weights else ""
    s = "sum(w.weight)" if weights else "CAST(count(*) AS DOUBLE)"
    return f"""{name} AS MATERIALIZED (SELECT l.pos i, r.pos j, l.state a, r.state b, {s} n FROM {cells} l JOIN {cells} r ON l.sample = r.sample AND l.pos < r.pos{w} GROUP BY 1, 2, 3, 4)"""


def mi_sql(name: str = "mi", xt: str = "xt", cells: str = "cells", alpha: float = 0.5, digits: int | None = 6) -> str:
    """MI from the full grid of states present, each cell with the pseudocount."""
    value = "sum(p * ln(p / (pa * pb)))"
    value = f"round({value}, {digits})" if digits is not None else value
    return f"""{name}_pres AS (SELECT DISTINCT pos, state FROM {cells}),
  {name}_pairs AS (SELECT DISTINCT i, j FROM {xt}),
  {name}_grid AS (SELECT g.i, g.j, pa_.state a, pb_.state b, coalesce(x.n, 0) + {alpha} n FROM {name}_pairs g
    JOIN {name}_pres pa_ ON pa_.pos = g.i JOIN {name}_pres pb_ ON pb_.pos = g.j
    LEFT JOIN {xt} x ON x.i = g.i AND x.j = g.j AND x.a = pa_.state AND x.b = pb_.state),
  {name}_p AS (SELECT i, j, a, b, n / sum(n) OVER (PARTITION BY i, j) p, sum(n) OVER (PARTITION BY i, j, a) / sum(n) OVER (PARTITION BY i, j) pa,
    sum(n) OVER (PARTITION BY i, j, b) / sum(n) OVER (PARTITION BY i, j) pb FROM {name}_grid),
  {name} AS MATERIALIZED (SELECT i, j, {value} mi FROM {name}_p WHERE p > 0 GROUP BY i, j)"""


def weights_sql(theta: float, cells: str = "cells") -> str:
    return f"""ham AS (SELECT l.sample s, r.sample t, count(*) k, sum(CASE WHEN l.state = r.state THEN 1 ELSE 0 END) same FROM {cells} l JOIN {cells} r ON l.pos = r.pos AND l.sample < r.sample GROUP BY 1, 2),
  near AS (SELECT s sample FROM ham WHERE same >= {theta} * k - 1e-6 UNION ALL SELECT t FROM ham WHERE same >= {theta} * k - 1e-6 UNION ALL SELECT DISTINCT sample FROM {cells}),
  wts AS (SELECT sample, 1.0 / count(*) weight FROM near GROUP BY sample)"""


DIST = f"least(abs(i - j), {GENOME} - abs(i - j))"
EDGES = f"edges AS (SELECT i, j, mi, CAST({DIST} AS BIGINT) distance FROM mi)"
MAXIMA = f"""maxima AS (SELECT pos, max(mi) mi FROM (SELECT i pos, mi FROM edges WHERE distance > {LD} UNION ALL SELECT j, mi FROM edges WHERE distance > {LD}) u GROUP BY pos)"""
FENCES = """ranked AS (SELECT mi, row_number() OVER (ORDER BY mi) rn, count(*) OVER () n FROM maxima),
  q AS (SELECT max(CASE WHEN rn = (n // 4) * 1 + 1 THEN mi END) q1, max(CASE WHEN rn = (n // 4) * 3 + 1 THEN mi END) q3 FROM ranked),
  fences AS (SELECT q1, q3, q3 + 1.5 * (q3 - q1) outlier, q3 + 3 * (q3 - q1) extreme FROM q)"""
def HASH(i: str, j: str, it: str) -> str:  # noqa: N802
    h = f"(({i} * 73856093 + {j} * 19349663 + {it} * 83492791 + 17) % 2147483647)"
    for add in (48271, 69621):
        h = f"(({h} * {h} + {add}) % 2147483647)"
    return h


def draws_sql(n: int = GENOME, keep: int = KEEP, iterations: int = 10) -> str:
    drawn = fn.sample_pair_count(n, keep)
    return f"""dr AS (SELECT it, d, {HASH("d", "1", "it")} % {n} u, {HASH("d", "2", "it")} % {n} v FROM range(1, {2 * drawn + 101}) r(d), range(1, {iterations + 1}) s(it)),
  un AS (SELECT it, least(u, v) u, greatest(u, v) v, min(d) d FROM dr WHERE u <> v GROUP BY 1, 2, 3),
  rk AS (SELECT it, u, v, row_number() OVER (PARTITION BY it ORDER BY d) rn FROM un),
  drawn AS (SELECT CAST(it AS INTEGER) AS iter, CAST(u + 1 AS INTEGER) i, CAST(v + 1 AS INTEGER) j FROM rk WHERE rn <= {drawn})"""


def tau_sql(n: int = GENOME, keep: int = KEEP, iterations: int = 10) -> str:
    idx = fn.percentile_index(n, keep, fn.sample_pair_count(n, keep))
    return f"""tv AS (SELECT iter, mi, row_number() OVER (PARTITION BY iter ORDER BY mi) rn FROM drawn JOIN mi USING (i, j)),
  tm AS (SELECT mi, row_number() OVER (ORDER BY mi) rn FROM tv WHERE rn = {idx + 1}),
  tau AS (SELECT mi threshold FROM tm WHERE rn = {fn.lower_median_index(iterations) + 1})"""


def aracne_sql(edges: str = "edges") -> str:
    return f"""tri AS (SELECT x.i a, x.j b, y.j c, x.mi m_ab, y.mi m_ac, z.mi m_bc FROM {edges} x JOIN {edges} y ON x.i = y.i AND x.j < y.j JOIN {edges} z ON z.i = x.j AND z.j = y.j),
  lows AS (SELECT *, list_sort([m_ab, m_ac, m_bc]) s FROM tri),
  hits AS (SELECT a i, b j FROM lows WHERE s[2] - s[1] >= {TOL} AND m_ab = s[1] UNION SELECT a, c FROM lows WHERE s[2] - s[1] >= {TOL} AND m_ac = s[1] UNION SELECT b, c FROM lows WHERE s[2] - s[1] >= {TOL} AND m_bc = s[1]),
  flagged AS (SELECT e.*, CASE WHEN h.i IS NULL THEN 1 ELSE 0 END direct FROM {edges} e LEFT JOIN hits h ON h.i = e.i AND h.j = e.j)"""


TOP_SQL = f"top AS (SELECT i, j, mi, distance FROM edges ORDER BY mi DESC, i, j LIMIT {TOP})"
WO = ", ".join([FREE, xt_sql("xf", "freecells"), mi_sql("miw", "xf", "freecells")])


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n  ".join(parts) + f"\nSELECT {select}"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# ---- shared Spark frames -------------------------------------------------------------------------------------

def e1_mi(s: SparkSession, d: str) -> DataFrame:
    return m.mi_pairs(from_embeddings(s, d)).withColumn("mi", F.round("mi", 6))


def e1_edges(s: SparkSession, d: str) -> DataFrame:
    return e1_mi(s, d).withColumn("distance", fn.circular_distance(F.col("i"), F.col("j"), GENOME))


def e1_fences(s: SparkSession, d: str) -> DataFrame:
    return ou.outlier_thresholds(ou.column_max(e1_edges(s, d), LD))


def e1_top(s: SparkSession, d: str) -> DataFrame:
    return th.top_edges(e1_edges(s, d), TOP)


def e1_couplings(s: SparkSession, d: str) -> DataFrame:
    flagged = ar.aracne(e1_edges(s, d), TOL)
    return flagged.select(F.col("i").alias("pos1"), F.col("j").alias("pos2"), "distance", F.col("direct").cast("int").alias("direct"), "mi")


def ints(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


# ---- the queries ---------------------------------------------------------------------------------------------

@query("symbol_states", with_(E2, select="pos, CAST(state AS INTEGER) AS state, count(*) AS n FROM cells GROUP BY pos, state"))
def symbol_states(s, d):
    return ints(from_documents(s, d).groupBy("pos", "state").agg(F.count("*").alias("n")), "state")


@query("alignment_cells", with_(E1, select="sample, pos, CAST(state AS INTEGER) AS state FROM cells"))
def alignment_cells(s, d):
    return ints(from_embeddings(s, d), "state")


@query("state_frequencies", with_(E1, select="pos, CAST(state AS INTEGER) AS state, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY pos) AS DOUBLE), 6) AS freq FROM cells GROUP BY pos, state"))
def state_frequencies(s, d):
    return ints(al.state_frequencies(from_embeddings(s, d)).withColumn("freq", F.round("freq", 6)), "state")


@query("state_presence", with_(E3, select="pos, CAST(bit_or(1 << state) AS INTEGER) AS mask, CAST(bit_or(CASE WHEN state <> 4 THEN 1 << state ELSE 0 END) AS INTEGER) AS mask_wo_gaps FROM cells GROUP BY pos"))
def state_presence(s, d):
    return al.state_presence(from_lineitem(s, d))


@query("gap_presence", with_(E3, select="pos, max(CASE WHEN state = 4 THEN 1 ELSE 0 END) AS has_gap FROM cells GROUP BY pos"))
def gap_presence(s, d):
    return al.gap_presence(from_lineitem(s, d))


for _name, _cells, _frame in (("position_filter", E1, from_embeddings), ("position_filter_lines", E3, from_lineitem)):
    query(_name, with_(_cells, PROFILE, select="pos, n, n_gap, alleles, second FROM kept"))(lambda s, d, f=_frame: al.position_filter(f(s, d)))


@query("position_filter_text", with_(E2, PROFILE.replace("n_gap <= 0.15 * n", "n_gap <= 0.75 * n"), select="pos, n, n_gap, alleles, second FROM kept"))
def position_filter_text(s, d):
    """Most characters of a text are gaps, so the share allowed is wider than the default."""
    return al.position_filter(from_documents(s, d), gap=0.75)


LOCI = "SELECT p AS pos FROM range(1, 65) r(p) WHERE p % 3 = 1"


def third_loci(s: SparkSession) -> DataFrame:
    return s.range(1, GENOME + 1).where("id % 3 = 1").select(F.col("id").cast("int").alias("pos"))


@query("include_loci", with_(E1, select=f"pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS s FROM cells WHERE pos IN ({LOCI}) GROUP BY pos"))
def include_loci(s, d):
    return al.include_loci(from_embeddings(s, d), third_loci(s)).groupBy("pos").agg(F.count("*").alias("n"), F.sum("state").alias("s"))


@query("exclude_loci", with_(E1, select=f"pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS s FROM cells WHERE pos NOT IN ({LOCI}) GROUP BY pos"))
def exclude_loci(s, d):
    return al.exclude_loci(from_embeddings(s, d), third_loci(s)).groupBy("pos").agg(F.count("*").alias("n"), F.sum("state").alias("s"))


@query("subsample", with_(E1, select="pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS s FROM cells WHERE sample IN (SELECT CAST(vec_id AS BIGINT) FROM embeddings WHERE label % 2 = 0) GROUP BY pos"))
def subsample(s, d):
    keep = s.read.parquet(f"{d}/embeddings.parquet").where("label % 2 = 0").select(F.col("vec_id").cast("long").alias("sample"))
    return al.subsample(from_embeddings(s, d), keep).groupBy("pos").agg(F.count("*").alias("n"), F.sum("state").alias("s"))


@query("loci_translation", with_(E1, PROFILE, select="CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS idx, pos FROM kept"))
def loci_translation(s, d):
    return al.loci_index(al.filter_positions(from_embeddings(s, d)), 1)


@query("alignment_statistics", with_(E1, "k AS (SELECT pos, count(*) n, sum(CASE WHEN state = 4 THEN 1 ELSE 0 END) g, count(DISTINCT state) k FROM cells GROUP BY pos)", select="count(*) AS n_loci, CAST(sum(n) AS BIGINT) AS n_cells, round(sum(g) / CAST(sum(n) AS DOUBLE), 6) AS gap_share, " + ", ".join(f"CAST(sum(CASE WHEN k = {k} THEN 1 ELSE 0 END) AS BIGINT) AS loci_{k}_states" for k in range(1, 6)) + ", (SELECT count(DISTINCT sample) FROM cells) AS n_samples FROM k"))
def alignment_statistics(s, d):
    return al.alignment_statistics(from_embeddings(s, d))


@query("hamming_distances", with_(E1, select="l.sample AS s, r.sample AS t, count(*) AS n_loci, CAST(sum(CASE WHEN l.state <> r.state THEN 1 ELSE 0 END) AS BIGINT) AS distance FROM cells l JOIN cells r ON l.pos = r.pos AND l.sample < r.sample GROUP BY 1, 2"))
def hamming_distances(s, d):
    return we.hamming_distances(from_embeddings(s, d))


@query("sample_weights", with_(E1, weights_sql(0.35), select="sample, round(weight, 6) AS weight FROM wts"))
def sample_weights(s, d):
    return we.sample_weights(from_embeddings(s, d), 0.35).withColumn("weight", F.round("weight", 6))


@query("sample_weights_text", with_(E4, weights_sql(0.9), select="sample, round(weight, 6) AS weight FROM wts"))
def sample_weights_text(s, d):
    return we.sample_weights(from_parts(s, d), 0.9).withColumn("weight", F.round("weight", 6))


@query("effective_size", with_(E1, weights_sql(0.35), select="round(sum(weight), 6) AS effective_size FROM wts"))
def effective_size(s, d):
    return we.effective_size(we.sample_weights(from_embeddings(s, d), 0.35))


@query("crosstable", with_(E1, xt_sql(), select="i, j, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, n FROM xt"))
def crosstable(s, d):
    return ints(m.crosstable(from_embeddings(s, d)), "a", "b")


@query("crosstable_weighted", with_(E1, weights_sql(0.35), xt_sql(weights="wts"), select="i, j, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(n, 6) AS n FROM xt"))
def crosstable_weighted(s, d):
    c = from_embeddings(s, d)
    return ints(m.crosstable(c, we.sample_weights(c, 0.35)).withColumn("n", F.round("n", 6)), "a", "b")


@query("mi_all_pairs", with_(E1, xt_sql(), mi_sql(), select="i, j, mi FROM mi"))
def mi_all_pairs(s, d):
    return e1_mi(s, d)


@query("mi_sparse", with_(E1, xt_sql(), mi_sql(), select="i, j, mi FROM mi"))
def mi_sparse(s, d):
    return m.mi_pairs(from_embeddings(s, d), plan="sparse").withColumn("mi", F.round("mi", 6))


@query("mi_block", with_(E1, xt_sql(), mi_sql(), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi FROM mi"))
def mi_block(s, d):
    return m.block_mi(from_embeddings(s, d), block=16).where("kind = 'edge'").select("i", "j", F.round("mi", 6).alias("mi"))


@query("mi_lines", with_(E3, xt_sql(), mi_sql(), select="i, j, mi FROM mi"))
def mi_lines(s, d):
    return m.mi_pairs(from_lineitem(s, d)).withColumn("mi", F.round("mi", 6))


@query("mi_weighted", with_(E1, weights_sql(0.35), xt_sql(weights="wts"), mi_sql(), select="i, j, mi FROM mi"))
def mi_weighted(s, d):
    c = from_embeddings(s, d)
    return m.mi_pairs(c, we.sample_weights(c, 0.35)).withColumn("mi", F.round("mi", 6))


@query("mi_single_pairs", with_(E1, xt_sql(), mi_sql(), draws_sql(), select="DISTINCT i, j, mi FROM mi JOIN drawn USING (i, j) WHERE iter = 1"))
def mi_single_pairs(s, d):
    c = from_embeddings(s, d)
    pairs = th.sampled_pairs(c.select("pos").distinct(), 1, fn.sample_pair_count(GENOME, KEEP)).select("i", "j")
    return m.mi_pairs(c, pairs=pairs).select("i", "j", F.round("mi", 6).alias("mi"))


@query("mi_without_gaps", with_(E1, WO, select="i, j, mi AS mi_wo_gaps FROM miw"))
def mi_without_gaps(s, d):
    c = from_embeddings(s, d)
    return m.mi_without_gaps(c, e1_mi(s, d)).withColumn("mi_wo_gaps", F.round("mi_wo_gaps", 6))


@query("gap_effect", with_(E1, xt_sql(), mi_sql(), WO, EDGES, select="t.i, t.j, t.mi, coalesce(miw.mi, t.mi) AS mi_wo_gaps, round((1 - coalesce(miw.mi, t.mi) / t.mi) * 100, 4) AS gap_effect FROM edges t LEFT JOIN miw ON miw.i = t.i AND miw.j = t.j"))
def gap_effect(s, d):
    edges = shared_copy(e1_mi(s, d).select("i", "j", "mi"))
    free = m.mi_without_gaps(from_embeddings(s, d), edges).withColumn("mi_wo_gaps", F.round("mi_wo_gaps", 6))
    return m.with_gap_effect(edges, free).withColumn("gap_effect", F.round("gap_effect", 4))


@query("distance_linear", with_(E1, xt_sql(), select="DISTINCT i, j, CAST(abs(i - j) AS BIGINT) AS distance FROM xt"))
def distance_linear(s, d):
    return e1_mi(s, d).select("i", "j", fn.linear_distance(F.col("i"), F.col("j")).alias("distance"))


@query("distance_circular", with_(E1, xt_sql(), select=f"DISTINCT i, j, CAST({DIST} AS BIGINT) AS distance FROM xt"))
def distance_circular(s, d):
    return e1_edges(s, d).select("i", "j", "distance")


@query("column_max", with_(E1, xt_sql(), mi_sql(), EDGES, MAXIMA, select="pos, mi FROM maxima"))
def column_max(s, d):
    return ou.column_max(e1_edges(s, d), LD)


@query("outlier_thresholds", with_(E1, xt_sql(), mi_sql(), EDGES, MAXIMA, FENCES, select="q1, q3, round(outlier, 6) AS outlier, round(extreme, 6) AS extreme FROM fences"))
def outlier_thresholds(s, d):
    return e1_fences(s, d).select("q1", "q3", F.round("outlier", 6).alias("outlier"), F.round("extreme", 6).alias("extreme"))


@query("sampled_pairs", with_(draws_sql(), select="iter, i, j FROM drawn"))
def sampled_pairs(s, d):
    return th.sampled_pairs(from_embeddings(s, d).select("pos"), 10, fn.sample_pair_count(GENOME, KEEP))


@query("mi_threshold", with_(E1, xt_sql(), mi_sql(), draws_sql(), tau_sql(), select="threshold FROM tau"))
def mi_threshold(s, d):
    return th.estimate_threshold(from_embeddings(s, d), None, KEEP, digits=6)


@query("saved_edges", with_(E1, xt_sql(), mi_sql(), draws_sql(), tau_sql(), select="i, j, mi FROM mi WHERE mi > (SELECT threshold FROM tau)"))
def saved_edges(s, d):
    tau = th.estimate_threshold(from_embeddings(s, d), None, KEEP, digits=6).first()[0]
    return th.saved_edges(e1_mi(s, d), tau)


@query("top_edges", with_(E1, xt_sql(), mi_sql(), EDGES, TOP_SQL, select="i, j, mi, distance FROM top"))
def top_edges(s, d):
    return e1_top(s, d).select("i", "j", "mi", "distance")


@query("exact_threshold", with_(E1, xt_sql(), mi_sql(), EDGES, select=f"min(mi) AS threshold FROM (SELECT mi FROM edges ORDER BY mi DESC, i, j LIMIT {KEEP + 1}) t"))
def exact_threshold(s, d):
    return th.exact_threshold(e1_edges(s, d), KEEP)


@query("aracne_triangles", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, m_ab, m_ac, m_bc FROM tri"))
def aracne_triangles(s, d):
    return ar.triangles(shared_copy(e1_edges(s, d)))


@query("aracne_edges", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, direct FROM flagged"))
def aracne_edges(s, d):
    return ar.aracne(e1_mi(s, d).select("i", "j", "mi"), TOL).select("i", "j", "mi", F.col("direct").cast("int").alias("direct"))


@query("aracne_lines", with_(E3, xt_sql(), mi_sql(), "top AS (SELECT i, j, mi FROM mi WHERE mi > 0.01)", aracne_sql("top"), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, direct FROM flagged"))
def aracne_lines(s, d):
    e = m.mi_pairs(from_lineitem(s, d)).withColumn("mi", F.round("mi", 6))
    return ar.aracne(th.saved_edges(e, 0.01), TOL).select("i", "j", "mi", F.col("direct").cast("int").alias("direct"))


COUPLINGS = "CAST(i AS BIGINT) AS pos1, CAST(j AS BIGINT) AS pos2, distance, direct, mi FROM flagged"


@query("couplings", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select=COUPLINGS))
def couplings(s, d):
    return e1_couplings(s, d)


@query("couplings_lines", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="concat_ws(' ', i, j, distance, direct, printf('%.6f', mi)) AS value FROM flagged"))
def couplings_lines(s, d):
    return writers.couplings_lines(e1_couplings(s, d))


OUTLIERS = with_(E1, xt_sql(), mi_sql(), WO, EDGES, MAXIMA, FENCES, TOP_SQL, aracne_sql("edges"), select=f"CAST(e.i AS BIGINT) AS i, CAST(e.j AS BIGINT) AS j, e.distance, e.direct, e.mi, coalesce(miw.mi, e.mi) AS mi_wo_gaps, round((1 - coalesce(miw.mi, e.mi) / e.mi) * 100, 4) AS gap_effect, CASE WHEN e.mi > f.extreme THEN 1 ELSE 0 END AS extreme FROM flagged e CROSS JOIN fences f LEFT JOIN miw ON miw.i = e.i AND miw.j = e.j WHERE e.mi >= f.outlier AND e.distance > {LD}")


@query("outliers", OUTLIERS)
def outliers(s, d):
    edges = shared_copy(e1_edges(s, d))
    found = shared_copy(ou.outliers(ar.aracne(edges, TOL), ou.outlier_thresholds(ou.column_max(edges, LD)), LD))
    free = m.mi_without_gaps(from_embeddings(s, d), found).withColumn("mi_wo_gaps", F.round("mi_wo_gaps", 6))
    out = m.with_gap_effect(found, free).withColumn("gap_effect", F.round("gap_effect", 4))
    return ints(out, "direct", "extreme").select("i", "j", "distance", "direct", "mi", "mi_wo_gaps", "gap_effect", "extreme")


NODES = "nodes AS (SELECT i pos FROM edges CROSS JOIN fences WHERE mi >= outlier UNION SELECT j FROM edges CROSS JOIN fences WHERE mi >= outlier)"


@query("outlier_nodes", with_(E1, xt_sql(), mi_sql(), EDGES, MAXIMA, FENCES, NODES, select="pos FROM nodes"))
def outlier_nodes(s, d):
    edges = shared_copy(e1_edges(s, d))
    return ou.outlier_nodes(edges, ou.outlier_thresholds(ou.column_max(edges, LD)))


@query("outlier_alignment", with_(E1, xt_sql(), mi_sql(), EDGES, MAXIMA, FENCES, NODES, select="sample, pos, CAST(state AS INTEGER) AS state FROM cells WHERE pos IN (SELECT pos FROM nodes)"))
def outlier_alignment(s, d):
    return ints(ou.outlier_alignment(from_embeddings(s, d), outlier_nodes(s, d)), "state")


@query("plot_extent", with_(E1, xt_sql(), mi_sql(), EDGES, TOP_SQL, select="min(mi) AS min_mi, max(mi) AS max_mi, max(distance) AS max_distance, CAST(round(log10(max(distance))) - 1 AS INTEGER) AS exponent FROM top"))
def plot_extent(s, d):
    return pl.plot_extent(e1_couplings(s, d), TOP)


@query("plot_points", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="distance, mi, direct FROM flagged"))
def plot_points(s, d):
    return ints(pl.plot_points(e1_couplings(s, d)), "direct")


# ---- the whole analysis --------------------------------------------------------------------------------------

THETA = 0.35
SETUP = CouplingConfig(mi_values=KEEP, ld_threshold=LD, aracne_tolerance=TOL, reweighting_threshold=THETA, genome_size=GENOME, output_base=0, mi_digits=6, block_loci=16)
KEPT = "c2 AS (SELECT cells.* FROM cells JOIN kept USING (pos))"
#: The estimated threshold over as many loci as the filter keeps: indices as in ``draws_sql``, with its constants counted.
RANKS = "rks AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 k FROM kept)"
COUNTED = f"""par AS (SELECT n, tot, dr, ((tot - {KEEP}) * dr) // tot idx FROM (SELECT n, tot, least(100000, tot // 10) dr FROM (SELECT count(*) n, count(*) * (count(*) - 1) // 2 tot FROM kept) a) b)"""
DRAWN = f"""dr AS (SELECT it, d, {HASH("d", "1", "it")} % n u, {HASH("d", "2", "it")} % n v, dr m FROM (SELECT n, dr, unnest(range(1, 2 * dr + 101)) d FROM par) p, range(1, 11) s(it)),
  un AS (SELECT it, m, least(u, v) u, greatest(u, v) v, min(d) d FROM dr WHERE u <> v GROUP BY 1, 2, 3, 4),
  rk AS (SELECT it, m, u, v, row_number() OVER (PARTITION BY it ORDER BY d) rn FROM un),
  drawn AS (SELECT it AS iter, a.pos i, b.pos j FROM rk JOIN rks a ON a.k = u JOIN rks b ON b.k = v WHERE rn <= m),
  tv AS (SELECT iter, mi, row_number() OVER (PARTITION BY iter ORDER BY mi) rn FROM drawn JOIN mi USING (i, j)),
  tm AS (SELECT mi, row_number() OVER (ORDER BY mi) rn FROM tv, par WHERE rn = idx + 1),
  tau AS (SELECT mi threshold FROM tm WHERE rn = {fn.lower_median_index(10) + 1})"""
ANALYSIS = (
    E1, PROFILE, KEPT, weights_sql(THETA, "c2"), xt_sql(cells="c2", weights="wts"), mi_sql(cells="c2"), EDGES, MAXIMA, FENCES, RANKS, COUNTED, DRAWN,
    "free2 AS (SELECT * FROM c2 WHERE state <> 4)", xt_sql("xf", "free2", "wts"), mi_sql("miw", "xf", "free2"),
    "saved AS (SELECT * FROM edges WHERE mi > (SELECT threshold FROM tau))", aracne_sql("saved"),
)
PAIR = "CAST(e.i AS BIGINT) AS pos1, CAST(e.j AS BIGINT) AS pos2, e.distance, e.direct, e.mi"


def network(s: SparkSession, d: str, **options) -> Network:
    return analyse(from_embeddings(s, d), replace(SETUP, **options))


def listed(df: DataFrame) -> DataFrame:
    return ints(df, "direct").select("pos1", "pos2", "distance", "direct", "mi")


@query("analysis", with_(*ANALYSIS, select=f"{PAIR} FROM flagged e"))
def analysis(s, d):
    """Filter, weights, estimated threshold, all pairs by the packed kernel, pruning."""
    return listed(network(s, d).couplings)


@query("analysis_unpruned", with_(*ANALYSIS[:-1], select="CAST(i AS BIGINT) AS pos1, CAST(j AS BIGINT) AS pos2, distance, 0 AS direct, mi FROM saved"))
def analysis_unpruned(s, d):
    return listed(network(s, d, run_aracne=False).couplings)


@query("analysis_unfiltered", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select=f"{PAIR} FROM flagged e WHERE e.mi > 0"))
def analysis_unfiltered(s, d):
    """Without filter and weights, every positive pair saved."""
    return listed(network(s, d, filter_alignment=False, sample_reweighting=False, mi_threshold=0.0).couplings)


@query("analysis_threshold", with_(*ANALYSIS, select="threshold FROM tau"))
def analysis_threshold(s, d):
    return s.createDataFrame([(network(s, d, run_aracne=False).save_threshold,)], "threshold double")


E6 = E3.replace("cells AS (SELECT sample, p AS pos", "e3 AS (SELECT sample, p AS pos").replace("l_returnflag rf,", "CAST(l_orderkey AS BIGINT) ok, CAST(l_partkey AS BIGINT) pk, l_returnflag rf,") + """,
  cells AS (SELECT sample, 2 * pos pos, state FROM e3 UNION ALL SELECT sample, 2 * p + 1, ((ok * (7919 * (p + 3)) + ln * 104729 + pk * 31) % 1000003) % 4 FROM rows_, range(0, 32) r(p))"""
LINE_LD, LINE_KEEP = 3, 40
WIDE = (
    E6, xt_sql(), mi_sql(), "edges AS (SELECT i, j, mi, CAST(abs(i - j) AS BIGINT) distance FROM mi)", MAXIMA.replace(f"distance > {LD}", f"distance > {LINE_LD}"), FENCES,
    f"tau AS (SELECT min(mi) threshold FROM (SELECT mi FROM edges ORDER BY mi DESC LIMIT {LINE_KEEP + 1}) t)", "saved AS MATERIALIZED (SELECT * FROM edges WHERE mi > (SELECT threshold FROM tau))",
    "gappy AS (SELECT DISTINCT pos FROM cells WHERE state = 4)", FREE, xt_sql("xf", "freecells"), mi_sql("miw", "xf", "freecells"), aracne_sql("saved"),
)


@query("analysis_outliers", with_(*WIDE, select=f"CAST(e.i AS BIGINT) AS pos1, CAST(e.j AS BIGINT) AS pos2, e.distance, e.direct, e.mi, CASE WHEN e.i IN (FROM gappy) OR e.j IN (FROM gappy) THEN miw.mi ELSE e.mi END AS mi_wo_gaps, CASE WHEN e.i IN (FROM gappy) OR e.j IN (FROM gappy) THEN round((1 - miw.mi / e.mi) * 100, 4) ELSE 0.0 END AS gap_effect, CASE WHEN e.mi > f.extreme THEN 1 ELSE 0 END AS extreme FROM flagged e CROSS JOIN fences f LEFT JOIN miw ON miw.i = e.i AND miw.j = e.j WHERE e.mi >= f.outlier AND e.distance > {LINE_LD}"))
def analysis_outliers(s, d):
    """Coupled loci among many uncoupled ones, with the exact threshold found during the scan."""
    setup = CouplingConfig(mi_values=LINE_KEEP, ld_threshold=LINE_LD, aracne_tolerance=TOL, filter_alignment=False, sample_reweighting=False, topology="linear", exact_threshold=True, output_base=0, mi_digits=6, block_loci=4)
    return ints(analyse(wide_lineitem(s, d), setup).outliers, "direct", "extreme").withColumn("gap_effect", F.round("gap_effect", 4))


@query("analysis_counts", with_(*ANALYSIS, select="* FROM (SELECT 'cells' name, count(*) n FROM c2 UNION ALL SELECT 'edges', count(*) FROM saved UNION ALL SELECT 'gaps', count(*) FROM c2 WHERE state = 4 UNION ALL SELECT 'loci', count(DISTINCT pos) FROM c2 UNION ALL SELECT 'samples', count(DISTINCT sample) FROM c2 UNION ALL SELECT 'with_gaps', count(*) FROM saved WHERE i IN (SELECT pos FROM c2 WHERE state = 4) OR j IN (SELECT pos FROM c2 WHERE state = 4)) t"))
def analysis_counts(s, d):
    """What the analysis counts in passing."""
    return s.createDataFrame(sorted(network(s, d).counts.items()), "name string, n long")


@query("analysis_output_base", with_(*ANALYSIS, select="CAST(e.i + 1 AS BIGINT) AS pos1, CAST(e.j + 1 AS BIGINT) AS pos2, e.distance, e.direct, e.mi FROM flagged e"))
def analysis_output_base(s, d):
    """Positions are shown from 1; distances are those of the loci."""
    return listed(network(s, d, output_base=1).couplings)


@query("analysis_weights", with_(E1, PROFILE, "c2 AS (SELECT cells.* FROM cells JOIN kept USING (pos) WHERE sample % 3 <> 1)", "wts AS (SELECT DISTINCT sample, 1.0 / (1 + sample % 4) weight FROM c2)", xt_sql(cells="c2", weights="wts"), mi_sql(cells="c2"), EDGES, f"tau AS (SELECT min(mi) threshold FROM (SELECT mi FROM edges ORDER BY mi DESC LIMIT {KEEP + 1}) t)", "saved AS MATERIALIZED (SELECT * FROM edges WHERE mi > (SELECT threshold FROM tau))", aracne_sql("saved"), select=f"{PAIR} FROM flagged e"))
def analysis_weights(s, d):
    """The caller's weights and a list of samples: the filter sees all samples, MI the listed ones with their weights."""
    cells = from_embeddings(s, d)
    samples = cells.select("sample").distinct().where("sample % 3 <> 1")
    weights = samples.withColumn("weight", 1.0 / (1 + F.col("sample") % 4))
    return listed(analyse(cells, replace(SETUP, exact_threshold=True), samples=samples, weights=weights).couplings)


LITERAL = """lit_pres AS (SELECT DISTINCT pos, state FROM cells), lit_pairs AS (SELECT DISTINCT i, j FROM xt),
  lit_grid AS (SELECT g.i, g.j, a.state a, b.state b, coalesce(x.n, 0) + 0.5 n FROM lit_pairs g JOIN lit_pres a ON a.pos = g.i JOIN lit_pres b ON b.pos = g.j LEFT JOIN xt x ON x.i = g.i AND x.j = g.j AND x.a = a.state AND x.b = b.state),
  lit_p AS (SELECT i, j, a, b, n / sum(n) OVER (PARTITION BY i, j) p FROM lit_grid),
  lit_z AS (SELECT i, j, sum(p + 0.5) z FROM lit_p WHERE a <> 4 AND b <> 4 GROUP BY i, j),
  lit_q AS (SELECT i, j, a, b, CASE WHEN a <> 4 THEN (p + 0.5) / z ELSE p / z END q FROM lit_p JOIN lit_z USING (i, j) WHERE b <> 4),
  lit_joint AS (SELECT i, j, sum(q * ln(q)) h FROM lit_q WHERE a <> 4 GROUP BY i, j),
  lit_second AS (SELECT i, j, sum(m * ln(m)) h FROM (SELECT i, j, b, sum(q) m FROM lit_q GROUP BY i, j, b) t GROUP BY i, j),
  lit_first AS (SELECT i, j, sum(m * ln(m)) h FROM (SELECT i, j, a, sum(q) m FROM lit_q WHERE a <> 4 GROUP BY i, j, a) t GROUP BY i, j),
  lit AS (SELECT i, j, lit_joint.h - lit_second.h - lit_first.h mi FROM lit_joint JOIN lit_second USING (i, j) JOIN lit_first USING (i, j))"""


@query("mi_without_gaps_literal", with_(E1, xt_sql(), LITERAL, select="i, j, round(mi, 6) AS mi_wo_gaps FROM lit"))
def mi_without_gaps_literal(s, d):
    """Two passes over one table of shares, for listed pairs."""
    c = from_embeddings(s, d)
    return m.mi_without_gaps(c, e1_mi(s, d), gap_mode="literal").withColumn("mi_wo_gaps", F.round("mi_wo_gaps", 6))


@query("mi_block_literal", with_(E1, xt_sql(), LITERAL, select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(mi, 6) AS mi_wo_gaps FROM lit"))
def mi_block_literal(s, d):
    return m.block_mi(from_embeddings(s, d), block=16, gap_mode="literal").where("kind = 'edge'").select("i", "j", F.round("mi_wo_gaps", 6).alias("mi_wo_gaps"))


@query("exact_scan", with_(E1, xt_sql(), mi_sql(), f"tau AS (SELECT min(mi) threshold FROM (SELECT mi FROM mi ORDER BY mi DESC LIMIT {KEEP + 1}) t)", select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi FROM mi WHERE mi > (SELECT threshold FROM tau)"))
def exact_scan(s, d):
    """The strongest pairs by tiles that tell a bounded number each, under a bound that rises from wave to wave."""
    return th.exact_scan(pack(from_embeddings(s, d), None, 16), KEEP, digits=6)[0].where("kind = 'edge'").select("i", "j", "mi")


@query("sample_weights_parts", with_(E4, weights_sql(0.9), select="sample, round(weight, 6) AS weight FROM wts"))
def sample_weights_parts(s, d):
    """Only samples that agree in some part of the loci are compared."""
    return we.sample_weights(from_parts(s, d), 0.9, "parts").withColumn("weight", F.round("weight", 6))


@query("network_extension", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, direct FROM flagged"))
def network_extension(s, d):
    """A network that comes in three parts, pruned as each is appended."""
    e = shared_copy(e1_mi(s, d).select("i", "j", "mi"))
    part = F.pmod(F.col("i") * 7 + F.col("j"), F.lit(3))
    net = ar.aracne(e.where(part == 1), TOL)
    for k in (2, 0):
        net = shared_copy(ar.extend_network(net, e.where(part == k), TOL))
    return net.select("i", "j", "mi", F.col("direct").cast("int").alias("direct"))


@query("sql_functions", with_(E1, xt_sql(), mi_sql(), draws_sql(iterations=1), select=f"CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, CAST({DIST} AS BIGINT) AS distance FROM mi JOIN (SELECT DISTINCT i, j FROM drawn) p USING (i, j)"))
def sql_functions(s, d):
    """The registered functions in one SQL statement: drawn pairs, their MI and their distance on the circle."""
    register(s)
    view = f"cells_{uuid.uuid4().hex}"
    from_embeddings(s, d).createOrReplaceTempView(view)
    drawn = fn.sample_pair_count(GENOME, KEEP)
    return s.sql(f"""
        WITH p AS (SELECT u + 1 AS i, v + 1 AS j FROM sample_pairs({GENOME}, 1, {drawn}))
        SELECT i, j, round(mi, 6) AS mi, circular_distance(i, j, {GENOME}) AS distance FROM (
          SELECT p.i, p.j, pair_mi(a.state, b.state, 1.0D) AS mi
          FROM p JOIN {view} a ON a.pos = p.i JOIN {view} b ON b.pos = p.j AND b.sample = a.sample GROUP BY p.i, p.j)""")


@query("analysis_lines", with_(E3, xt_sql(), mi_sql(), "edges AS (SELECT i, j, mi, abs(i - j) distance FROM mi WHERE mi > 0.01)", "free3 AS (SELECT * FROM cells WHERE state <> 4)", xt_sql("xf", "free3"), mi_sql("miw", "xf", "free3"), "gappy AS (SELECT DISTINCT pos FROM cells WHERE state = 4)", aracne_sql(), select="CAST(e.i AS BIGINT) AS i, CAST(e.j AS BIGINT) AS j, CAST(e.distance AS BIGINT) AS distance, e.direct, e.mi, CASE WHEN e.i IN (FROM gappy) OR e.j IN (FROM gappy) THEN miw.mi ELSE e.mi END AS mi_wo_gaps FROM flagged e LEFT JOIN miw ON miw.i = e.i AND miw.j = e.j"))
def analysis_lines(s, d):
    """Loci with and without gaps: only saved pairs that touch a gap are counted again."""
    found = m.block_mi(from_lineitem(s, d), threshold=0.01, block=3, digits=6).where("kind = 'edge'").drop("kind")
    flagged = ar.aracne(found.withColumn("distance", fn.linear_distance(F.col("i"), F.col("j"))), TOL)
    return ints(flagged.withColumn("mi_wo_gaps", F.coalesce("mi_wo_gaps", "mi")), "direct").select("i", "j", "distance", "direct", "mi", "mi_wo_gaps")


LINE_FENCES = "fences AS (SELECT 0.3 outlier, 0.6 extreme)"


@query("outliers_many", with_(E3, xt_sql(), mi_sql(), "edges AS (SELECT i, j, mi, abs(i - j) distance FROM mi)", LINE_FENCES, select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(distance AS BIGINT) AS distance, mi, CASE WHEN mi > extreme THEN 1 ELSE 0 END AS extreme FROM edges, fences WHERE mi >= outlier AND distance > 4"))
def outliers_many(s, d):
    """Given fences with pairs on both sides of each and of the distance."""
    e = m.mi_pairs(from_lineitem(s, d)).withColumn("mi", F.round("mi", 6)).withColumn("distance", fn.linear_distance(F.col("i"), F.col("j")))
    fences = s.createDataFrame([(0.3, 0.6)], "outlier double, extreme double")
    return ints(ou.outliers(e, fences, 4), "extreme").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance", "mi", "extreme")


@query("pruning_above", with_(E1, xt_sql(), mi_sql(), "strong AS MATERIALIZED (SELECT * FROM mi WHERE mi >= 0.02)", aracne_sql("strong"), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, direct FROM flagged"))
def pruning_above(s, d):
    """Pruning of an edge list made elsewhere: weaker edges go first."""
    return ar.aracne(e1_mi(s, d).select("i", "j", "mi"), TOL, min_mi=0.02).select("i", "j", "mi", F.col("direct").cast("int").alias("direct"))


@query("nothing_kept", with_(E1, PROFILE, KEPT, "none2 AS (SELECT cells.* FROM cells JOIN (" + PROFILE.split("kept AS (")[1].rstrip(")").replace("second >= 0.01 * n", "second >= n") + ") USING (pos))", select="maf, CAST(count(DISTINCT pos) AS BIGINT) AS loci, CAST(count(DISTINCT pos) * (count(DISTINCT pos) - 1) // 2 AS BIGINT) AS couplings FROM (SELECT 0.01::DOUBLE maf) LEFT JOIN (SELECT 0.01::DOUBLE maf, pos FROM c2) USING (maf) GROUP BY maf UNION ALL SELECT 1.0::DOUBLE, CAST(count(DISTINCT pos) AS BIGINT), CAST(0 AS BIGINT) FROM none2"))
def nothing_kept(s, d):
    """The same analysis with a filter that keeps loci and one that keeps none: loci and positive couplings of each."""
    rows = []
    for maf in (0.01, 1.0):
        loci = al.filter_positions(from_embeddings(s, d), maf=maf).select("pos").distinct().count()
        rows.append((maf, loci, network(s, d, maf_threshold=maf, mi_threshold=0.0, mi_digits=None, run_aracne=False).couplings.count()))
    return s.createDataFrame(rows, "maf double, loci long, couplings long")


# ---- sources and sinks: written to the shared folder, read back ----------------------------------------------

def folder(s: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    shared_copy(s.range(1))
    return f"{s.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def written(s: SparkSession, lines: DataFrame, name: str = "lines") -> str:
    return writers.write_lines(lines, f"{folder(s)}/{name}")


def named(s: SparkSession, d: str) -> DataFrame:
    return from_embeddings(s, d).select("sample", F.col("sample").cast("string").alias("name")).distinct()


@query("fasta_scan", with_(E1, select="CAST(dense_rank() OVER (ORDER BY sample) - 1 AS BIGINT) AS sample, sample AS name, CAST(pos - 1 AS INTEGER) AS pos, CAST(state AS INTEGER) AS state FROM cells"))
def fasta_scan(s, d):
    """The alignment as a file, then read: samples are numbered in the file's order."""
    got = readers.read_sequences(s, writers.write_alignment(from_embeddings(s, d), f"{folder(s)}/alignment", named(s, d)))
    cells = readers.cells_of(got).join(got.select("sample", F.col("name").cast("long").alias("name")), "sample")
    return ints(cells, "state").select("sample", "name", "pos", "state")


@query("fasta_scan_files", with_(E1, select="CAST(dense_rank() OVER (ORDER BY sample % 2 DESC, sample) - 1 AS BIGINT) AS sample, sample AS name FROM (SELECT DISTINCT sample FROM cells) t"))
def fasta_scan_files(s, d):
    """Odd samples, then even ones, in two files: numbers follow the list of files."""
    to, c = folder(s), from_embeddings(s, d)
    paths = [writers.write_alignment(c.where(F.col("sample") % 2 == odd), f"{to}/part", named(s, d)) for odd in (1, 0)]
    return readers.read_sequences(s, paths).select("sample", F.col("name").cast("long").alias("name"))


@query("alignment_lines", with_(E1, select="sample, '>' || sample || chr(10) || string_agg(substring('ACGT-', state + 1, 1), '' ORDER BY pos) AS value FROM cells GROUP BY sample"))
def alignment_lines(s, d):
    return writers.alignment_lines(from_embeddings(s, d))


@query("filtered_alignment_lines", with_(E1, PROFILE, KEPT, select="sample, '>' || sample || chr(10) || string_agg(substring('ACGT-', state + 1, 1), '' ORDER BY pos) AS value FROM c2 GROUP BY sample"))
def filtered_alignment_lines(s, d):
    return writers.alignment_lines(al.filter_positions(from_embeddings(s, d)))


@query("outlier_alignment_lines", with_(E1, xt_sql(), mi_sql(), EDGES, MAXIMA, FENCES, NODES, select="sample, '>' || sample || chr(10) || string_agg(substring('ACGT-', state + 1, 1), '' ORDER BY pos) AS value FROM cells WHERE pos IN (SELECT pos FROM nodes) GROUP BY sample"))
def outlier_alignment_lines(s, d):
    return writers.alignment_lines(ou.outlier_alignment(from_embeddings(s, d), outlier_nodes(s, d)))


@query("include_list_scan", with_(E1, select=f"pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS s FROM cells WHERE pos IN ({LOCI}) GROUP BY pos"))
def include_list_scan(s, d):
    """A list of loci counted from 5, several a line, some twice."""
    lines = third_loci(s).select(F.concat_ws(" ", F.col("pos") + 5, F.lit("  "), F.col("pos") + 5).alias("value"))
    return al.include_loci(from_embeddings(s, d), readers.read_loci_list(s, written(s, lines), 5)).groupBy("pos").agg(F.count("*").alias("n"), F.sum("state").alias("s"))


@query("exclude_list_scan", with_(E1, select=f"pos, count(*) AS n FROM cells WHERE pos NOT IN ({LOCI}) GROUP BY pos"))
def exclude_list_scan(s, d):
    lines = third_loci(s).select((F.col("pos") + 1).cast("string").alias("value"))
    return al.exclude_loci(from_embeddings(s, d), readers.read_loci_list(s, written(s, lines))).groupBy("pos").agg(F.count("*").alias("n"))


@query("sample_list_scan", with_(E1, select="pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS s FROM cells WHERE sample % 3 = 0 GROUP BY pos"))
def sample_list_scan(s, d):
    lines = from_embeddings(s, d).select("sample").distinct().where("sample % 3 = 0").select(F.col("sample").cast("string").alias("value"))
    keep = readers.read_loci_list(s, written(s, lines), 0, "sample")
    return al.subsample(from_embeddings(s, d), keep).groupBy("pos").agg(F.count("*").alias("n"), F.sum("state").alias("s"))


@query("weights_scan", with_(E1, weights_sql(THETA), select="CAST(row_number() OVER (ORDER BY sample) - 1 AS BIGINT) AS sample, round(weight, 6) AS weight FROM wts"))
def weights_scan(s, d):
    """Weights written in order of sample and read back by place."""
    w = shared_copy(we.sample_weights(from_embeddings(s, d), THETA))
    path = writers.write_weights(w, f"{folder(s)}/weights")
    return readers.read_indexed_list(s, path, "sample", "weight", expected=w.count()).withColumn("weight", F.round("weight", 6))


@query("weights_lines", with_(E1, weights_sql(THETA), select="CAST(row_number() OVER (ORDER BY sample) - 1 AS BIGINT) AS place, printf('%.6f', weight) AS value FROM wts"))
def weights_lines(s, d):
    """Through the writer, at an identity where weights differ; the place in the file is the sample's."""
    path = writers.write_weights(we.sample_weights(from_embeddings(s, d), THETA).withColumn("weight", F.round("weight", 6)), f"{folder(s)}/weights")
    return readers.read_indexed_list(s, path, "place", "value", "string").withColumn("value", F.format_string("%.6f", F.col("value").cast("double")))


@query("mapping_scan", with_(E1, select="sample, CAST(3 * pos + 7 AS BIGINT) AS pos, CAST(state AS INTEGER) AS state FROM cells"))
def mapping_scan(s, d):
    """The genome position of each column from a list, in order of the columns."""
    lines = s.range(0, GENOME, 1, 3).select((3 * (F.col("id") + 1) + 7).cast("string").alias("value"))
    mapping = readers.read_indexed_list(s, written(s, lines), "idx", "pos", "long", expected=GENOME)
    cells = from_embeddings(s, d).withColumn("pos", F.col("pos") - 1)
    return ints(al.translate_loci(cells, mapping), "state")


@query("couplings_scan", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select=COUPLINGS))
def couplings_scan(s, d):
    return readers.read_couplings(s, written(s, writers.couplings_lines(e1_couplings(s, d)), "couplings"))


@query("couplings_order", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="CAST(row_number() OVER (ORDER BY mi DESC, i, j) - 1 AS BIGINT) AS line, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM flagged"))
def couplings_order(s, d):
    """The place of each pair in the couplings file: strongest first."""
    words = readers.read_indexed_list(s, written(s, writers.couplings_lines(e1_couplings(s, d)), "couplings"), "at", "word", "string")
    of = lambda k: F.max(F.when(F.col("at") % 5 == k, F.col("word"))).cast("long")
    return words.groupBy(F.floor(F.col("at") / 5).alias("line")).agg(of(0).alias("i"), of(1).alias("j"))


@query("analysis_files", with_(*ANALYSIS, select="CAST(3 * e.i + 8 AS BIGINT) AS pos1, CAST(3 * e.j + 8 AS BIGINT) AS pos2, CAST(least(3 * abs(e.i - e.j), 200 - 3 * abs(e.i - e.j)) AS BIGINT) AS distance, e.direct, round(e.mi, 6) AS mi FROM flagged e"))
def analysis_files(s, d):
    """From files to files: an alignment and the positions of its columns are read, analysed, and the couplings written and read
    back, with positions from 1."""
    fasta = writers.write_alignment(from_embeddings(s, d), f"{folder(s)}/alignment", named(s, d))
    columns = written(s, s.range(0, GENOME, 1, 3).select((3 * (F.col("id") + 1) + 7).cast("string").alias("value")))
    cells = al.translate_loci(readers.read_fasta(s, fasta), readers.read_indexed_list(s, columns, "idx", "pos", "long", expected=GENOME))
    net = analyse(cells, replace(SETUP, genome_size=200, output_base=1))
    return readers.read_couplings(s, written(s, writers.couplings_lines(net.couplings), "couplings"))


@query("edge_parts_scan", with_(E1, xt_sql(), mi_sql(), EDGES, aracne_sql(), select="CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, mi, direct FROM flagged"))
def edge_parts_scan(s, d):
    """One network kept in two files, read as one and pruned."""
    e = shared_copy(e1_mi(s, d).select("i", "j", "mi"))
    parts = [written(s, e.where((F.col("i") < 20) == first).select(F.concat_ws(" ", "i", "j", F.format_string("%.6f", "mi")).alias("value"))) for first in (True, False)]
    return ar.aracne(readers.read_edges(s, parts), TOL).select("i", "j", "mi", F.col("direct").cast("int").alias("direct"))


@query("outliers_lines", OUTLIERS.replace("SELECT CAST(e.i AS BIGINT) AS i", "SELECT concat_ws(' ', i, j, distance, direct, printf('%.6f', mi), printf('%.6f', mi_wo_gaps), printf('%.1f', gap_effect), extreme) AS value FROM (SELECT CAST(e.i AS BIGINT) AS i") + ") listed")
def outliers_lines(s, d):
    return writers.outliers_lines(outliers(s, d).withColumnsRenamed({"i": "pos1", "j": "pos2"}))


@query("frequency_lines", with_(E1, select="concat_ws(' ', pos, state, count(*), printf('%.6f', count(*) / CAST(sum(count(*)) OVER (PARTITION BY pos) AS DOUBLE))) AS value FROM cells GROUP BY pos, state"))
def frequency_lines(s, d):
    return s.read.text(writers.write_frequencies(al.state_frequencies(from_embeddings(s, d)), f"{folder(s)}/frequencies"))


@query("distance_lines", with_(E1, select="concat_ws(' ', l.sample, r.sample, sum(CASE WHEN l.state <> r.state THEN 1 ELSE 0 END)) AS value FROM cells l JOIN cells r ON l.pos = r.pos AND l.sample < r.sample GROUP BY l.sample, r.sample"))
def distance_lines(s, d):
    return s.read.text(writers.write_distances(we.hamming_strips(from_embeddings(s, d)), f"{folder(s)}/distances", "gzip"))


@query("distance_matrix_lines", with_(E1, "ham AS (SELECT l.sample s, r.sample t, sum(CASE WHEN l.state <> r.state THEN 1 ELSE 0 END) k FROM cells l JOIN cells r ON l.pos = r.pos GROUP BY 1, 2)", select="s AS sample, string_agg(CAST(CAST(k AS BIGINT) AS VARCHAR), ' ' ORDER BY t) AS value FROM ham GROUP BY s"))
def distance_matrix_lines(s, d):
    return writers.distance_matrix_lines(we.hamming_strips(from_embeddings(s, d), square=True))


@query("unique_names", "SELECT * FROM (VALUES (0, 'a.64.couplings.1-based.9edges'), (1, 'a.64.couplings.1-based.9edges.1'), (2, 'a.64.couplings.1-based.9edges.outliers')) t(k, name)")
def unique_names(s, d):
    """The same output twice, then its outliers: nothing is overwritten."""
    to, one = folder(s), s.range(1).select(F.lit("1 2 1 1 0.5").alias("value"))
    names = [writers.couplings_name("a", GENOME, 1, 9), writers.couplings_name("a", GENOME, 1, 9), writers.couplings_name("a", GENOME, 1, 9, outliers=True)]
    paths = [writers.write_lines(one, f"{to}/{name}") for name in names]
    return s.createDataFrame([(k, p.rsplit("/", 1)[1]) for k, p in enumerate(paths)], "k int, name string")
