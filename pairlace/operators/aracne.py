"""Indirect edges by the data-processing inequality on triangles."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.operators.lineage import shared_copy


GROUP_EDGES, PROBES = 200_000, 1 << 22


def _colour_groups(edges: DataFrame, colours: int | None) -> DataFrame:
    """``c1, c2, c3, i, j, mi``: vertices fall in colour classes, and an edge goes to each triple of colours that its triangles
    can have, once. A hub's edges spread over all triples with its colour. An edge is sent once a colour; no wedge is ever a row."""
    more = [c for c in edges.columns if c == "fresh"]
    e = edges.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("mi").cast("double").alias("mi"), *more).where("i <> j")
    if colours is None:
        colours = max(1, int((6 * e.count() / GROUP_EDGES) ** 0.5 + 0.999))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    third = F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("x")
    three = F.sort_array(F.array(colour("i"), colour("j"), F.col("x")))
    return e.select("i", "j", "mi", third, *more).select(*[three[k].alias(f"c{k + 1}") for k in range(3)], colour("i").alias("ci"), colour("j").alias("cj"), "i", "j", "mi", *more)


def _local_triangles(i: np.ndarray, j: np.ndarray, mi: np.ndarray):
    """Edges of each triangle among the given edges, in batches: indices of the edges ab, ac and bc, with a < b < c. Edges point to the
    end of higher degree; for each arc, the arcs that go on from its head are probed among those of its tail."""
    name, flat = np.unique(np.r_[i, j], return_inverse=True)
    n, u, v = len(name), flat[: len(i)], flat[len(i) :]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), np.bincount(flat, minlength=n)))] = np.arange(n)
    up = rank[u] < rank[v]
    tail, head = np.where(up, u, v), np.where(up, v, u)
    key = tail * n + head
    order = np.argsort(key)
    key, tail, head = key[order], tail[order], head[order]
    begin = np.searchsorted(tail, np.arange(n + 1))
    out = np.diff(begin)[head]  # arcs that go on from each arc's head
    ends = np.cumsum(out)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PROBES, "right")))
        arc = np.repeat(np.arange(lo, hi), out[lo:hi])
        on = np.arange(len(arc)) - np.repeat(np.cumsum(out[lo:hi]) - out[lo:hi], out[lo:hi]) + begin[head[arc]]
        want = tail[arc] * n + head[on]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        three = np.sort(np.stack([tail[arc[hit]], head[arc[hit]], head[on[hit]]]), axis=0)
        edges = np.stack([order[arc[hit]], order[on[hit]], order[at[hit]]])
        low, high = np.minimum(u, v)[edges], np.maximum(u, v)[edges]
        pick = lambda a, b, low=low, high=high, edges=edges: np.where((low == a) & (high == b), edges, 0).sum(0)
        yield pick(three[0], three[1]), pick(three[0], three[2]), pick(three[1], three[2])
        lo = hi


def _each_triple(pdf: pd.DataFrame):
    """``pdf``'s edges of triangles whose colours are those of the group: others are told by another group."""
    i, j, mi, ci, cj = (pdf[c].to_numpy() for c in ("i", "j", "mi", "ci", "cj"))
    want = pdf[["c1", "c2", "c3"]].iloc[0].to_numpy()
    for ab, ac, bc in _local_triangles(i, j, mi):
        ok = (np.sort(np.stack([ci[ab], cj[ab], cj[bc]]), axis=0) == want[:, None]).all(0)
        yield i, j, mi, ab[ok], ac[ok], bc[ok]


def triangles(edges: DataFrame, colours: int | None = None) -> DataFrame:
    """``a, b, c, m_ab, m_ac, m_bc`` with a < b < c, each triangle once, in one round: see ``_colour_groups``. Edges are distinct."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": i[ab], "b": j[ab], "c": j[bc], "m_ab": mi[ab], "m_ac": mi[ac], "m_bc": mi[bc]}) for i, j, mi, ab, ac, bc in _each_triple(pdf)]
        return pd.concat(found, ignore_index=True)

    return _colour_groups(edges, colours).groupBy("c1", "c2", "c3").applyInPandas(kernel, "a long, b long, c long, m_ab double, m_ac double, m_bc double")


def triangles_by_joins(edges: DataFrame) -> DataFrame:
    """The same by two equi-joins, for networks without hubs. Edges point from the end of lower degree to
    that of higher, so a hub has few outgoing edges and no join key gathers a hub's pairs."""
    e = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "mi").where("i <> j")
    degree = e.select(F.explode(F.array("i", "j")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    both = e.join(degree.select(F.col("v").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("v").alias("j"), F.col("d").alias("dj")), "j")
    up = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    arcs = both.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("v"), "mi")
    first = arcs.select("u", F.col("v").alias("x"), F.col("mi").alias("m_ux"))
    second = arcs.select("u", F.col("v").alias("y"), F.col("mi").alias("m_uy"))
    wedges = first.join(second, "u").where("x < y")
    closed = wedges.join(e.select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("mi").alias("m_xy")), ["x", "y"])
    u, x, y = F.col("u"), F.col("x"), F.col("y")
    pick = lambda lo, mid, hi: F.when(u < x, lo).when(u < y, mid).otherwise(hi)
    return closed.select(
        pick(u, x, x).cast("long").alias("a"), pick(x, u, y).cast("long").alias("b"), pick(y, y, u).cast("long").alias("c"),
        pick(F.col("m_ux"), F.col("m_ux"), F.col("m_xy")).alias("m_ab"),
        pick(F.col("m_uy"), F.col("m_xy"), F.col("m_ux")).alias("m_ac"),
        pick(F.col("m_xy"), F.col("m_uy"), F.col("m_uy")).alias("m_bc"),
    )


def indirect_edges(edges: DataFrame, tolerance: float = sys.float_info.epsilon, colours: int | None = None) -> DataFrame:
    """``i, j`` of each edge that is the weakest of some triangle by at least ``tolerance``. With tolerance 0 a tie
    for the weakest marks each of its edges, with a positive one it marks none. Triangles are judged where they are found; a
    group tells each edge once at most. With a column ``fresh`` only triangles that hold a fresh edge are judged."""
    some = "fresh" in edges.columns

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = np.zeros(len(pdf), bool)
        fresh = pdf["fresh"].to_numpy(bool) if some else None
        for _, _, mi, *three in _each_triple(pdf):
            if some:
                use = fresh[three[0]] | fresh[three[1]] | fresh[three[2]]
                three = [k[use] for k in three]
            m = np.stack([mi[k] for k in three])
            s = np.sort(m, axis=0)
            for k, own in zip(three, m, strict=True):
                bad[k[(s[1] - s[0] >= tolerance) & (own == s[0])]] = True
        return pdf.loc[bad, ["i", "j"]]

    return _colour_groups(edges, colours).groupBy("c1", "c2", "c3").applyInPandas(kernel, "i long, j long").distinct()


def aracne(edges: DataFrame, tolerance: float = sys.float_info.epsilon, min_mi: float | None = None) -> DataFrame:
    """The edges with ``direct``. ``min_mi`` drops weaker edges first, for edge lists made elsewhere."""
    e = edges if min_mi is None else edges.where(F.col("mi") >= min_mi)
    e = e.select(*[c for c in e.columns if c not in ("i", "j", "direct")], F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"))
    e = shared_copy(e)  # read five times below
    flags = indirect_edges(e, tolerance).withColumn("_hit", F.lit(True))
    return e.join(flags, ["i", "j"], "left").withColumn("direct", F.col("_hit").isNull()).drop("_hit")


def extend_network(known: DataFrame, part: DataFrame, tolerance: float = sys.float_info.epsilon) -> DataFrame:
    """``i, j, mi, direct`` of a network and an appended part of edges, as pruning of all at once would give. ``known`` is a pruned
    network (``i, j, mi, direct``). Marks only ever add up, and a new mark needs a triangle with a new edge, so old edges take part
    only where they touch a new one's end. Edges that are known already are not new."""
    same = lambda df, *more: df.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("mi").cast("double").alias("mi"), *more)
    old = shared_copy(same(known, "direct"))
    new = shared_copy(same(part).dropDuplicates(["i", "j"]).join(old.select("i", "j"), ["i", "j"], "left_anti"))
    ends = shared_copy(new.select(F.explode(F.array("i", "j")).alias("v")).distinct())
    near = old.join(ends.withColumnRenamed("v", "i"), "i", "left_semi").select("i", "j", "mi").unionByName(old.join(ends.withColumnRenamed("v", "j"), "j", "left_semi").select("i", "j", "mi")).distinct()
    met = near.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    marks = indirect_edges(shared_copy(met), tolerance).withColumn("_hit", F.lit(True))
    every = old.unionByName(new.withColumn("direct", F.lit(True)))
    return every.join(marks, ["i", "j"], "left").withColumn("direct", F.col("direct") & F.col("_hit").isNull()).drop("_hit")
