"""Weighted mutual information of pairs of loci, by three plans with the same results.

``sql``: the samples' cells meet by an equi-join; rows are samples times pairs, so it suits up to some 200 loci.
``sparse``: only cells off the most frequent state meet; the rest follows from the marginals.
``block``: loci packed as bytes and dealt to tiles of blocks, one-hot products in an Arrow kernel that takes a slice of the samples
at a time; one row a saved pair leaves the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlace.config import GAP, N_STATES
from pairlace.functions.scalars import pair_count, xlogx
from pairlace.operators.alignment import state_presence
from pairlace.operators.kernels import block_counts, entropies, listed_counts, marginal_bound, presence, without_gaps
from pairlace.operators.kernels import presence as presence_of
from pairlace.operators.lineage import shared_copy
from pairlace.operators.packed import Packed, Slice, pack, read_tile, shares_of, tile_rows


def _weighted(cells: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return cells.select("sample", "pos", "state", F.lit(1.0).alias("w"))
    return cells.join(weights.select("sample", F.col("weight").alias("w")), "sample")


def _met(cells: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The states of both loci of a pair in each sample: ``i, j, a, b, w``."""
    left = cells.select("sample", F.col("pos").alias("i"), F.col("state").alias("a"), "w")
    right = cells.select("sample", F.col("pos").alias("j"), F.col("state").alias("b"))
    if pairs is None:
        return left.join(right, "sample").where("i < j")
    return left.join(pairs.select("i", "j"), "i").join(right, ["sample", "j"])


def crosstable(cells: DataFrame, weights: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``i, j, a, b, n``: summed weights of the state pairs that occur, for all pairs i < j or those of ``pairs``."""
    return _met(_weighted(cells, weights), pairs).groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n"))


def crosstable_sparse(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The same table with few rows met: each locus's most frequent state is left out of the self-join, and its
    row and column follow by subtraction. Needs a full alignment: each sample has each locus."""
    w = _weighted(cells, weights)
    margin = w.groupBy("pos", "state").agg(F.sum("w").alias("m"))
    major = margin.groupBy("pos").agg(F.max_by("state", F.struct("m", "state")).alias("major"), F.sum("m").alias("total"))
    minor = w.join(major, "pos").where("state <> major").select("sample", "pos", "state", "w")
    both = _met(minor, None).groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n"))
    m = margin.join(major, "pos")
    li = m.select(F.col("pos").alias("i"), F.col("state").alias("a"), F.col("m").alias("mi_"), F.col("major").alias("a0"), "total")
    rj = m.select(F.col("pos").alias("j"), F.col("state").alias("b"), F.col("m").alias("mj_"), F.col("major").alias("b0"))
    grid = li.join(rj, F.col("i") < F.col("j"))
    grid = grid.join(both, ["i", "j", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    by_a = both.groupBy("i", "j", "a").agg(F.sum("n").alias("na"))
    by_b = both.groupBy("i", "j", "b").agg(F.sum("n").alias("nb"))
    by = both.groupBy("i", "j").agg(F.sum("n").alias("nn"), F.lit(1).alias("_x"))
    grid = grid.join(by_a, ["i", "j", "a"], "left").join(by_b, ["i", "j", "b"], "left").join(by.drop("_x"), ["i", "j"], "left").na.fill(0.0, ["na", "nb", "nn"])

    mi_, mj_ = F.col("mi_"), F.col("mj_")
    n = (
        F.when((F.col("a") != F.col("a0")) & (F.col("b") != F.col("b0")), F.col("n"))
        .when((F.col("a") == F.col("a0")) & (F.col("b") != F.col("b0")), mj_ - F.col("nb"))
        .when((F.col("a") != F.col("a0")) & (F.col("b") == F.col("b0")), mi_ - F.col("na"))
        .otherwise(mi_ - (F.col("total") - mj_) + F.col("nn"))
    )
    return grid.select("i", "j", "a", "b", n.alias("n")).where("n > 1e-9")


def mi_from_crosstable(table: DataFrame, presence: DataFrame, alpha: float = 0.5, mask: str = "mask", n_states: int = N_STATES) -> DataFrame:
    """``i, j, mi``. The pseudocount goes to each pair of states present in the two loci, met or not. A pair of
    loci is one group of at most n_states squared counts, folded as an array; no window is needed."""
    p = presence.select("pos", F.col(mask).alias("p"))
    counts = table.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * n_states + F.col("b")).alias("k"), "n"))).alias("c"))
    rows = counts.join(p.select(F.col("pos").alias("i"), F.col("p").alias("pi")), "i").join(p.select(F.col("pos").alias("j"), F.col("p").alias("pj")), "j")

    def cell(a: int, b: int):
        here = (F.col("pi").bitwiseAND(1 << a) != 0) & (F.col("pj").bitwiseAND(1 << b) != 0)
        return F.when(here, F.coalesce(F.col("c")[F.lit(a * n_states + b)], F.lit(0.0)) + alpha).otherwise(F.lit(0.0))

    return _mi_of_cells(rows.select("i", "j", F.array(*[cell(a, b) for a in range(n_states) for b in range(n_states)]).alias("x")), n_states)


def _mi_of_cells(rows: DataFrame, n_states: int) -> DataFrame:
    """``i, j, mi`` from ``i, j, x``: the table's cells in one array, the pseudocounts in it; other columns stay."""
    def bound(value: Column, f) -> Column:
        """``f(value)`` with the value computed once, also where a filter on the result is pushed below the projection."""
        return F.transform(F.array(value), f)[0]

    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    total = lambda xs: add(F.transform(xs, xlogx))

    def entropies(p: Column) -> Column:
        row = F.array(*[add(F.slice(p, a * n_states + 1, n_states)) for a in range(n_states)])
        col = F.array(*[add(F.array(*[p[a * n_states + b] for a in range(n_states)])) for b in range(n_states)])
        return total(p) - total(row) - total(col)

    share = lambda x, z: F.transform(x, lambda v: F.when(z > 0, v / z).otherwise(F.lit(0.0)))
    mi = bound(F.col("x"), lambda x: bound(add(x), lambda z: bound(share(x, z), entropies)))
    return rows.withColumn("mi", mi).drop("x")


def mi_pairs(cells: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, pairs: DataFrame | None = None, plan: str = "sql") -> DataFrame:
    """``i, j, mi`` of all pairs or of ``pairs``, by ``sql`` or ``sparse``. Pairs that share no sample are absent."""
    table = crosstable_sparse(cells, weights) if plan == "sparse" else crosstable(cells, weights, pairs)
    return mi_from_crosstable(table, state_presence(cells, None), alpha)


def mi_without_gaps(cells: DataFrame, edges: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, gap_state: int = GAP, gap_mode: str = "clean", n_states: int = N_STATES, block: int = 128) -> DataFrame:
    """``i, j, mi_wo_gaps`` of the edges that have a gap in either locus: samples with a gap at either locus are
    left out, and the pseudocount goes to the states present without gaps; in ``literal`` mode the table with gaps is gone over a
    second time (``kernels.without_gaps``). Others have no row. Edges are counted in the tiles of packed loci, so what is sent follows
    loci and edges, not samples times edges; samples may lack loci, and a cell that comes again counts again, as in a join on the sample."""
    presence = state_presence(cells, gap_state)
    gappy = presence.where("mask <> mask_wo_gaps").select("pos")
    touched = edges.select("i", "j").join(gappy.select(F.col("pos").alias("i"), F.lit(1).alias("gi")), "i", "left")
    touched = touched.join(gappy.select(F.col("pos").alias("j"), F.lit(1).alias("gj")), "j", "left").where("gi is not null or gj is not null").select("i", "j")
    touched = shared_copy(touched)
    packed_ = pack(cells, weights, block, ragged=True)
    rest = [s for s in range(n_states) if s != gap_state]

    def kernel(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = here_x = here_y = asked = None
        for s in read_tile(batches, key[0] == key[1]):
            if isinstance(s, pd.DataFrame):
                asked = s
                i, j = asked["pos"].to_numpy(), asked["q"].to_numpy()
                counts, here_x, here_y = np.zeros((n_states, n_states, len(i))), np.zeros((n_states, len(i)), bool), np.zeros((n_states, len(i)), bool)
                continue
            (u, nu), (v, nv) = ((lo, np.searchsorted(pos, k, "right") - lo) for pos, k, lo in ((s.i, i, np.searchsorted(s.i, i)), (s.j, j, np.searchsorted(s.j, j))))
            hx, hy = presence_of(s.x, n_states), presence_of(s.y, n_states)
            for k in range(nu.max(initial=0)):  # rows of a locus: one, but for cells that come again
                for r in range(nv.max(initial=0)):
                    at = np.flatnonzero((nu > k) & (nv > r))
                    counts[:, :, at] += listed_counts(s.x, s.y, u[at] + k, v[at] + r, s.w, n_states, block)
                    here_x[:, at] |= hx[:, u[at] + k]
                    here_y[:, at] |= hy[:, v[at] + r]
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            c = counts[:, :, at]
            met = (c if gap_mode == "literal" else c[np.ix_(rest, rest)]).sum((0, 1)) > 0
            mi = without_gaps(c, here_x[:, None, at] & here_y[None, :, at], alpha, gap_state, gap_mode)
            yield pd.DataFrame({"i": i[at], "j": j[at], "mi_wo_gaps": np.where(met, mi, 0.0)})

    found = tile_rows(packed_, n_states, touched).groupBy("ti", "tj").applyInPandas(kernel, "i long, j long, mi_wo_gaps double")
    found = found.withColumnsRenamed({"i": "_i", "j": "_j"})
    named = touched.join(found, (F.least("i", "j") == F.col("_i")) & (F.greatest("i", "j") == F.col("_j")), "left")
    return named.select("i", "j", F.coalesce("mi_wo_gaps", F.lit(0.0)).alias("mi_wo_gaps"))


def with_gap_effect(edges: DataFrame, gap_free: DataFrame) -> DataFrame:
    """Edges with ``mi_wo_gaps`` (their own MI where no gap-free value exists) and ``gap_effect`` in per cent."""
    from pairlace.functions.scalars import gap_effect

    out = edges.join(gap_free, ["i", "j"], "left").withColumn("mi_wo_gaps", F.coalesce("mi_wo_gaps", "mi"))
    return out.withColumn("gap_effect", gap_effect(F.col("mi"), F.col("mi_wo_gaps")))


EDGES = "kind string, i long, j long, mi double, mi_wo_gaps double"
COUNTS = "ti int, tj int, p int, q int, i binary, j binary, here_x binary, here_y binary, counts binary"
COUNTS_OF = [c.split()[0] for c in COUNTS.split(", ")]
COUNTED = 128  # loci on a side of what a tile of several slices multiplies at once


def _rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    return v if digits is None else np.round(v, digits)


class _Tile:
    """The loci of a tile, the states that they have, and the counts of its pairs of blocks where samples come in slices."""

    def __init__(self, block: int, n_states: int) -> None:
        self.block, self.n_states = block, n_states
        self.counts: dict[tuple[int, int], np.ndarray] = {}
        self.here_x = self.here_y = None

    def see(self, s: Slice) -> None:
        here = presence(s.x, self.n_states), presence(s.y, self.n_states)
        self.i, self.j, self.own = s.i, s.j, s.own
        self.here_x, self.here_y = here if self.here_x is None else (self.here_x | here[0], self.here_y | here[1])

    def add(self, s: Slice) -> None:
        self.see(s)
        for p, q in self.blocks():
            c = block_counts(s.x[p : p + self.block], s.y[q : q + self.block], s.w, self.n_states)
            self.counts[p, q] = self.counts[p, q] + c if (p, q) in self.counts else c

    def told(self, key: tuple) -> pd.DataFrame:
        loci = {"i": self.i.tobytes(), "j": self.j.tobytes(), "here_x": self.here_x.tobytes(), "here_y": self.here_y.tobytes()}
        return pd.DataFrame([{"ti": key[0], "tj": key[1], "p": p, "q": q, **loci, "counts": c.tobytes()} for (p, q), c in self.counts.items()], columns=COUNTS_OF)

    def join(self, row) -> None:
        """Adds what a share of the tile's slices told."""
        self.i, self.j = np.frombuffer(row.i, np.int64), np.frombuffer(row.j, np.int64)
        here = tuple(np.frombuffer(x, bool).reshape(self.n_states, -1) for x in (row.here_x, row.here_y))
        self.here_x, self.here_y = here if self.here_x is None else (self.here_x | here[0], self.here_y | here[1])
        c = np.frombuffer(row.counts).reshape(self.n_states, self.n_states, len(self.i[row.p : row.p + self.block]), -1)
        self.counts[row.p, row.q] = self.counts[row.p, row.q] + c if (row.p, row.q) in self.counts else c

    def blocks(self) -> list[tuple[int, int]]:
        return [(p, q) for p in range(0, len(self.i), self.block) for q in range(p if self.own else 0, len(self.j), self.block)]


class _Found:
    """What a tile tells: its edges, each locus's largest MI, and how many pairs were not evaluated."""

    def __init__(self, alpha, threshold, ld, genome_size, gap_state, gap_mode, digits, top) -> None:
        self.alpha, self.threshold, self.ld, self.genome_size, self.gap_state, self.gap_mode, self.digits, self.top = alpha, threshold, ld, genome_size, gap_state, gap_mode, digits, top
        self.floor = -np.inf  # with ``top`` strongest edges at hand, weaker ones are of no use
        self.edges: list[tuple[np.ndarray, ...]] = []
        self.best: dict[int, float] = {}
        self.skipped = 0

    def most(self, pos: np.ndarray) -> np.ndarray:
        return np.array([self.best.get(k, -np.inf) for k in pos.tolist()])

    def take(self, pi, pj, hx, hy, counts) -> None:
        here = hx[:, None, :, None] & hy[None, :, None, :]
        mi = _rounded(entropies(counts, here, self.alpha), self.digits)
        upper = pi[:, None] < pj[None, :]
        d = np.abs(pi[:, None] - pj[None, :])
        d = d if self.genome_size is None else np.minimum(d, self.genome_size - d)
        far = np.where(upper & (d > self.ld), mi, -np.inf)
        for k, m in zip(np.r_[pi, pj].tolist(), np.r_[far.max(1), far.max(0)].tolist(), strict=True):
            if m > self.best.get(k, -np.inf):
                self.best[k] = m
        u, v = np.nonzero(upper & (mi >= self.floor) if self.threshold is None else upper & (mi > self.threshold) & (mi >= self.floor))
        wo = np.full(len(u), np.nan)
        if self.gap_state is not None and len(u):
            touched = hx[self.gap_state][u] | hy[self.gap_state][v]
            if touched.any():
                a, b = u[touched], v[touched]
                wo[touched] = _rounded(without_gaps(counts[:, :, a, b], here[:, :, a, b], self.alpha, self.gap_state, self.gap_mode), self.digits)
        self.edges.append((pi[u], pj[v], mi[u, v], wo))
        if self.top is not None and sum(len(e[0]) for e in self.edges) > 2 * self.top:
            self.strongest()

    def strongest(self) -> None:
        i, j, mi, wo = (np.concatenate(x) for x in zip(*self.edges, strict=True))
        if self.top is not None and len(i) > self.top:
            keep = np.lexsort((j, i, -mi))[: self.top]
            i, j, mi, wo = i[keep], j[keep], mi[keep], wo[keep]
            self.floor = float(mi[-1])
        self.edges = [(i, j, mi, wo)]

    def rows(self) -> pd.DataFrame:
        if self.edges:
            self.strongest()
        i, j, mi, wo = self.edges[0] if self.edges else [np.zeros(0)] * 4
        parts = [pd.DataFrame({"kind": "max", "i": list(self.best), "j": list(self.best), "mi": list(self.best.values()), "mi_wo_gaps": np.nan}), pd.DataFrame({"kind": "edge", "i": i, "j": j, "mi": mi, "mi_wo_gaps": wo})]
        if self.skipped:
            parts.append(pd.DataFrame({"kind": "skipped", "i": [self.skipped], "j": [self.skipped], "mi": np.nan, "mi_wo_gaps": np.nan}))
        return pd.concat(parts, ignore_index=True)


def _bounded_scan(tile: _Tile, s: Slice, found: _Found, maxima: bool) -> None:
    """All pairs of a tile but for those that can change nothing: MI is at most the smaller of two loci's bounds, so a pair
    counts only if that exceeds the threshold or, where maxima are wanted, the largest MI known of either locus. Blocks with
    the largest bounds come first, as they raise what is known. A locus whose best partner is far from its bound meets all others
    for the sake of its maximum; without maxima few loci meet at a high threshold."""
    slack = 1e-9
    bound = lambda x, here: marginal_bound(np.stack([((x == a) * (1.0 if s.w is None else s.w)).sum(1) for a in range(tile.n_states)]), here, found.alpha, tile.n_states) + slack
    bx = bound(s.x, tile.here_x)
    by = bx if s.own else bound(s.y, tile.here_y)
    n, tau = tile.block, -np.inf if found.threshold is None else found.threshold
    for p, q in sorted(tile.blocks(), key=lambda b: -min(bx[b[0] : b[0] + n].max(), by[b[1] : b[1] + n].max())):
        most = np.minimum(bx[p : p + n, None], by[None, q : q + n])
        need = most > tau
        if maxima:
            need |= (most > found.most(s.i[p : p + n])[:, None]) | (most > found.most(s.j[q : q + n])[None])
        rows, cols = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
        found.skipped += need.size - len(rows) * len(cols)
        if len(rows) and len(cols):
            found.take(s.i[p + rows], s.j[q + cols], tile.here_x[:, p + rows], tile.here_y[:, q + cols], block_counts(s.x[p + rows], s.y[q + cols], s.w, tile.n_states))


def block_mi(
    cells: DataFrame | Packed, weights: DataFrame | None = None, alpha: float = 0.5, threshold: float | None = None, block: int = 128,
    ld: int = 0, genome_size: int | None = None, n_states: int = N_STATES, gap_state: int | None = GAP, digits: int | None = None,
    gap_mode: str = "clean", top: int | None = None, tiles: Column | None = None, maxima: bool = True,
) -> DataFrame:
    """One pass over all pairs of loci, tile by tile: rows ``kind, i, j, mi, mi_wo_gaps``. Kind ``edge`` is a pair above the
    threshold (all pairs if None), with its gap-free MI where a locus has gaps; kind ``max`` has, for each locus i
    of a tile, the largest MI with a locus further away than ``ld`` (on a circle if ``genome_size`` is given): over the tiles, the
    largest of all; none if ``maxima`` is off. Kind ``skipped`` counts the pairs of a tile that the loci's entropies rule out, with a threshold. ``digits``
    rounds MI before anything is compared, so that plans that add in another order agree. With ``top`` a tile tells only its ``top``
    strongest edges (ties by position); ``tiles`` is a condition on ``ti, tj``. Rows that leave the kernel are edges and maxima,
    however many slices the samples have; where few loci have many slices, counts of shares of the slices are added up first."""
    if gap_mode not in ("clean", "literal"):
        raise ValueError("gap_mode is 'clean' or 'literal'")
    packed_ = cells if isinstance(cells, Packed) else pack(cells, weights, block)
    whole = packed_.slices == 1
    side, shares = shares_of(packed_, n_states)
    at_once = packed_.block if whole else packed_.block * max(1, COUNTED // packed_.block)

    def start() -> tuple[_Tile, _Found]:
        return _Tile(at_once, n_states), _Found(alpha, threshold, ld, genome_size, gap_state, gap_mode, digits, top)

    def result(tile: _Tile, found: _Found) -> pd.DataFrame:
        for (p, q), counts in tile.counts.items():
            found.take(tile.i[p : p + at_once], tile.j[q : q + at_once], tile.here_x[:, p : p + at_once], tile.here_y[:, q : q + at_once], counts)
        if not maxima:
            found.best = {}
        return found.rows()

    def kernel(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, found = start()
        for s in read_tile(batches, key[0] == key[1]):
            if not whole:
                tile.add(s)
            elif len(s.i) and len(s.j):
                tile.see(s)
                _bounded_scan(tile, s, found, maxima)
        yield result(tile, found)

    def count(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, _ = start()
        for s in read_tile(batches, key[0] == key[1]):
            tile.add(s)
        yield tile.told(key)

    def add_up(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, found = start()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                tile.join(row)
        yield result(tile, found)

    rows = tile_rows(packed_, n_states, side=side, shares=shares)
    rows = rows if tiles is None else rows.where(tiles)
    if shares > 1:
        out = rows.groupBy("ti", "tj", "share").applyInPandas(count, COUNTS).groupBy("ti", "tj").applyInPandas(add_up, EDGES)
    else:
        out = rows.groupBy("ti", "tj").applyInPandas(kernel, EDGES)
    return out.withColumn("mi_wo_gaps", F.when(~F.isnan("mi_wo_gaps"), F.col("mi_wo_gaps")))


def listed_mi(cells: DataFrame | Packed, pairs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, block: int = 128, n_states: int = N_STATES) -> DataFrame:
    """``i, j, mi`` of the listed pairs alone, on packed loci: a pair goes to the tile of its loci, and a locus only to tiles
    that have pairs, so rows follow loci and pairs, not samples times pairs."""
    packed_ = cells if isinstance(cells, Packed) else pack(cells, weights, block)
    side = packed_.block

    def kernel(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = here_x = here_y = asked = u = v = None
        for s in read_tile(batches, key[0] == key[1]):
            if isinstance(s, pd.DataFrame):
                asked = s
                continue
            if counts is None:
                i, j = asked["pos"].to_numpy(), asked["q"].to_numpy()
                u, v = np.searchsorted(s.i, i), np.searchsorted(s.j, j)
                counts, here_x, here_y = 0.0, False, False
            counts = counts + listed_counts(s.x, s.y, u, v, s.w, n_states, side)
            here_x, here_y = here_x | presence(s.x, n_states), here_y | presence(s.y, n_states)
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            yield pd.DataFrame({"i": i[at], "j": j[at], "mi": entropies(counts[:, :, at], here_x[:, None, u[at]] & here_y[None, :, v[at]], alpha)})

    return tile_rows(packed_, n_states, pairs).groupBy("ti", "tj").applyInPandas(kernel, "i long, j long, mi double")


def all_pairs_kept(n_loci: int, keep: int) -> bool:
    """With so few loci that no pair would be left out, or too few to draw from, all pairs are kept."""
    total = pair_count(n_loci)
    return keep >= total or total < 10
