"""Packed alignments: loci as bytes, dealt to square tiles, read a slice of samples at a time.

``pack`` is done once; the threshold estimate, the scan of all pairs and listed pairs read the same stored rows. A row is one locus in
one slice of the samples. Slices are short enough that two sides of a tile fit ``TILE_BYTES``; a tile takes its slices one after another
into one table of counts, bounded by ``COUNT_BYTES``, so its memory follows neither the samples nor the loci.

Cells are laid out in small matrices as they come (``gather``), a byte a cell, and only those are stored and sent: no task gathers the
cells of a locus as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlace.config import N_STATES
from pairlace.operators.alignment import RaggedAlignmentError
from pairlace.operators.lineage import counted_copy, shared_copy
from pairlace.operators.tiles import TILE_BYTES, ZERO, deal, tile_side

CHUNK_CELLS = 1 << 20  # cells that a task lays out at once
SLICE_SAMPLES = 1 << 19  # samples in a slice at most, however few the loci
COUNT_BYTES = 128 << 20  # of counts that a tile adds up over slices
ROWS, WEIGHTS, ASKED = (0, 1), 2, 3  # kinds of a tile's rows: loci on its left and right side, weights, asked pairs


def locus_ranks(cells: DataFrame, span: int = 4096) -> DataFrame:
    """``pos, rank``: the dense rank of each locus from 0. Loci are ranked within spans of positions and spans are laid
    end to end, so no task sorts them all."""
    loci = cells.select("pos").distinct().withColumn("_span", F.floor(F.col("pos") / span))
    sizes = loci.groupBy("_span").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("_span").orderBy("pos")) - 1
    return loci.withColumn("_rn", own).join(starts, "_span").select("pos", (F.col("_rn") + F.col("_off")).alias("rank"))


@dataclass(frozen=True)
class Gathered:
    """Stored cells. ``chunks``: ``n, who, loci, data``, the samples and loci of a chunk in order (8 bytes each) and a byte for each
    locus and sample, 0 where there is no cell. A cell that comes again is in a chunk of its own."""

    chunks: DataFrame
    schema: StructType

    def cells(self) -> DataFrame:
        def run(batches):
            for batch in batches:
                for who, loci, data in zip(*(batch.column(c).to_pylist() for c in ("who", "loci", "data")), strict=True):
                    s, p, x = np.frombuffer(who, np.int64), np.frombuffer(loci, np.int64), np.frombuffer(data, np.uint8).reshape(len(loci) // 8, -1).T
                    i, j = np.nonzero(x)
                    for lo in range(0, len(i), 1 << 16):
                        u, v = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(s[u]), pa.array(p[v]), pa.array(x[u, v].astype(np.int32) - ZERO)], names=["sample", "pos", "state"])

        rows = self.chunks.select("who", "loci", "data").mapInArrow(run, "sample long, pos long, state int")
        return rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in ("sample", "pos", "state")])

    def counts(self, gap: int) -> dict:
        """``cells, gaps, last``: how many cells, those in state ``gap``, and the last locus; chunks are read, no rows of cells made."""

        def run(batches):
            for batch in batches:
                for loci, data in zip(batch.column("loci").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    x = np.frombuffer(data, np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)]) for k in (np.count_nonzero(x), np.count_nonzero(x == gap + ZERO), np.frombuffer(loci, np.int64).max())], names=["cells", "gaps", "last"])

        found = self.chunks.select("loci", "data").mapInArrow(run, "cells long, gaps long, last long")
        return found.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.max("last").alias("last")).first().asDict()


def _places(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; equal neighbours are looked up once."""
    head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    u, at = np.unique(v[head], return_inverse=True)
    return u, np.repeat(at, np.diff(np.r_[head, len(v)]))


def _laid(s: np.ndarray, p: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``samples, loci, bytes`` of cells; where few of a matrix's places would be taken, a matrix for each locus."""
    (who, i), (loci, j) = _places(s), _places(p)
    if len(loci) > 1 and len(who) * len(loci) > 4 * len(x) + 4096:
        order = np.argsort(j, kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(j))[:-1]):
            yield from _laid(s[at], p[at], x[at])
        return
    grid, code = np.zeros(len(who) * len(loci), np.uint8), j * len(who) + i
    grid[code] = x
    if np.count_nonzero(grid) < len(x):  # some cells come again: the first of each, then the others
        first = np.zeros(len(x), bool)
        first[np.unique(code, return_index=True)[1]] = True
        grid[code[first]] = x[first]
        yield who, loci, grid
        yield from _laid(s[~first], p[~first], x[~first])
    else:
        yield who, loci, grid


def gather(cells: DataFrame) -> Gathered:
    """Lays cells out a chunk at a time, and stores them. Cells without a sample, locus or state are left out."""
    most = CHUNK_CELLS

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p, x = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("sample", "pos", "state"))
        for who, loci, data in _laid(s, p, (x + ZERO).astype(np.uint8)):
            yield pa.RecordBatch.from_arrays([pa.array([len(who)], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in (who, loci, data)]], names=["n", "who", "loci", "data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield from told(held)
                held, n = [], 0
        if held:
            yield from told(held)

    rows = cells.select(F.col("sample").cast("long").alias("sample"), F.col("pos").cast("long").alias("pos"), F.col("state").cast("int").alias("state")).dropna()
    return Gathered(shared_copy(rows.mapInArrow(run, "n long, who binary, loci binary, data binary")), cells.schema)


def gather_wide(rows: DataFrame, derive: Callable[[pa.RecordBatch], dict[int, pa.Array]] | None = None) -> Gathered:
    """As ``gather``, from rows of a sample: ``sample``, and a column for each locus, named by its position. Columns are laid side by side as
    they come, and no row for a cell is made; where a state is null, there is no cell. ``derive`` makes the states of further loci from
    a batch's columns: expressions for many loci make a method that is too long for the JVM to compile."""
    names, most = [c for c in rows.columns if c.lstrip("-").isdigit()], CHUNK_CELLS

    def states(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = {int(c): batch.column(c) for c in names} | (derive(batch) if derive else {})
        x = [of[p].fill_null(-ZERO).to_numpy(zero_copy_only=False).astype(np.int8) for p in sorted(of)]
        return batch.column("sample").to_numpy(), np.array(sorted(of), np.int64), np.stack(x) + np.int8(ZERO)

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        s, loci, x = np.concatenate([h[0] for h in held]), held[0][1], np.concatenate([h[2] for h in held], axis=1)
        order = np.argsort(s, kind="stable")
        again = np.arange(len(s)) - np.searchsorted(s[order], s[order])  # rows of the same sample before
        for _, at in _cut(again):
            part = x[:, order[at]]
            p, i = part.any(1), part.any(0)
            if p.any():
                kept = (s[order[at]][i], loci[p], part[np.ix_(p, i)])
                yield pa.RecordBatch.from_arrays([pa.array([len(kept[0])], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in kept]], names=["n", "who", "loci", "data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(states(batch))
                n += held[-1][2].size
            if n >= most:
                yield from told(held)
                held, n = [], 0
        if held:
            yield from told(held)

    wide = rows.withColumns({"sample": F.col("sample").cast("long"), **{c: F.col(f"`{c}`").cast("tinyint") for c in names}}).dropna(subset=["sample"])
    kinds = StructType().add("sample", rows.schema["sample"].dataType).add("pos", "long").add("state", "byte")
    return Gathered(shared_copy(wide.mapInArrow(run, "n long, who binary, loci binary, data binary")), kinds)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _cut(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and its places."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    for lo, hi in zip(heads, np.r_[heads[1:], len(key)], strict=True):
        yield int(key[order[lo]]), order[lo:hi]


def _sample_lists(lists: DataFrame, buckets: int) -> DataFrame:
    """``slice, n, who``: the distinct samples of lists, dealt by hash, in order. Stored."""

    def split(batches):
        for batch in batches:
            for who in batch.column("who").to_pylist():
                ids = np.frombuffer(who, np.int64)
                for k, at in _cut(_bucket(ids, buckets)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ids[at].tobytes()], pa.binary())], names=["slice", "who"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.frombuffer(b"".join(pdf.who), np.int64))
        return pd.DataFrame({"slice": pdf.slice.iloc[:1].to_numpy(), "n": [len(ids)], "who": [ids.tobytes()]})

    return shared_copy(lists.select("who").mapInArrow(split, "slice int, who binary").groupBy("slice").applyInPandas(one, "slice int, n long, who binary"))


def _as_longs(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``at, name``, and the slice where there is one: packed numbers as rows."""
    has = "slice" in rows.columns

    def run(batches):
        for batch in batches:
            keys = batch.column("slice").to_pylist() if has else [0] * batch.num_rows
            for k, v in zip(keys, batch.column(column).to_pylist(), strict=True):
                ids = np.frombuffer(v, np.int64)
                for lo in range(0, len(ids), 1 << 16):
                    some = ids[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(np.arange(lo, lo + len(some))), pa.array(some)], names=["slice", "at", name])

    return rows.select(*(["slice"] if has else []), column).mapInArrow(run, f"slice int, at long, {name} long")


@dataclass(frozen=True)
class Packed:
    """``loci``: ``blk, pos, slice, data``, a byte a sample in order of sample. ``weights``: ``slice, w`` in the same order, or
    None where all samples weigh 1. ``ranks``: ``pos, rank``. ``lists``: ``slice, n, who``, the samples of a slice."""

    loci: DataFrame
    weights: DataFrame | None
    ranks: DataFrame
    n_loci: int
    n_samples: int
    slices: int
    block: int
    lists: DataFrame | None = None

    def samples(self) -> DataFrame:
        return _as_longs(self.lists, "who", "sample").select("sample")


def weight_rows(lists: DataFrame, weights: DataFrame) -> DataFrame:
    """``slice, w``: the samples' weights in order of sample, a row for each slice. Samples without a weight weigh nothing."""
    own = weights.select(F.col("sample").cast("long").alias("sample"), F.col("weight").cast("double").alias("w"))
    ws = _as_longs(lists, "who", "sample").join(own, "sample", "left")
    one = F.array_sort(F.collect_list(F.struct("at", F.coalesce("w", F.lit(0.0)).alias("w"))))  # one slice of samples
    return ws.groupBy("slice").agg(one.alias("w")).select("slice", F.col("w.w").alias("w"))


def _merged_rows(chunks: DataFrame, lists: DataFrame, ranks: DataFrame, slices: int, block: int, ragged: bool) -> DataFrame:
    """``blk, pos, slice, data, bad``: the rows of ``Packed``, from chunks cut by slice and by span of positions. A task has the loci of one
    span in one slice, some of them twice where a cell comes again; ``bad`` says what is missing or there twice."""
    width = max(block, 64)

    def split(batches):
        for batch in batches:
            for who, loci, data in zip(*(batch.column(c).to_pylist() for c in ("who", "loci", "data")), strict=True):
                s, p = np.frombuffer(who, np.int64), np.frombuffer(loci, np.int64)
                x = np.frombuffer(data, np.uint8).reshape(len(p), -1)
                for k, at in _cut(_bucket(s, slices)):
                    part = x if len(at) == len(s) else x[:, at]
                    for span, rows in _cut(p // width):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([span]), pa.array([s[at].tobytes()], pa.binary()), pa.array([p[rows].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(part[rows]).tobytes()], pa.binary())], names=["slice", "span", "who", "loci", "data"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        longs = lambda v: np.frombuffer(v, np.int64)
        who = longs(pdf.who[pdf.off.isna() & pdf.data.isna()].iloc[0])
        named = pdf[pdf.off.notna()].iloc[0]
        loci, layers = np.asarray(named.pos, np.int64), [np.zeros((len(named.pos), len(who)), np.uint8)]
        for s, p, x in pdf.loc[pdf.data.notna(), ["who", "loci", "data"]].itertuples(index=False):
            ix, x = np.ix_(np.searchsorted(loci, longs(p)), np.searchsorted(who, longs(s))), np.frombuffer(x, np.uint8).reshape(len(p) // 8, -1)
            for k in range(len(pdf)):
                if k == len(layers):
                    layers.append(np.zeros_like(layers[0]))
                now = layers[k][ix]
                layers[k][ix] = np.where(now == 0, x, now)
                x = np.where(now == 0, 0, x)
                if not x.any():
                    break
        bad = None
        if not ragged:
            for at, what in [(layers[0] == 0, "has no cell of"), *[(y > 0, "has more than one cell of") for y in layers[1:2]]]:
                if at.any():
                    u, v = np.unravel_index(at.argmax(), at.shape)
                    bad = f"locus {loci[u]} {what} sample {who[v]}"
        used = [(k, y) for k, y in enumerate(layers) if k == 0 or y.any()]
        rows = [(int((named.off + r) // block), int(loci[r]), y[r].tobytes()) for k, y in used for r in range(len(loci)) if k == 0 or y[r].any()]
        out = pd.DataFrame(rows, columns=["blk", "pos", "data"])
        return out.assign(slice=pdf.slice.iloc[0], bad=bad)

    none = lambda kind: F.lit(None).cast(kind)
    spans = ranks.groupBy(F.floor(F.col("pos") / width).alias("span")).agg(F.min("rank").alias("off"), F.array_sort(F.collect_list(F.col("pos").cast("long"))).alias("pos"))  # ``width`` loci at most
    spans = shared_copy(spans)
    parts = chunks.select("who", "loci", "data").mapInArrow(split, "slice int, span long, who binary, loci binary, data binary").withColumns({"off": none("long"), "pos": none("array<long>")})
    names = spans.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "span", none("binary").alias("who"), none("binary").alias("loci"), none("binary").alias("data"), "off", "pos")
    names = names.join(F.broadcast(lists.select("slice")), "slice", "left_semi")  # one number a slice
    ids = lists.select("slice", "who").crossJoin(F.broadcast(spans.select("span")))  # one number a span
    ids = ids.select("slice", "span", "who", none("binary").alias("loci"), none("binary").alias("data"), none("long").alias("off"), none("array<long>").alias("pos"))
    return parts.unionByName(names).unionByName(ids).groupBy("slice", "span").applyInPandas(merge, "blk int, pos long, data binary, slice int, bad string")


def pack(cells: DataFrame | Gathered, weights: DataFrame | None = None, block: int = 128, ragged: bool = False) -> Packed:
    """Raises RaggedAlignmentError where loci don't have the same samples, once each, as bytes then would not stand side by side. With
    ``ragged`` a sample that a locus lacks is byte 0 there, and a locus with several cells of a sample has several rows."""
    held = cells if isinstance(cells, Gathered) else gather(cells)
    chunks, kind = held.chunks, held.schema["pos"].dataType
    most = chunks.agg(F.sum("n")).first()[0] or 0
    lists = _sample_lists(chunks, first := max(1, -(-most // SLICE_SAMPLES)))
    n_samples = lists.agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-n_samples * 2 * block // TILE_BYTES), -(-n_samples // SLICE_SAMPLES))
    lists = lists if slices == first else _sample_lists(lists, slices)
    ranks = shared_copy(locus_ranks(_as_longs(chunks, "loci", "pos")).select(F.col("pos").cast(kind).alias("pos"), "rank"))
    n_loci = ranks.count()
    rows, seen = counted_copy(_merged_rows(chunks, lists, ranks, slices, block, ragged), bad=F.min("bad"))
    if seen.get("bad"):
        raise RaggedAlignmentError(seen["bad"])
    ws = None
    if weights is not None and weights.agg(F.min("weight"), F.max("weight")).first() != (1.0, 1.0):
        ws = shared_copy(weight_rows(lists, weights))
    return Packed(rows.select("blk", F.col("pos").cast(kind).alias("pos"), "slice", "data"), ws, ranks, n_loci, n_samples, slices, block, lists)


def side_of(p: Packed, n_states: int = N_STATES, spread: bool = True) -> int:
    """Blocks on a side of a tile; without ``spread``, as many as fit, however few tiles there are then."""
    n_blocks = max(1, -(-p.n_loci // p.block))
    side = tile_side(n_blocks, p.block * -(-p.n_samples // p.slices), p.loci.sparkSession.sparkContext.defaultParallelism, spread)
    if p.slices > 1:
        side = min(side, max(1, int((COUNT_BYTES / (8 * n_states**2 * p.block**2)) ** 0.5)))
    return side


def shares_of(p: Packed, n_states: int = N_STATES) -> tuple[int, int]:
    """Blocks on a side of a tile, and the shares into which a tile's slices are dealt. Small tiles keep all cores busy but send a locus
    many times; a few large tiles in shares send it a few times, and then the counts of each share. What sends less is taken."""
    n_blocks, cores = max(1, -(-p.n_loci // p.block)), p.loci.sparkSession.sparkContext.defaultParallelism
    small, large = side_of(p, n_states), side_of(p, n_states, spread=False)
    often, seldom = -(-n_blocks // small), -(-n_blocks // large)
    shares = min(p.slices, -(-8 * cores // (seldom * (seldom + 1))))
    cells, counts = p.n_loci * p.n_samples, 4 * (p.n_loci * n_states) ** 2
    return (large, shares) if shares > 1 and cells * seldom + counts * shares < cells * often else (small, 1)


def tile_rows(p: Packed, n_states: int = N_STATES, pairs: DataFrame | None = None, side: int | None = None, shares: int = 1) -> DataFrame:
    """``ti, tj, slice, at, pos, data, w, q``: what each tile needs, in order of slices. With ``pairs`` only tiles that hold
    some of them, which come first (``pos`` with ``q``, slice -1). With ``shares`` also ``share``, and in order within it."""
    side, n_blocks = side or side_of(p, n_states), max(1, -(-p.n_loci // p.block))
    none = lambda kind: F.lit(None).cast(kind)
    rows = deal(p.loci, n_blocks, side).select("ti", "tj", "slice", "at", F.col("pos").cast("long").alias("pos"), "data", none("array<double>").alias("w"), none("long").alias("q"))
    last = (n_blocks - 1) // side
    spark = p.loci.sparkSession
    grid = spark.range(last + 1).select(F.col("id").cast("int").alias("ti")).select("ti", F.explode(F.sequence("ti", F.lit(last))).alias("tj"))
    if pairs is not None:
        at = p.ranks.select("pos", F.floor(F.col("rank") / (p.block * side)).cast("int").alias("tile"))
        asked = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
        asked = asked.join(at.select(F.col("pos").alias("i"), F.col("tile").alias("ti")), "i").join(at.select(F.col("pos").alias("j"), F.col("tile").alias("tj")), "j")
        asked = shared_copy(asked)  # read for the tiles that are needed, and for their rows
        grid = shared_copy(grid.join(asked.select("ti", "tj").distinct(), ["ti", "tj"]))
        rows = rows.join(F.broadcast(grid), ["ti", "tj"], "left_semi")  # two numbers a tile
        rows = rows.unionByName(asked.select("ti", "tj", F.lit(-1).alias("slice"), F.lit(ASKED).alias("at"), F.col("i").cast("long").alias("pos"), none("binary").alias("data"), none("array<double>").alias("w"), F.col("j").cast("long").alias("q")))
    if p.weights is not None:
        ws = p.weights.crossJoin(F.broadcast(grid))  # a row a slice, two numbers a tile
        rows = rows.unionByName(ws.select("ti", "tj", "slice", F.lit(WEIGHTS).alias("at"), none("long").alias("pos"), none("binary").alias("data"), "w", none("long").alias("q")))
    if p.slices == 1 and pairs is None:
        return rows
    if shares > 1:
        rows = rows.withColumn("share", F.pmod("slice", F.lit(shares)))
    key = ["ti", "tj", "share"] if shares > 1 else ["ti", "tj"]
    return rows.repartition(*key).sortWithinPartitions(*key, "slice", "at")


@dataclass
class Slice:
    """A tile's rows in one slice: positions and states of both sides (one and the same on the diagonal), and the weights."""

    i: np.ndarray
    x: np.ndarray
    j: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    own: bool


def _as_slice(pdf: pd.DataFrame, own: bool) -> Slice:
    def side(at: int):
        rows = pdf[pdf["at"] == at].sort_values("pos")
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros((0, 0), np.int8)
        return rows["pos"].to_numpy(np.int64), np.frombuffer(b"".join(rows["data"]), np.int8).reshape(len(rows), -1) - np.int8(ZERO)

    w = pdf[pdf["at"] == WEIGHTS]
    left = side(0)
    right = left if own else side(1)
    return Slice(*left, *right, np.asarray(w["w"].iloc[0], float) if len(w) else None, own)


def read_tile(batches: Iterator[pd.DataFrame], own: bool) -> Iterator[pd.DataFrame | Slice]:
    """The asked pairs, then the slices of a tile, one after another; a slice's rows are gathered, no more."""
    held: list[pd.DataFrame] = []
    now = None

    def told():
        rows = pd.concat(held, ignore_index=True)
        return rows[["pos", "q"]].astype("int64") if now == -1 else _as_slice(rows, own)

    for pdf in batches:
        at = pdf["slice"].to_numpy()
        cut = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if now is not None and at[lo] != now:
                if at[lo] < now:
                    raise RuntimeError("a tile's slices came out of order")
                yield told()
                held = []
            now = at[lo]
            held.append(pdf.iloc[lo:hi])
    if held:
        yield told()
