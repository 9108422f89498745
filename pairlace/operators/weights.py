"""Distances between samples, and the weights that correct for redundant samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.operators.alignment import RaggedAlignmentError
from pairlace.operators.lineage import shared_copy
from pairlace.operators.packed import Packed, pack, read_tile, side_of, tile_rows
from pairlace.operators.tiles import TILE_BYTES, ZERO, deal, numbered_parts, packed, tile_side


BLOCK, STRETCH = 256, 4096  # samples on the left and right side of a product
HOT_CELLS = 1 << 23  # in a one-hot matrix
STRIPES = 4  # a core, of samples that are met with all others in order
HELD_BYTES = 32 << 20  # of distances that a stripe holds at once

#: Makes rows of a block of distances: samples, other samples (both in order), shared loci and loci that differ, for each of both.
Form = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _hot(x: np.ndarray, states: range) -> np.ndarray:
    return np.concatenate([x == k for k in states], axis=1).astype(np.float32)


def _alike(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared loci and those of equal states, for each row of x and of y; states below 0 are none."""
    n, same = (np.zeros((len(x), len(y)), np.float32 if x.shape[1] < 1 << 24 else np.float64) for _ in range(2))
    states = range(max(0, x.min()), max(0, min(x.max(), y.max())) + 1)
    wide = max(64, HOT_CELLS // (len(states) * max(len(x), len(y))))
    for lo in range(0, x.shape[1], wide):
        u, v = x[:, lo : lo + wide], y[:, lo : lo + wide]
        if (u >= 0).all() and (v >= 0).all():
            n += u.shape[1]
        else:
            n += (u >= 0).astype(np.float32) @ (v >= 0).astype(np.float32).T
        same += _hot(u, states) @ _hot(v, states).T
    return n, same


def _met(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_alike``, for samples whose first rows are ``a`` and ``b``: rows of one sample stand together."""
    now = _alike(x, y)
    if len(a) < len(x) or len(b) < len(y):
        now = tuple(np.add.reduceat(np.add.reduceat(k, a, 0), b, 1) for k in now)
    return now


@dataclass(frozen=True)
class Distances:
    """All pairs of samples (``square``: in both directions, and each with itself) that share a locus. Samples are packed as loci are
    elsewhere, so what is sent follows the samples and what comes out the pairs, never loci times pairs."""

    packed: Packed
    square: bool = False

    def ordered(self) -> bool:
        """Whether one task can hold all samples beside its own ones."""
        return self.packed.slices == 1 and self.packed.n_loci * self.packed.n_samples <= TILE_BYTES

    def in_tiles(self, form: Form, schema: str) -> DataFrame:
        """What ``form`` makes, tile by tile, in no order, in pieces of ``STRETCH`` samples; ``blk`` is the block of the first samples."""
        p, square, whole, side = self.packed, self.square, self.packed.slices == 1, side_of(self.packed)

        def told(tile, lo, i, j, n, same):
            for batch in form(i, j, n, n - same):
                yield batch.append_column("blk", pa.array(np.full(batch.num_rows, tile * side + lo // BLOCK, np.int32)))

        def both(key, lo, at, i, j, n, same):
            yield from told(key[0], lo, i, j, n, same)
            if square and key[0] != key[1]:
                for k in range(0, len(j), BLOCK):
                    yield from told(key[1], at + k, j[k : k + BLOCK], i, n.T[k : k + BLOCK], same.T[k : k + BLOCK])

        def kernel(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = tuple(k.as_py() for k in key)
            own, sums = key[0] == key[1], {}
            for s in read_tile((b.to_pandas() for b in batches), own):
                (i, a), (j, b) = (np.unique(k, return_index=True) for k in (s.i, s.j))
                for lo in range(0, len(i), BLOCK):
                    x, left = s.x[a[lo] : np.append(a, len(s.x))[min(len(i), lo + BLOCK)]], a[lo : lo + BLOCK] - a[lo]
                    for at in range(0, len(j), STRETCH):
                        if own and not square and j[min(len(j), at + STRETCH) - 1] <= i[lo]:
                            continue
                        y, right = s.y[b[at] : np.append(b, len(s.y))[min(len(j), at + STRETCH)]], b[at : at + STRETCH] - b[at]
                        now = _met(x, y, left, right)
                        if whole:
                            yield from both(key, lo, at, i[lo : lo + BLOCK], j[at : at + STRETCH], *now)
                        else:
                            sums[lo, at] = tuple(map(np.add, sums[lo, at], now)) if (lo, at) in sums else now
            for (lo, at), now in sums.items():
                yield from both(key, lo, at, i[lo : lo + BLOCK], j[at : at + STRETCH], *now)

        return tile_rows(p).groupBy("ti", "tj").applyInArrow(kernel, f"{schema}, blk int")

    def in_order(self, form: Form, schema: str) -> DataFrame:
        """What ``form`` makes, in order of the samples: partitions are stripes of samples, each of which is sent the other samples (the
        later ones, or with ``square`` all) and makes a sample's row at once. Distances are neither sent nor sorted."""
        p, square = self.packed, self.square
        n_blocks = max(1, -(-p.n_loci // p.block))
        side = max(1, n_blocks // (STRIPES * p.loci.sparkSession.sparkContext.defaultParallelism))
        last, own = (n_blocks - 1) // side, F.floor(F.col("blk") / side).cast("int")
        to = F.sequence(F.lit(0), F.lit(last) if square else own)
        rows = p.loci.select(own.alias("own"), F.explode(to).alias("stripe"), F.col("pos").cast("long").alias("pos"), "data")

        def stripe(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, x = rows["pos"].to_numpy(), np.frombuffer(b"".join(rows["data"].to_pylist()), np.int8).reshape(len(rows), -1) - np.int8(ZERO)
            who, first = np.unique(ids, return_index=True)
            ends, mine = np.append(first, len(ids)), np.flatnonzero((rows["own"].to_numpy() == rows["stripe"].to_numpy())[first])
            kind = np.min_scalar_type(x.shape[1] * int(np.diff(ends).max()) ** 2)  # a cell that comes again meets each of the other's
            step = max(1, min(BLOCK, HELD_BYTES // (2 * len(who) * kind.itemsize)))
            for lo in range(mine[0], mine[-1] + 1, step):
                hi = min(lo + step, mine[-1] + 1)
                start = 0 if square else lo
                n, differ = np.empty((hi - lo, len(who) - start), kind), np.empty((hi - lo, len(who) - start), kind)
                for at in range(start, len(who), STRETCH):
                    to = min(at + STRETCH, len(who))
                    some, same = _met(x[first[lo] : ends[hi]], x[first[at] : ends[to]], first[lo:hi] - first[lo], first[at:to] - first[at])
                    n[:, at - start : to - start], differ[:, at - start : to - start] = some, some - same
                yield from form(who[lo:hi], who[start:], n, differ)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now = [], None
            for batch in batches:
                at = batch.column("stripe").to_numpy()
                cut = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if hi > lo and at[lo] != now and held:
                        yield from stripe(pa.Table.from_batches(held))
                        held = []
                    if hi > lo:
                        now = at[lo]
                        held.append(batch.slice(lo, hi - lo))
            if held:
                yield from stripe(pa.Table.from_batches(held))

        return numbered_parts(rows, last + 1, "stripe").sortWithinPartitions("stripe", "pos").mapInArrow(run, schema)


def hamming_strips(cells: DataFrame, square: bool = False) -> Distances:
    """The distances of a sample to later samples (with ``square`` to all, itself included), multiplied block by block. Samples that share
    no locus don't meet, and a cell that comes again counts again, as in a join on the locus."""
    return Distances(pack(cells.select(F.col("pos").alias("sample"), F.col("sample").alias("pos"), "state"), None, BLOCK, ragged=True), square)


def hamming_distances(cells: DataFrame) -> DataFrame:
    """``s, t, n_loci, distance`` for each pair of samples s < t that share a locus, one row a pair. Rows come in squares of pairs, so that
    their columns repeat a few values and take little space where they are stored."""

    def pairs(s, t, n, differ):
        for lo in range(0, len(t), BLOCK):
            some, far, other = n[:, lo : lo + BLOCK], differ[:, lo : lo + BLOCK], t[lo : lo + BLOCK]
            u, v = np.nonzero((some > 0) & (s[:, None] < other))
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in (s[u], other[v], some[u, v].astype(np.int64), far[u, v].astype(np.int64))], names=["s", "t", "n_loci", "distance"])

    kind = cells.schema["sample"].dataType
    found = hamming_strips(cells).in_tiles(pairs, "s long, t long, n_loci long, distance long")
    return found.select(F.col("s").cast(kind).alias("s"), F.col("t").cast(kind).alias("t"), "n_loci", "distance")


def sample_rows(cells: DataFrame) -> DataFrame:
    """``sample, data``: each sample's states in order of position, a byte each; one row a sample. Stored. Raises
    RaggedAlignmentError where samples don't have the same positions."""
    cell = F.struct("pos", F.col("state").cast("int").alias("state"))
    rows = cells.groupBy("sample").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    rows = shared_copy(rows.select("sample", packed(F.col("c.state")).alias("data"), F.xxhash64("c.pos").alias("_p"), F.size("c").alias("_n")))
    one, other = rows.agg(F.min(F.struct("_n", "_p", "sample")), F.max(F.struct("_n", "_p", "sample"))).first()
    if one is not None and (one["_n"], one["_p"]) != (other["_n"], other["_p"]):
        raise RaggedAlignmentError(f"samples {one['sample']} and {other['sample']} have {one['_n']} and {other['_n']} loci, or different ones")
    return rows.select("sample", "data")


def similar_counts(cells: DataFrame, identity: float, plan: str = "auto", block: int = 256) -> DataFrame:
    """``sample, n``: how many samples, itself included, share at least ``identity`` of their loci with it. Equal samples count
    as one row with their number. ``tiles`` compares all pairs of rows by matrix products; ``parts`` only those that agree in some part of
    the loci (``part_groups``); ``auto`` takes the parts where they leave a quarter of the pairs or fewer. No row for a pair of
    samples is ever made."""
    if plan not in ("auto", "tiles", "parts"):
        raise ValueError("plan is 'auto', 'tiles' or 'parts'")
    named = sample_rows(cells).withColumn("who", F.sha2("data", 256))
    rows = shared_copy(named.groupBy("who").agg(F.min("sample").cast("long").alias("id"), F.count("*").alias("copies"), F.first("data").alias("data")))
    n, loci = rows.agg(F.count("*"), F.max(F.length("data"))).first()
    loci = loci or 0
    apart = loci - need_equal(identity, loci)  # loci in which a similar sample may differ
    groups = None
    if plan != "tiles" and 0 <= apart < loci:
        groups = shared_copy(part_groups(rows, apart + 1))
        pairs = groups.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        groups = groups if plan == "parts" or pairs * 4 <= float(n) * n else None
    found = _met_in_parts(rows, groups, apart, loci) if groups is not None else _met_in_tiles(rows, n, loci, identity, block)
    total = rows.select("id", "copies").unionByName(found).groupBy("id").agg(F.sum("copies").alias("n"))
    return named.select("sample", "who").join(rows.select("who", "id"), "who").join(total, "id").select("sample", "n")


def need_equal(identity: float, loci: int) -> int:
    """Equal loci that make two samples similar."""
    return max(0, int(np.ceil(identity * loci - 1e-6)))


def part_keys(rows: DataFrame, parts: int) -> DataFrame:
    """``part, key, id``: a hash of each row's states in each of ``parts`` parts of the loci. Locus k is in part k mod
    ``parts``, so that neighbours, which vary together, are in different parts."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for id_, data in zip(pdf["id"], pdf["data"], strict=True):
                x = np.frombuffer(data, np.uint8).astype(np.uint64)
                x = np.r_[x, np.zeros(-len(x) % parts, np.uint64)].reshape(-1, parts)
                h = np.zeros(parts, np.uint64)
                for line in x:
                    h = (h ^ line) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield pd.DataFrame({"part": np.arange(parts, dtype=np.int32), "key": h.view(np.int64), "id": id_})

    return rows.select("id", "data").mapInPandas(keys, "part int, key long, id long")


def part_groups(rows: DataFrame, parts: int) -> DataFrame:
    """``part, key, id, n``: the rows that agree with another in a part, with their number. Two rows that differ in fewer loci than there
    are parts agree in one part at least, so no similar pair is missed."""
    keys = shared_copy(part_keys(rows, parts))
    sizes = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(sizes, ["part", "key"])


UNIT, BUCKET_BYTES, AT_ONCE = 512, 16 << 20, 1 << 24


def _met_in_parts(rows: DataFrame, groups: DataFrame, apart: int, loci: int) -> DataFrame:
    """``id, copies``: for each row the copies of a similar one, met in a part. Groups are cut into units of two blocks of ``UNIT`` rows,
    and units dealt to buckets of bounded size; a pair counts in the first part in which it agrees."""
    parts = apart + 1
    blocks = F.ceil(F.col("n") / UNIT).cast("int")
    blk = F.pmod(F.xxhash64("id", "part"), blocks).cast("int")
    units = groups.withColumn("nb", blocks).withColumn("blk", blk)
    left = units.withColumn("ti", F.col("blk")).withColumn("tj", F.explode(F.sequence(F.col("blk"), F.col("nb") - 1))).withColumn("at", F.lit(0))
    right = units.withColumn("tj", F.col("blk")).withColumn("ti", F.explode(F.sequence(F.lit(0), F.col("blk")))).where("ti < tj").withColumn("at", F.lit(1))
    dealt = left.unionByName(right).select("part", "key", "ti", "tj", "at", "id")
    buckets = max(1, -(-dealt.count() * max(1, loci) // BUCKET_BYTES))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("part", "key", "ti", "tj"), F.lit(buckets))).join(rows.select("id", "copies", "data"), "id")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out_id, out_n = [], []
        for (part, _, ti, tj), unit in pdf.groupby(["part", "key", "ti", "tj"], sort=False):
            sides = [unit[unit["at"] == k] for k in ((0, 0) if ti == tj else (0, 1))]
            (s, x, cx), (t, y, cy) = ((u["id"].to_numpy(), np.frombuffer(b"".join(u["data"]), np.uint8).reshape(len(u), loci), u["copies"].to_numpy()) for u in sides)
            step = max(1, AT_ONCE // max(1, len(t) * loci))
            for lo in range(0, len(s), step):
                differ = x[lo : lo + step, None, :] != y[None]
                near = differ.sum(-1) <= apart
                if ti == tj:
                    near &= s[lo : lo + step, None] < t[None]
                a, b = np.nonzero(near)
                if len(a):
                    d = differ[a, b]
                    d = np.pad(d, ((0, 0), (0, -loci % parts))).reshape(len(a), -1, parts).any(1)
                    first = (~d).argmax(1) == part
                    a, b = a[first] + lo, b[first]
                    out_id += [s[a], t[b]]
                    out_n += [cy[b], cx[a]]
        if not out_id:
            return pd.DataFrame({"id": [], "copies": []}, dtype="int64")
        return pd.DataFrame({"id": np.concatenate(out_id), "copies": np.concatenate(out_n)}).groupby("id", as_index=False)["copies"].sum()

    return dealt.groupBy("bucket").applyInPandas(meet, "id long, copies long")


def _met_in_tiles(rows: DataFrame, n: int, loci: int, identity: float, block: int) -> DataFrame:
    """As ``_met_in_parts``, by products of all pairs of blocks, dealt to tiles."""
    n_blocks = max(1, -(-n // block))
    side = tile_side(n_blocks, block * max(1, loci), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = deal(rows.select("id", "copies", "data").withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")), n_blocks, side)
    need = need_equal(identity, loci)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.ti.iloc[0] == pdf.tj.iloc[0]
        sides = []
        for at in (0, 0) if own else (0, 1):
            part = pdf[pdf["at"] == at]
            sides.append((part["id"].to_numpy(), np.frombuffer(b"".join(part["data"]), np.int8).reshape(len(part), loci), part["copies"].to_numpy()))
        (s, x, cx), (t, y, cy) = sides
        found = np.zeros(len(s), np.int64), np.zeros(len(t), np.int64)
        states = np.union1d(np.unique(x), np.unique(y))
        for p in range(0, len(s), block):
            for q in range(0, len(t), block):
                same = np.zeros((len(s[p : p + block]), len(t[q : q + block])), np.float32)
                for lo in range(0, x.shape[1], 1 << 16):
                    a, b = x[p : p + block, lo : lo + (1 << 16)], y[q : q + block, lo : lo + (1 << 16)]
                    same += sum((a == v).astype(np.float32) @ (b == v).astype(np.float32).T for v in states)
                near = (same >= need) & (s[p : p + block, None] != t[None, q : q + block])
                found[0][p : p + block] += near @ cy[q : q + block]
                found[1][q : q + block] += cx[p : p + block] @ near
        out = pd.DataFrame({"id": s, "copies": found[0]})
        return out if own else pd.concat([out, pd.DataFrame({"id": t, "copies": found[1]})], ignore_index=True)

    return dealt.groupBy("ti", "tj").applyInPandas(count, "id long, copies long")


def sample_weights(cells: DataFrame, identity: float = 0.9, plan: str = "auto") -> DataFrame:
    """``sample, weight``: one over the number of samples that count as equal, itself included."""
    return similar_counts(cells, identity, plan).select("sample", (1.0 / F.col("n")).alias("weight"))


def unit_weights(cells: DataFrame) -> DataFrame:
    return cells.select("sample").distinct().withColumn("weight", F.lit(1.0))


def effective_size(weights: DataFrame) -> DataFrame:
    return weights.agg(F.round(F.sum("weight"), 6).alias("effective_size"))
