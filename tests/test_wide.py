"""Alignments gathered from a column a locus, and how often an analysis reads its alignment."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlace.config import CouplingConfig
from pairlace.operators import mi as m
from pairlace.operators import packed as pk
from pairlace.operators import threshold as th
from pairlace.plans.fixtures import from_lineitem, wide_lineitem
from pairlace.plans.pipeline import analyse


def wide_rows(spark, x, ids=None):
    rows = [(int(s) if ids is None else ids[s], *[None if v is None or v < 0 else int(v) for v in line]) for s, line in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "sample long, " + ", ".join(f"`{3 * p + 1}` int" for p in range(x.shape[1])))


def as_cells(rows):
    parts = [rows.select("sample", F.lit(int(c)).alias("pos"), F.col(f"`{c}`").cast("byte").alias("state")) for c in rows.columns if c != "sample"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_wide_rows_are_gathered_as_cells(spark, monkeypatch, chunk):
    """Null states and samples, samples that come again, a locus and a sample without cells, and loci that are derived."""
    monkeypatch.setattr(pk, "CHUNK_CELLS", chunk)
    rng = np.random.default_rng(8)
    x = rng.integers(-1, 5, (60, 7))
    x[:, 3] = -1
    x[9] = -1
    ids = [None if s == 5 else int(s % 40) * 7 - 9 for s in range(60)]
    rows = wide_rows(spark, x, ids)
    held = pk.gather_wide(rows)
    want = sorted(tuple(r) for r in as_cells(rows).dropna().collect())
    assert sorted(map(tuple, held.cells().collect())) == want
    for r in held.chunks.collect():
        who, loci, data = (np.frombuffer(v, k) for v, k in ((r.who, np.int64), (r.loci, np.int64), (r.data, np.uint8)))
        assert len(np.unique(who)) == len(who) == r.n and len(data) == r.n * len(loci) and (np.diff(who) > 0).all()
    assert held.counts(4) == {"cells": len(want), "gaps": sum(v == 4 for _, _, v in want), "last": max(p for _, p, _ in want)}
    twice = pk.gather_wide(rows, lambda batch: {100: batch.column("1")})
    assert sorted(map(tuple, twice.cells().collect())) == sorted(want + [(s, 100, v) for s, p, v in want if p == 1])
    none = pk.gather_wide(rows.where("false"))
    assert none.cells().count() == 0 and none.counts(4) == {"cells": 0, "gaps": 0, "last": None}


@pytest.mark.parametrize("how", [{"filter_alignment": False}, {"filter_alignment": True}, {"filter_alignment": False, "topology": "linear"}])
def test_gathered_cells_are_analysed_as_cells(spark, how):
    rng = np.random.default_rng(14)
    x = np.repeat(rng.integers(0, 5, (80, 4)), 2, axis=1)
    x = np.where(rng.random(x.shape) < 0.3, rng.integers(0, 5, x.shape), x)
    rows = wide_rows(spark, x)
    config = CouplingConfig(ld_threshold=2, mi_threshold=0.0, sample_reweighting=False, output_base=0, mi_digits=9, gap_threshold=0.5, **how)
    a, b = analyse(pk.gather_wide(rows), config), analyse(as_cells(rows), config)
    told = lambda net: [sorted(map(tuple, df.collect())) for df in (net.couplings, net.outliers, net.thresholds)]
    assert told(a) == told(b) and a.counts == b.counts and a.counts["cells"] == x.size and len(told(a)[0]) == 28


@pytest.mark.parametrize("topology", ["linear", "circular"])
def test_an_alignment_is_read_once(spark, topology):
    """The genome's length needs no pass of its own where nothing is left out."""
    x = np.random.default_rng(2).integers(0, 4, (50, 5))
    cells, seen = as_cells(wide_rows(spark, x)).coalesce(1), spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    net = analyse(cells.mapInArrow(pass_on, cells.schema), CouplingConfig(filter_alignment=False, sample_reweighting=False, mi_threshold=0.0, topology=topology, output_base=0))
    assert seen.value == x.size
    far = {(r.pos1, r.pos2): r.distance for r in net.couplings.collect()}
    assert far[1, 13] == (12 if topology == "linear" else 2)


def test_wide_lineitem(spark, tmp_path):
    """The table's 8 loci, and remainders of its keys beside them."""
    rows = [(k // 3, k % 3 + 1, 1000003 * 5 + 77 * k, "ANR"[k % 3], "FO"[k % 2], 0.01 * (k % 11), 0.01 * (k % 9), float(k % 50 + 1)) for k in range(30)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_discount double, l_tax double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {(r.sample, 2 * r.pos, r.state) for r in from_lineitem(spark, str(tmp_path)).collect()}
    for ok, ln, pk_, *_ in rows:
        want |= {(ok * 1000 + ln, 2 * p + 1, (ok * (7919 * (p + 3)) + ln * 104729 + pk_ * 31) % 1000003 % 4) for p in range(32)}
    assert {tuple(r) for r in wide_lineitem(spark, str(tmp_path)).cells().collect()} == want and len(want) == 30 * 40


@pytest.mark.parametrize("gap_mode", ["clean", "literal"])
def test_few_loci_in_many_slices_are_sent_once(spark, monkeypatch, gap_mode):
    """Shares of the slices are counted apart and added up: the same edges and maxima as at once, with weights and waves, and a locus is
    sent to few tiles."""
    rng = np.random.default_rng(6)
    n = 12_000
    x = np.repeat(rng.integers(0, 5, (n, 3)), 2, axis=1)
    x = np.where(rng.random(x.shape) < 0.4, rng.integers(0, 4, x.shape), x)
    rows = spark.createDataFrame([(s, *map(int, line)) for s, line in enumerate(x)], "sample long, " + ", ".join(f"`{p}` int" for p in range(1, 7)))
    held = pk.gather_wide(rows)
    weights = spark.range(n).select(F.col("id").alias("sample"), (1.0 / (1 + F.col("id") % 7)).alias("weight"))
    how = {"gap_mode": gap_mode, "ld": 1}

    def told(df):
        """Edges, and over all tiles each locus's largest MI."""
        out = {}
        for r in df.where("kind <> 'skipped'").collect():
            key, v = (r.kind, r.i, r.j), (round(r.mi, 9), r.mi_wo_gaps and round(r.mi_wo_gaps, 9))
            assert r.kind == "max" or key not in out
            out[key] = max(v, out.get(key, v), key=lambda x: x[0])
        return out

    whole = pk.pack(held, weights, 2)
    assert whole.slices == 1 and pk.shares_of(whole)[1] == 1
    want = told(m.block_mi(whole, **how))
    monkeypatch.setattr(pk, "SLICE_SAMPLES", 1000)
    sliced = pk.pack(held, weights, 2)
    side, shares = pk.shares_of(sliced)
    assert sliced.slices == 12 and shares == 12 and side == 3 > pk.side_of(sliced)
    assert pk.tile_rows(sliced, side=side, shares=shares).where("data is not null").count() == 6 * 12
    got = m.block_mi(sliced, **how)
    assert told(got) == want and sum(k[0] == "edge" for k in want) == 15
    edges, tau = th.exact_scan(sliced, 4, **how)
    best = sorted((v[0] for k, v in want.items() if k[0] == "edge"), reverse=True)
    assert {k: v for k, v in told(edges).items() if k[0] == "edge"} == {k: v for k, v in want.items() if k[0] == "edge" and v[0] > best[4]} and round(tau, 9) == best[4]
    monkeypatch.setattr(pk, "COUNT_BYTES", 8 * 25 * 16)  # several large tiles
    side, shares = pk.shares_of(sliced)
    assert side == 2 and shares > 1 and told(m.block_mi(sliced, **how)) == want
