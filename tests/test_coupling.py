import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlace.config import CouplingConfig
from pairlace.functions import scalars as fn
from pairlace.operators import alignment as al
from pairlace.operators import aracne as ar
from pairlace.operators import kernels as kn
from pairlace.operators import mi as m
from pairlace.operators import outliers as ou
from pairlace.operators import packed as pk
from pairlace.operators import threshold as th
from pairlace.operators import tiles
from pairlace.operators import weights as we
from pairlace.plans.pipeline import analyse
from pairlace.sources import readers, writers

TINY = ">s1\nACGTAC-TAA\n>s2\nACGTA\r\nCGTAA\n>s3\nACTTGC-TAC\n>s4\nacttgcgtac\n>s5\nGCTTGANTCC\n>s6\nGCGTAANTCA\n>s7\nGCGTAAGTCA\n>s8\nGCTTGCGTCC\n"


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fasta") / "tiny.fasta"
    path.write_text(TINY)
    c = readers.read_fasta(spark, str(path)).withColumn("pos", F.col("pos") + 1)
    return c.persist()


def test_reader_and_echo(spark, cells, tmp_path):
    assert cells.count() == 80
    lines = [r.value for r in writers.alignment_lines(cells).orderBy("sample").collect()]
    assert lines[1] == ">1\nACGTACGTAA" and lines[3] == ">3\nACTTGCGTAC" and lines[4].endswith("GCTTGA-TCC")
    (tmp_path / "none").write_text("\n\n")
    with pytest.raises(readers.EmptyAlignmentError):
        readers.read_fasta(spark, str(tmp_path / "none"))


def test_lists(spark, tmp_path):
    (tmp_path / "l").write_text("3 1\n 2\n2")
    assert sorted(r.pos for r in readers.read_loci_list(spark, str(tmp_path / "l"), 1).collect()) == [0, 1, 2]
    w = readers.read_indexed_list(spark, str(tmp_path / "l"), "sample", "weight", expected=4)
    assert [r.weight for r in w.orderBy("sample").collect()] == [3.0, 1.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        readers.read_indexed_list(spark, str(tmp_path / "l"), "sample", "weight", expected=5)


def test_filter_and_weights(cells):
    kept = al.filter_positions(cells)
    assert sorted(r.pos for r in kept.select("pos").distinct().collect()) == [1, 3, 5, 6, 9, 10]
    w = {r["sample"]: r.weight for r in we.sample_weights(kept, 0.9).collect()}
    assert [w[k] for k in range(8)] == [0.5, 0.5, 0.5, 0.5, 1.0, 0.5, 0.5, 1.0]
    assert {r.weight for r in we.sample_weights(kept, 0.8).collect()} == {0.5}


@pytest.mark.parametrize("plan", ["sql", "sparse", "block"])
@pytest.mark.parametrize("theta", [None, 0.8])
def test_mi_plans(cells, plan, theta):
    kept = al.filter_positions(cells)
    w = we.sample_weights(kept, theta) if theta else None
    out = m.block_mi(kept, w, block=3).where("kind = 'edge'") if plan == "block" else m.mi_pairs(kept, w, plan=plan)
    got = {(r.i, r.j): round(r.mi, 6) for r in out.collect()}
    a, b, c = (0.368064, 0.205038, 0.021006) if theta is None else (0.242586, 0.135656, 0.014363)
    assert len(got) == 15
    for pairs, v in (([(1, 9), (3, 5), (3, 10), (5, 10)], a), ([(1, 6), (6, 9)], b), ([(3, 6), (5, 6), (6, 10)], c)):
        assert all(got[p] == v for p in pairs)
    assert sum(v == 0 for v in got.values()) == 6


def test_gap_free_plans_agree(cells):
    edges = m.mi_pairs(cells)
    sql = {(r.i, r.j): r.mi_wo_gaps for r in m.mi_without_gaps(cells, edges).collect()}
    blk = {(r.i, r.j): r.mi_wo_gaps for r in m.block_mi(cells, block=4).where("kind = 'edge' and mi_wo_gaps is not null").collect()}
    assert sql.keys() == blk.keys() and all(math.isclose(sql[k], blk[k], abs_tol=1e-9) for k in sql)


def test_fences(cells):
    kept = al.filter_positions(cells)
    e = m.mi_pairs(kept).withColumn("mi", F.round("mi", 6)).withColumn("distance", fn.circular_distance(F.col("i"), F.col("j"), 10))
    f = ou.outlier_thresholds(ou.column_max(e, 1))
    assert f.first().asDict() == {"q1": 0.368064, "q3": 0.368064, "outlier": 0.368064, "extreme": 0.368064}
    got = ou.outliers(e, f, 1).collect()
    assert {(r.i, r.j) for r in got} == {(1, 9), (3, 5), (3, 10), (5, 10)} and not any(r.extreme for r in got)
    assert ou.outlier_thresholds(ou.column_max(e, 99)).first()["outlier"] is None


EPS = sys.float_info.epsilon
GRAPHS = [
    ([(1, 2, 0.5), (2, 3, 0.4), (1, 3, 0.3)], EPS, {(1, 3)}), ([(1, 2, 0.5), (2, 3, 0.3), (1, 3, 0.3)], EPS, set()),
    ([(1, 2, 0.5), (2, 3, 0.3), (1, 3, 0.3)], 0.0, {(2, 3), (1, 3)}), ([(1, 2, 0.3), (2, 3, 0.3), (1, 3, 0.3)], EPS, set()),
    ([(1, 2, 0.3), (2, 3, 0.3), (1, 3, 0.3)], 0.0, {(1, 2), (2, 3), (1, 3)}),
    ([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (2, 3, 0.6), (2, 4, 0.5), (3, 4, 0.4)], EPS, {(2, 3), (2, 4), (3, 4)}),
    ([(1, 2, 0.5), (2, 3, 0.4)], EPS, set()),
]


@pytest.mark.parametrize("edges,tol,want", GRAPHS)
def test_pruning(spark, edges, tol, want):
    got = ar.aracne(spark.createDataFrame(edges, "i long, j long, mi double"), tol).collect()
    assert {(r.i, r.j) for r in got if not r.direct} == want


def test_pruning_brute_force(spark):
    rng = np.random.default_rng(3)
    e = {}
    while len(e) < 150:
        a, b = sorted(rng.choice(25, 2, replace=False).tolist())
        e[a, b] = round(float(rng.random()), 2)
    bad = set()
    for (a, b), x in e.items():
        for c in range(25):
            if (t := tuple(sorted((a, c)))) in e and (u := tuple(sorted((b, c)))) in e:
                three = sorted([(x, (a, b)), (e[t], t), (e[u], u)])
                if three[1][0] - three[0][0] >= EPS:
                    bad |= {k for v, k in three if v == three[0][0]}
    got = ar.aracne(spark.createDataFrame([(*k, v) for k, v in e.items()], "i long, j long, mi double")).collect()
    assert {(r.i, r.j) for r in got if not r.direct} == bad


@pytest.mark.parametrize("n,k,total,drawn,idx", [(64, 200, 2016, 201, 181), (64, 500, 2016, 201, 151), (300, 30_000, 44_850, 4485, 1485), (1000, 100_000, 499_500, 49_950, 39_950), (50_000, 400_000, 1_249_975_000, 320_000, 319_897), (100_000, 100_000, 4_999_950_000, 500_000, 499_989)])
def test_threshold_scalars(n, k, total, drawn, idx):
    assert fn.pair_count(n) == total and fn.sample_pair_count(n, k) == drawn and fn.percentile_index(n, k, drawn) == idx


def test_threshold_keeps_all_when_few(cells):
    assert th.estimate_threshold(cells, None, 1000).first()[0] is None
    with pytest.raises(ValueError):
        CouplingConfig(threshold_iterations=0)


def test_whole_analysis(spark, cells, tmp_path):
    net = analyse(cells, CouplingConfig(reweighting_threshold=0.8, ld_threshold=1, genome_size=10, output_base=0))
    c = net.couplings.collect()
    assert len(c) == 15 and net.save_threshold is None
    assert net.outliers.count() >= 4
    path = writers.write_lines(writers.couplings_lines(net.couplings), str(tmp_path / "out"))
    again = writers.write_lines(writers.couplings_lines(net.couplings), str(tmp_path / "out"))
    assert again == f"{path}.1" and readers.read_couplings(spark, path).count() == 15
    assert readers.read_edges(spark, path).count() == 15


def test_whole_analysis_of_nothing(spark, cells):
    net = analyse(cells.where("pos = 2"), CouplingConfig())
    assert net.couplings.count() == 0 and net.outliers.count() == 0


def test_blocks_of_far_loci(spark, cells, monkeypatch):
    """Blocks follow the rank of a locus, not its position, and slices of samples add up."""
    far = cells.withColumn("pos", F.col("pos") * 100_000)
    assert pk.pack(far, None, 4).loci.select("blk").distinct().count() == 3
    assert sorted((r.pos, r["rank"]) for r in pk.locus_ranks(far, 50).collect()) == [(k * 100_000, k - 1) for k in range(1, 11)]
    want = {(r.i * 100_000, r.j * 100_000): r.mi for r in m.mi_pairs(cells).collect()}
    got = {(r.i, r.j): r.mi for r in m.block_mi(far, block=4).where("kind = 'edge'").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 5, (4, 20)).astype(np.int8), rng.integers(0, 5, (6, 20)).astype(np.int8), rng.random(20)
    u, v = (k.ravel() for k in np.meshgrid(np.arange(4), np.arange(6), indexing="ij"))
    for weights in (w, None):
        want = np.zeros((5, 5, 4, 6))
        for a, b in zip(*np.nonzero(np.ones((4, 6))), strict=True):
            np.add.at(want[:, :, a, b], (x[a], y[b]), 1.0 if weights is None else weights)
        for size in (3, 100):
            monkeypatch.setattr(kn, "SLICE", size)
            monkeypatch.setattr(kn, "AT_ONCE", 5 * size)
            assert np.allclose(kn.block_counts(x, y, weights, 5), want)
            assert np.allclose(kn.pair_counts(x, y, u, v, weights, 5), want[:, :, u, v])
            for dense in (1, 8, 1000):  # by whole blocks, and pair by pair
                monkeypatch.setattr(kn, "DENSE", dense)
                assert np.allclose(kn.listed_counts(x, y, u[::3], v[::3], weights, 5, 2), want[:, :, u[::3], v[::3]])


@pytest.mark.parametrize("threshold", [None, 0.1])
def test_slices_of_samples_agree(cells, monkeypatch, threshold):
    """No task sees all samples: counts of the slices add up to the same edges, maxima and listed pairs."""
    w = we.sample_weights(cells, 0.8)
    rows = lambda df: {(r.kind, r.i, r.j): (round(r.mi, 9), r.mi_wo_gaps and round(r.mi_wo_gaps, 9)) for r in df.collect()}
    whole = m.block_mi(cells, w, threshold=threshold, block=3, ld=1, genome_size=10)
    top = lambda df: {r.i: round(r.mi, 9) for r in df.where("kind = 'max'").groupBy("i").agg(F.max("mi").alias("mi")).collect()}
    tops = top(whole)
    pairs = m.mi_pairs(cells).select("i", "j")
    one = {(r.i, r.j): round(r.mi, 9) for r in m.listed_mi(cells, pairs, w, block=3).collect()}
    monkeypatch.setattr(pk, "TILE_BYTES", 18)
    assert pk.pack(cells, w, 3).slices == 3
    sliced = m.block_mi(cells, w, threshold=threshold, block=3, ld=1, genome_size=10)
    cut = rows(sliced)
    assert {k: v for k, v in cut.items() if k[0] == "edge"} == {k: v for k, v in rows(whole).items() if k[0] == "edge"}
    assert top(sliced) == tops
    assert {(r.i, r.j): round(r.mi, 9) for r in m.listed_mi(cells, pairs, w, block=3).collect()} == one
    want = {(r.i, r.j): round(r.mi, 9) for r in m.mi_pairs(cells, w).collect()}
    assert one == want


def test_tiles_cover_each_pair_once(spark):
    blocks = spark.range(7).select(F.col("id").cast("int").alias("blk"))
    for side in (1, 2, 3, 9):
        seen = {}
        for r in tiles.deal(blocks, 7, side).collect():
            seen.setdefault((r.ti, r.tj), ([], []))[r["at"]].append(r.blk)
        met = [tuple(sorted((a, b))) for (ti, tj), (x, y) in seen.items() for a in x for b in (x if ti == tj else y) if ti < tj or a <= b]
        assert sorted(met) == [(a, b) for a in range(7) for b in range(a, 7)]


def test_files_are_numbered_in_the_order_of_the_list(spark, tmp_path):
    """Spark reads large files first; samples keep the order of the list all the same, over several splits too."""
    (tmp_path / "a").write_text("".join(f">a{k}\nACGT\n" for k in range(3)))
    (tmp_path / "b").write_text("".join(f">b{k}\nACGTACGT\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.read_sequences(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("sample").collect()
        (tmp_path / "w").write_text("".join(f"{k} {k + 0.5}\n\n" for k in range(600)))
        w = readers.read_indexed_list(spark, str(tmp_path / "w"), "sample", "weight").orderBy("sample").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["sample"], r.name) for r in got] == [(k, n) for k, n in enumerate([f"a{k}" for k in range(3)] + [f"b{k}" for k in range(400)])]
    assert [(r["sample"], r.weight) for r in w] == [(2 * k + h, k + h / 2) for k in range(600) for h in (0, 1)]


def test_genome_length_is_that_of_the_input(spark, cells):
    """Lists of loci don't shorten the circle: positions 0 and 8 of ten are 2 apart, whatever is left out."""
    zero = cells.withColumn("pos", F.col("pos") - 1)
    gone = spark.createDataFrame([(9,)], "pos int")
    net = analyse(zero, CouplingConfig(filter_alignment=False, output_base=0, mi_threshold=0.0), exclude=gone)
    assert {(r.pos1, r.pos2): r.distance for r in net.couplings.collect()}[0, 8] == 2
