"""The packed plans: gap modes, bounds, slices, exact scans, similarity by parts, triangles by colours, selection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlace.config import CouplingConfig
from pairlace.operators import aracne as ar
from pairlace.operators import kernels as kn
from pairlace.operators import mi as m
from pairlace.operators import packed as pk
from pairlace.operators import selection as sel
from pairlace.operators import threshold as th
from pairlace.operators import weights as we
from pairlace.operators.alignment import RaggedAlignmentError
from pairlace.plans.pipeline import analyse
from pairlace.sources import readers, writers


def cells_of(spark, x):
    rows = [(int(s), int(p) + 1, int(v)) for (s, p), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "sample long, pos int, state byte")


def alignment(rng, samples, loci, rare=0.2):
    """Loci that vary together in threes, some nearly constant, with gaps."""
    base = rng.integers(0, 4, (samples, -(-loci // 3)))
    x = np.repeat(base, 3, axis=1)[:, :loci]
    noise = rng.random(x.shape)
    x = np.where(noise < 0.15, rng.integers(0, 5, x.shape), x)
    quiet = rng.random(loci) < rare
    x[:, quiet] = np.where(rng.random((samples, int(quiet.sum()))) < 0.05, 1, 0)
    return x.astype(np.int8)


def plain_literal(x, y, w, alpha, gap):
    """Two passes over one table, as loops: rows are the second locus's states."""
    t = [[sum(wk for a, b, wk in zip(x, y, w) if (a, b) == (i, j)) for i in range(5)] for j in range(5)]
    has_x, has_y = set(x.tolist()), set(y.tolist())
    for ix, iy in ((has_x, has_y), (has_x - {gap}, has_y - {gap})):
        for j in iy:
            for i in ix:
                t[j][i] += alpha
        norm = sum(t[j][i] for j in iy for i in ix)
        for j in iy:
            t[j] = [v / norm for v in t[j]]
    e = lambda v: v * math.log(v) if v > 0 else 0.0
    return sum(e(t[j][i]) for j in iy for i in ix) - sum(e(sum(t[j])) for j in iy) - sum(e(sum(t[j][i] for j in iy)) for i in ix)


def test_literal_gap_mode(spark):
    """All plans follow the loops; clean mode differs."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, (40, 5)).astype(np.int8)
    x[:, 4] = rng.integers(0, 3, 40)
    c = cells_of(spark, x)
    w = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rng.random(40))], "sample long, weight double")
    wv = np.array([r.weight for r in w.orderBy("sample").collect()])
    want = {(i + 1, j + 1): plain_literal(x[:, i], x[:, j], wv, 0.5, 4) for i in range(5) for j in range(i + 1, 5)}
    edges = m.mi_pairs(c, w)
    for got in (m.mi_without_gaps(c, edges, w, gap_mode="literal"), m.block_mi(c, w, block=2, gap_mode="literal").where("kind = 'edge'")):
        found = {(r.i, r.j): r.mi_wo_gaps for r in got.collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-9) for k in want)
    clean = {(r.i, r.j): r.mi_wo_gaps for r in m.mi_without_gaps(c, edges, w).collect()}
    assert all(abs(clean[k] - want[k]) > 1e-4 for k in want)
    with pytest.raises(ValueError):
        CouplingConfig(gap_mode="other")


@pytest.mark.parametrize("weighted", [False, True])
def test_bounds_change_nothing(spark, weighted):
    """With a threshold, pairs that entropies rule out are skipped: edges and maxima stay."""
    rng = np.random.default_rng(3)
    x = alignment(rng, 300, 40, rare=0.6)
    c = cells_of(spark, x)
    w = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rng.random(300))], "sample long, weight double") if weighted else None
    every = {(r.i, r.j): r.mi for r in m.mi_pairs(c, w).collect()}
    rows = m.block_mi(pk.pack(c, w, 4), threshold=0.2, ld=2).collect()
    got = {(r.i, r.j): r.mi for r in rows if r.kind == "edge"}
    want = {k: v for k, v in every.items() if v > 0.2}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    top = {}
    for (i, j), v in every.items():
        if j - i > 2:
            top[i], top[j] = max(v, top.get(i, 0)), max(v, top.get(j, 0))
    best = {}
    for r in rows:
        if r.kind == "max":
            best[r.i] = max(r.mi, best.get(r.i, 0))
    assert best.keys() == top.keys() and all(math.isclose(best[k], top[k], abs_tol=1e-9) for k in top)
    alone = m.block_mi(pk.pack(c, w, 4), threshold=0.2, maxima=False).collect()
    assert {(r.i, r.j) for r in alone if r.kind == "edge"} == want.keys() and not any(r.kind == "max" for r in alone)
    assert sum(r.i for r in alone if r.kind == "skipped") > 100


def test_a_bound_holds_for_any_partner():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 60)
        x, y = rng.integers(0, rng.integers(1, 6), (1, n)).astype(np.int8), rng.integers(0, rng.integers(1, 6), (1, n)).astype(np.int8)
        hx, hy = kn.presence(x, 5), kn.presence(y, 5)
        counts = kn.block_counts(x, y, None, 5)
        mi = kn.entropies(counts, hx[:, None, :, None] & hy[None, :, None, :], 0.5)[0, 0]
        assert mi <= kn.marginal_bound(np.stack([(x == s).sum(1) for s in range(5)]), hx, 0.5, 5)[0] + 1e-12


@pytest.mark.parametrize("keep", [1, 17, 60, 10_000])
def test_exact_scan(spark, monkeypatch, keep):
    rng = np.random.default_rng(5)
    c = cells_of(spark, alignment(rng, 60, 24))
    packed = pk.pack(c, None, 4)
    edges = m.block_mi(packed, digits=6).where("kind = 'edge'").select("i", "j", "mi")
    tau = th.exact_threshold(edges, keep).first()[0]
    found, got = th.exact_scan(packed, keep, digits=6)
    want = {(r.i, r.j, r.mi) for r in th.saved_edges(edges, tau).collect()}
    assert got == tau and {(r.i, r.j, r.mi) for r in found.where("kind = 'edge'").collect()} == want and len(want) <= keep or tau is None
    each = m.block_mi(packed, digits=6, top=3).where("kind = 'edge'").count()
    assert each <= 3 * (pk.side_of(packed) and 21)


def test_tiles_come_in_order_of_slices(spark, monkeypatch):
    monkeypatch.setattr(pk, "TILE_BYTES", 160)
    c = cells_of(spark, alignment(np.random.default_rng(2), 64, 10))
    p = pk.pack(c, None, 4)
    assert p.slices > 3 and max(len(r.data) for r in p.loci.collect()) < 40
    plan = m.block_mi(p)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and plan.count("HashAggregate") == 0  # no counts of pairs are shuffled


def test_unequal_records_raise(spark, tmp_path):
    for k, text in enumerate((">a\nACG\n>b\nACGTA\n>c\nACGT\n>d\nACGT\n", ">a\nAC\n>b\nACG\n")):
        (tmp_path / f"f{k}").write_text(text)
        with pytest.raises(RaggedAlignmentError, match="'a' has"):
            readers.read_fasta(spark, str(tmp_path / f"f{k}"))
    cells = readers.cells_of(readers.read_sequences(spark, str(tmp_path / "f0")))
    with pytest.raises(RaggedAlignmentError):
        we.similar_counts(cells, 0.9)
    with pytest.raises(RaggedAlignmentError):
        m.block_mi(cells)
    moved = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 3, 1)], "sample long, pos int, state byte")
    with pytest.raises(RaggedAlignmentError):
        we.similar_counts(moved, 0.9)
    with pytest.raises(RaggedAlignmentError):
        m.block_mi(moved)


def plain_similar(x, identity):
    same = (x[:, None] == x[None]).sum(-1)
    return {k: int(n) for k, n in enumerate((same >= identity * x.shape[1] - 1e-6).sum(1))}


@pytest.mark.parametrize("identity", [0.0, 0.5, 0.85, 0.95, 1.0])
def test_similarity_by_parts(spark, monkeypatch, identity):
    """Families of near samples and many equal ones; units of a few rows, so that groups are cut."""
    rng = np.random.default_rng(int(identity * 100))
    x = np.repeat(rng.integers(0, 5, (8, 40)), 6, axis=0)
    x = np.where(rng.random(x.shape) < 0.06, rng.integers(0, 5, x.shape), x)
    x = np.r_[x, np.repeat(x[:1], 30, axis=0)].astype(np.int8)
    c = cells_of(spark, x)
    monkeypatch.setattr(we, "UNIT", 3)
    want = plain_similar(x, identity)
    for plan in ("parts", "tiles", "auto"):
        assert {r["sample"]: r.n for r in we.similar_counts(c, identity, plan).collect()} == want


def test_fewer_rows_meet_as_identity_grows(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, bytes(bytearray(rng.integers(48, 52, 60).tolist()))) for k in range(120)], "id long, data binary")
    met = [we.part_groups(rows, 60 - we.need_equal(t, 60) + 1).agg(F.sum("n")).first()[0] or 0 for t in (0.5, 0.8, 0.9, 0.97)]
    assert met == sorted(met, reverse=True) and met[0] > 20 * (met[-1] + 1)


@pytest.mark.parametrize("colours", [1, 2, 5, None])
def test_triangles_by_colours(spark, colours):
    rng = np.random.default_rng(4)
    e = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(220)} | {(0, k) for k in range(1, 40)}
    df = spark.createDataFrame([(a, b, float(k % 7)) for k, (a, b) in enumerate(sorted(e))], "i long, j long, mi double")
    rows = lambda t: sorted(tuple(r) for r in t.select("a", "b", "c", "m_ab", "m_ac", "m_bc").collect())
    got = rows(ar.triangles(df, colours))
    assert got == rows(ar.triangles_by_joins(df)) and len(got) == len({r[:3] for r in got}) > 100
    assert ar.triangles(df.where("mi < 0"), colours).count() == 0


def test_triangles_of_a_large_network_with_a_hub(spark):
    """100,000 edges, one vertex with a fifth of them: fewer rows are shuffled than wedges would be."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(1, 4000, 95_000), rng.integers(1, 4000, 95_000)
    e = np.unique(np.r_[np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], np.stack([np.zeros(3999, int), np.arange(1, 4000)], 1)], axis=0)
    df = spark.createDataFrame([(int(i), int(j), float((i * 7 + j) % 100)) for i, j in e], "i long, j long, mi double").cache()
    near = [set() for _ in range(4000)]
    for i, j in e.tolist():
        near[i].add(j)
        near[j].add(i)
    assert ar.triangles(df, 4).count() == sum(len(near[i] & near[j]) for i, j in e.tolist()) // 3
    degree = np.bincount(e.ravel())
    assert ar._colour_groups(df, 4).count() == 4 * len(e) < (degree * (degree - 1) // 2).sum()


@pytest.mark.parametrize("kind", ["plain", "ties", "near", "one"])
def test_selection(spark, kind):
    rng = np.random.default_rng(2)
    v = {"plain": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000).astype(float), "near": 1 + rng.integers(0, 4, 800) * 2.0**-52, "one": np.ones(50)}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "mi double").cache()
    places = [0, 1, len(v) // 3, len(v) // 2, len(v) - 1]
    assert sel.values_at(df, "mi", places, bins=8, small=20) == np.sort(v)[places].tolist()
    assert sel.values_at(df, "mi", [len(v), -1], bins=8, small=20) == [None, None] and sel.values_at(df.where("mi > 99"), "mi", [0]) == [None]


def test_exact_threshold_in_the_analysis(spark):
    c = cells_of(spark, alignment(np.random.default_rng(6), 80, 20, rare=0.0))
    net = analyse(c, CouplingConfig(exact_threshold=True, mi_values=15, output_base=0, filter_alignment=False, run_aracne=False))
    assert 0 < net.couplings.count() <= 15 and net.couplings.where(F.col("mi") <= net.save_threshold).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_parts_in_any_order_give_the_whole(spark, order):
    rng = np.random.default_rng(9)
    e = sorted({tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(160)})
    df = spark.createDataFrame([(a, b, round(float(rng.random()), 2), k % 4) for k, (a, b) in enumerate(e)], "i long, j long, mi double, part int").cache()
    flags = lambda t: {(r.i, r.j): r.direct for r in t.collect()}
    want = flags(ar.aracne(df.drop("part")))
    net = ar.aracne(df.where(F.col("part") == order[0]).drop("part"))
    for k in order[1:]:
        net = ar.extend_network(net, df.where(F.col("part") == k).drop("part"))
    again = ar.extend_network(net, df.drop("part").limit(40))  # known edges change nothing
    assert flags(net) == want == flags(again) and not all(want.values())


@pytest.mark.parametrize("sliced", [False, True])
def test_distances_of_samples(spark, monkeypatch, sliced):
    """Samples that lack loci, share none, or have cells twice, against a join; no row a locus and pair is sent."""
    if sliced:
        monkeypatch.setattr(pk, "SLICE_SAMPLES", 3)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 5, (30, 9))
    rows = [(s, p, int(x[s, p])) for s in range(30) for p in range(9) if rng.random() < 0.7 and (p < 4) == (s < 15) or s % 7 == 0]
    c = spark.createDataFrame(rows + rows[::13] + [(3, 1, 2)], "sample long, pos int, state byte")
    want = {}
    for s, p, v in (cells := [tuple(r) for r in c.collect()]):
        for t, q, u in cells:
            if p == q:
                n, d = want.get((s, t), (0, 0))
                want[s, t] = n + 1, d + (u != v)
    got = we.hamming_distances(c)
    assert {(r.s, r.t): (r.n_loci, r.distance) for r in got.collect()} == {k: v for k, v in want.items() if k[0] < k[1]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    lines = {r.sample: r.value for r in writers.distance_matrix_lines(we.hamming_strips(c, square=True)).collect()}
    assert lines == {s: " ".join(str(want[s, t][1]) for t in range(30) if (s, t) in want) for s in {k[0] for k in want}}
    one = spark.createDataFrame([(5, 1, 0), (5, 2, 3)], "sample long, pos int, state byte")
    assert we.hamming_distances(one).count() == 0 and writers.distance_matrix_lines(we.hamming_strips(one, square=True)).collect()[0].value == "0"
    assert we.hamming_distances(one.where("false")).count() == 0


def test_gathered_cells_come_back(spark, monkeypatch):
    """Scattered, repeated and missing cells; a slice is bounded in samples however few the loci, and no rows of cells are grouped."""
    rng = np.random.default_rng(4)
    rows = [(int(s) * 1000, int(p), int(v)) for s, p, v in zip(rng.integers(0, 400, 900), rng.integers(-3, 5000, 900), rng.integers(0, 5, 900))]
    c = spark.createDataFrame(rows + rows[:20] + [(None, 1, 1), (1, None, 1)], "sample long, pos int, state byte")
    held = pk.gather(c)
    assert sorted(map(tuple, held.cells().collect())) == sorted(rows + rows[:20]) and held.cells().schema == c.schema
    monkeypatch.setattr(pk, "SLICE_SAMPLES", 16)
    x = cells_of(spark, alignment(rng, 200, 5))
    p = pk.pack(x, None, 3)
    assert p.slices == 13 and p.n_samples == 200 and max(len(r.data) for r in p.loci.collect()) < 40
    assert sorted(r.sample for r in p.samples().collect()) == list(range(200))
    got = {(r.i, r.j): round(r.mi, 9) for r in m.block_mi(p, block=3).where("kind = 'edge'").collect()}
    assert got == {(r.i, r.j): round(r.mi, 9) for r in m.mi_pairs(x).collect()}
    with pytest.raises(RaggedAlignmentError, match="more than one"):
        pk.pack(x.unionByName(x.where("pos = 2 and sample = 7")), None, 3)


@pytest.mark.parametrize("mode", ["clean", "literal"])
@pytest.mark.parametrize("sliced", [False, True])
def test_gap_free_mi_of_ragged_cells(spark, monkeypatch, mode, sliced):
    """Samples that lack loci and cells that come twice, against loops over samples; no row a sample and edge is sent."""
    if sliced:
        monkeypatch.setattr(pk, "SLICE_SAMPLES", 9)
    rng = np.random.default_rng(12)
    x = rng.integers(0, 5, (40, 6))
    rows = [(s, p, int(x[s, p])) for s in range(40) for p in range(6) if rng.random() < 0.8 and not (p == 0 and s < 20) and not (p == 5 and s >= 20)]
    c = spark.createDataFrame(rows := rows + rows[::9] + [(21, 1, (int(x[21, 1]) + 1) % 4)], "sample long, pos int, state byte")
    w = {s: float(v) for s, v in enumerate(rng.random(40))}
    weights = spark.createDataFrame(list(w.items()), "sample long, weight double")
    edges = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)], "i int, j int")
    found = m.mi_without_gaps(c, edges, weights, gap_mode=mode)
    got = {(r.i, r.j): r.mi_wo_gaps for r in found.collect()}
    here = np.zeros((5, 6), bool)
    for _, p, v in rows:
        here[v, p] = True
    counts = np.zeros((5, 5, 6, 6))
    for s, p, v in rows:
        for t, q, u in rows:
            if s == t:
                counts[v, u, p, q] += w[s]
    for i in range(6):
        for j in range(i + 1, 6):
            k = counts[:, :, i, j]
            met = (k if mode == "literal" else k[:4, :4]).sum() > 0
            want = float(kn.without_gaps(k, here[:, i][:, None] & here[:, j][None], 0.5, 4, mode)) if met else 0.0
            assert math.isclose(got[i, j], want, abs_tol=1e-9)
    assert got[0, 5] == 0.0 and len(got) == 15 and found.schema["i"].dataType == edges.schema["i"].dataType
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()
    turned = edges.select(F.col("j").alias("i"), F.col("i").alias("j"))
    assert {(r.j, r.i): r.mi_wo_gaps for r in m.mi_without_gaps(c, turned, weights, gap_mode=mode).collect()} == got
