"""Distances between samples as text and as rows, in order, by stripes and by tiles, against loops."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlace.operators import packed as pk
from pairlace.operators import weights as we
from pairlace.sources import writers


def ragged(spark, n=700):
    """Samples of many widths of number, some below 0, that lack loci, share none or have cells twice; and their distances."""
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(-50, 20_000, n))
    x = rng.integers(0, 5, (len(ids), 6))
    here = (rng.random(x.shape) < 0.8) & ((np.arange(6) < 3) == (np.arange(len(ids)) % 5 > 0)[:, None])
    rows = [(int(ids[s]), int(p), int(x[s, p])) for s, p in zip(*np.nonzero(here), strict=True)]
    rows += rows[:: len(rows) // 9]
    by, want = {}, {}
    for s, p, v in rows:
        by.setdefault(s, []).append((p, v))
    for s in by:
        for t in by:
            met = [u != v for p, u in by[s] for q, v in by[t] if p == q]
            if met:
                want[s, t] = len(met), sum(met)
    return spark.createDataFrame(rows, "sample long, pos int, state byte"), want


@pytest.fixture(scope="module")
def some(spark):
    return ragged(spark)


@pytest.fixture(params=["stripes", "small blocks", "tiles", "slices"])
def way(request, monkeypatch):
    if request.param == "small blocks":
        monkeypatch.setattr(we, "BLOCK", 16)
        monkeypatch.setattr(we, "STRETCH", 40)
        monkeypatch.setattr(we, "HELD_BYTES", 1 << 13)
    elif request.param == "tiles":
        monkeypatch.setattr(we, "TILE_BYTES", 0)
        monkeypatch.setattr(we, "STRETCH", 300)
    elif request.param == "slices":
        monkeypatch.setattr(pk, "SLICE_SAMPLES", 2)
    return request.param


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_in_order(spark, some, way, compression, tmp_path):
    """The files, one after another, have the pairs in order; where one task can hold all samples, no text is sent or sorted."""
    cells, want = some
    distances = we.hamming_strips(cells)
    assert distances.ordered() == (way in ("stripes", "small blocks"))
    to = writers.write_distances(distances, str(tmp_path / "d"), compression)
    files = sorted(f for f in (tmp_path / "d").iterdir() if f.name.startswith("part-"))
    assert all(f.name.endswith(".gz") == (compression == "gzip") for f in files)
    lines = [r.value for f in files for r in spark.read.text(str(f)).coalesce(1).collect()]
    assert lines == [f"{s} {t} {want[s, t][1]}" for s, t in sorted(want) if s < t]
    assert spark.read.text(to).count() == len(lines)
    if distances.ordered():
        plan = writers.distance_lines(distances)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange|Sort|Aggregate", plan[: plan.index("MapInArrow")])


def test_square_form(some, way):
    """A line a sample, made at once where one task can hold all samples: no stretches of lines are sent."""
    cells, want = some
    distances = we.hamming_strips(cells, square=True)
    lines, ids = writers.distance_matrix_lines(distances), sorted({s for s, _ in want})
    got = [tuple(r) for r in lines.select("sample", "value").collect()]
    assert len(got) == len(ids) and dict(got) == {s: " ".join(str(want[s, t][1]) for t in ids if (s, t) in want) for s in ids}
    if distances.ordered():
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange|Sort|Aggregate", plan[: plan.index("MapInArrow")])


def test_rows_come_in_squares(spark):
    """However wide a tile is, a sample's run of rows is short, so few values of both samples stand together."""
    n = 3200
    cells = spark.range(n).select(F.col("id").alias("sample"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).withColumn("state", F.pmod(F.xxhash64("sample", "pos"), F.lit(5)).cast("byte"))

    def runs(batches):
        for b in batches:
            s = b.column("s").to_numpy()
            if len(s):
                cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
                yield pa.RecordBatch.from_arrays([pa.array([len(s)]), pa.array([np.diff(cut).max()])], names=["n", "most"])

    with_runs = we.hamming_distances(cells).mapInArrow(runs, "n long, most long").agg(F.sum("n"), F.max("most")).first()
    assert tuple(with_runs) == (n * (n - 1) // 2, we.BLOCK)


def test_one_sample_and_none(spark, tmp_path):
    one = spark.createDataFrame([(5, 1, 0), (5, 2, 3)], "sample long, pos int, state byte")
    for k, cells in enumerate((one, one.where("false"))):
        assert spark.read.text(writers.write_distances(we.hamming_strips(cells), str(tmp_path / str(k)))).count() == 0


def test_pieces(monkeypatch):
    """Loci and lines in pieces give what they give at once."""
    rng = np.random.default_rng(5)
    x, y = (rng.integers(-1, 5, (n, 200)).astype(np.int8) for n in (9, 30))
    shared = (x[:, None] >= 0) & (y[None] >= 0)
    monkeypatch.setattr(we, "HOT_CELLS", 1)
    n, same = we._alike(x, y)
    assert (n == shared.sum(-1)).all() and (same == (shared & (x[:, None] == y[None])).sum(-1)).all()
    s, t = np.arange(95, 104), np.arange(85, 115)
    n[:, ::4] = 0
    text = lambda: "\n".join(v for b in writers._pair_lines(s, t, n, n - same) for v in b.column("value").to_pylist())
    want = [f"{a} {b} {int(n[i, j] - same[i, j])}" for i, a in enumerate(s) for j, b in enumerate(t) if n[i, j] and a < b]
    assert text().split("\n") == want
    monkeypatch.setattr(writers, "LINES", 7)
    monkeypatch.setattr(writers, "TEXT_BYTES", 100)
    assert text().split("\n") == want
