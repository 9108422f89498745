"""Mixtures: targets against plain water filling, balance of the cube method, whole copies."""

import re

import numpy as np
import pytest
from data import SPACE, awkward, empty

from pairlace.llm import mixing as mx


def targets(sizes: dict, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    full, left = set(), float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= over
        left -= sum(most * sizes[s] for s in over)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_balance(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "none"]
    docs = [(k, " ".join(["w"] * int(rng.integers(0, 60))), names[int(rng.choice(5, p=[0.4, 0.3, 0.2, 0.05, 0.05]))]) for k in range(3000)]
    docs += [(5000, "w w w", "tiny"), (5001, "", "none"), (5002, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mx.mixture(df).collect()
    assert len(got) == len(docs)
    size = {i: len([x for x in re.split(SPACE, t or "") if x]) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want = targets(total)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.copies <= 3
        taken[s] = taken.get(s, 0) + r.copies * r.size
    assert abs(sum(want.values()) - sum(total.values())) < 1e-6
    for s in want:
        assert abs(taken[s] - want[s]) <= 60
    rate = {s: want[s] / total[s] if total[s] else 0 for s in want}
    for s in ("a", "b", "Z"):  # documents are balanced with the words
        ids = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.copies for r in ids) - rate[s] * len(ids)) <= 3
    again = mx.mixture(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
    out = mx.flight(p.copy(), size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-4 and abs((out * size).sum() - (p * size).sum()) < 1e-2
    low = mx.land(out, size)
    assert set(low) <= {0.0, 1.0}


def test_inclusion_follows_probability():
    """Over many draws a row is picked as often as its probability says."""
    p, size = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([5.0, 9, 2, 7, 4, 6])
    mean = np.mean([mx.land(mx.flight(p.copy(), size, np.random.default_rng(s)), size) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.12  # the landing moves two rows at most


@pytest.mark.parametrize("seed", range(4))
def test_settling_is_near_the_best_subset(seed):
    """Sizes over four orders of magnitude: tokens are within a thousandth and rows within a few; small sets are solved."""
    rng = np.random.default_rng(seed)
    for n, most in ((80, 20_000), (600, 20_000), (2000, 3000)):
        size = np.sort(np.round(np.exp(rng.normal(5, 1.2, n))).clip(1, most))[::-1].astype(float)
        p = np.full(n, 0.37)
        out = mx.settle(p, size, rng)
        assert set(out) <= {0.0, 1.0} and abs(out @ size - p @ size) <= 1e-3 * (p @ size) and abs(out.sum() - p.sum()) <= 0.02 * n + 4
    size = np.sort(rng.integers(1, 1000, 12))[::-1].astype(float)
    p = rng.random(12)
    best = min(abs(sum(s for k, s in enumerate(size) if code >> k & 1) - p @ size) for code in range(1 << 12))
    assert abs(mx.settle(p, size, rng) @ size - p @ size) - best <= 1  # words within half a word tie, and documents decide


@pytest.mark.parametrize("n", [30, 50, 120, 500, 2000])
def test_heavy_tails_land_on_reachable_targets(n):
    """One document holds a third of the words: the sample is within a word or a thousandth of the target."""
    rng = np.random.default_rng(n)
    size = np.round(np.exp(rng.normal(5, 1, n - 1))).clip(1)
    size = np.sort(np.r_[size, round(size.sum() / 2)])[::-1]
    p = np.full(n, 0.613)
    out = mx.settle(p, size, rng)
    assert set(out) <= {0.0, 1.0} and abs(out @ size - p @ size) <= max(1.0, 1e-3 * (p @ size))


def test_one_very_large_document(spark):
    """A document with most of its source's words is in or out; the others come as near as they can."""
    docs = [(k, " ".join(["w"] * n), s) for s in "ab" for k, n in enumerate([40_000, *[37 * k % 190 + 1 for k in range(60)], 100 * (s == "b")])]
    got = mx.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        whole = int(target / own[0].source_size + 1e-9)
        want = target - whole * own[0].source_size  # what rows taken once more should hold
        small = sum(r.size for r in own) - 40_000
        best = min(max(0, want - n - small, n - want) for n in (0, 40_000))
        assert abs(sum(r.size * r.copies for r in own) - target) <= best + 1


def test_levels_of_blocks(spark):
    rows = [(k, 1, "s", 1 + k % 37, 0.37) for k in range(900)]
    got = mx.choose(spark.createDataFrame(rows, "doc_id long, dup int, source string, size long, p double"), block=50)
    one = {r.doc_id for r in got.where("picked = 1").collect()}
    assert got.count() == 900 and abs(sum(1 + k % 37 for k in one) - 0.37 * sum(r[3] for r in rows)) < 38


def test_documents_are_taken_as_often_as_planned(spark):
    docs, n = awkward(spark)
    plan = mx.mixture(docs)
    assert plan.count() == n
    out = mx.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in plan.collect())
    assert {r._id for r in out.collect()} == {"x"}  # a column of the caller's that bears a name used here
    assert mx.mixture(empty(spark)).count() == 0 and mx.mix_documents(empty(spark)).count() == 0
