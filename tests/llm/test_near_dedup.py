"""Near-dedup against all pairs of full sets, and the sketch's estimate."""

import re

import numpy as np
import pytest
from data import SPACE, awkward, empty, near_copies
from pyspark.sql import functions as F

from pairlace.llm import near_dedup as nd


def shingles(text, width):
    w = [x for x in re.split(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(docs, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("width,seed", [(2, 1), (2, 2), (5, 3)])
def test_against_all_pairs(spark, width, seed):
    rng = np.random.default_rng(seed)
    texts = near_copies(rng, 240) + ["", None, " \t", "one", "ONE", "one two", "One  two\n"]
    common = " ".join(f"common{k}" for k in range(12))  # a passage that many share
    texts += [f"{common} " + " ".join(f"y{int(v)}" for v in rng.integers(0, 50, int(rng.integers(0, 9)))) for _ in range(40)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(5000)[: len(texts)], texts, strict=True)]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()
    want = brute(docs, width)
    assert len({c for _, _, c in want}) < len(docs) - 30
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_prefix_join_alone_finds_all(spark):
    """Without any band in common, links between components still come from the prefix join."""
    rng = np.random.default_rng(7)
    docs = list(enumerate(near_copies(rng, 120)))
    df = spark.createDataFrame(docs, "node long, text string")
    open_ = df.select("node", F.col("node").alias("component"))
    pairs = {(r.x, r.y) for r in nd._prefix_pairs(open_, df, 2, 0.8).collect()}
    sets = [shingles(t, 2) for _, t in docs]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if (b := len(sets[i] & sets[j])) and 100 * b >= 80 * (len(sets[i]) + len(sets[j]) - b)}
    assert want and want <= pairs


@pytest.mark.parametrize("jaccard", [0.2, 0.5, 0.8, 0.95])
def test_estimate(jaccard):
    rng = np.random.default_rng(9)
    err = []
    for _ in range(40):
        n = 1500
        both = round(2 * n * jaccard / (1 + jaccard))
        u = rng.integers(1, 2**63, 2 * n - both, dtype=np.uint64)
        x, y = u[:n], np.concatenate([u[:both], u[n:]])
        err.append(float(nd.estimate(*(nd.sketches([np.unique(s)], 10) for s in (x, y)))[0]) - jaccard)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.05


def test_one_id_with_several_texts(spark):
    """Each text of an id has its own links; rows that repeat wholly change nothing."""
    rng = np.random.default_rng(4)
    a, z = (" ".join(f"{c}{int(v)}" for v in rng.integers(0, 9999, 40)) for c in "az")
    docs = [(5, a), (5, z), (9, a + " more"), (11, z + " more"), (5, a), (9, a + " more"), (3, "something else altogether"), (12, z + " More\n")]
    got = sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (5, 5), (9, 5), (9, 5), (11, 5), (12, 5)]
    kept = sorted((r.doc_id, r.text) for r in nd.keep_one(spark.createDataFrame([*docs, (2, a)], "doc_id long, text string")).collect())
    assert kept == [(2, a), (3, docs[6][1]), (5, z)]


def test_repeated_ids_against_all_pairs(spark):
    """Every id carries two texts: a component joins what either text reaches."""
    rng = np.random.default_rng(12)
    docs = [(k // 2, t) for k, t in enumerate(near_copies(rng, 120))]
    want = {}
    sets = [shingles(t, 2) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, b in enumerate(sets):
        for i in range(j):
            both = len(sets[i] & b)
            if both and 100 * both >= 80 * (len(sets[i]) + len(b) - both):
                up[root(j)] = root(i)
    for k, (i, _) in enumerate(docs):
        want.setdefault(root(k), []).append(i)
    expected = sorted((i, len(sets[k]), min(want[root(k)])) for k, (i, _) in enumerate(docs))
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    assert nd.near_duplicates(docs).count() == n
    kept = nd.keep_one(docs)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and ids.count(None) == 2 and 9 not in ids and 2 in ids and 3 in ids
    assert nd.near_duplicates(empty(spark)).count() == 0 and nd.keep_one(empty(spark)).count() == 0
