"""Components, ranks and the words of texts."""

import re

import numpy as np
import pytest
from data import SPACE
from pyspark.sql import functions as F

from pairlace.llm import common


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1100)] + [(0, 5000 + k) for k in range(200)] + [(None, 3), (9, 9)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    got = common.gapless_rank(df, ["k"], [F.col("id")], F.col("id") % 7).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


def test_words():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab é\t\n 漢"), int(rng.integers(0, 20)))) for _ in range(300)] + ["", "a", " "]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = common.words_of(data, offs)
    seen = {}
    for k, t in enumerate(texts):
        want = [w for w in re.split(SPACE, t) if w]
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)] == want
    for h, a, b in zip(common.word_hashes(data, starts, ends).tolist(), starts, ends, strict=True):
        assert seen.setdefault(h, bytes(data[a:b])) == bytes(data[a:b])
