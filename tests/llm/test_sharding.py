"""Shards: sizes, slots, and links cut against hashing."""

import zlib

import numpy as np
import pytest
from data import awkward, empty
from pyspark.sql import functions as F

from pairlace.llm import sharding as sh


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    count = np.bincount([r.shard for r in rows], minlength=shards)
    assert count.max() - count.min() <= 1 and len(count) == shards
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


@pytest.mark.parametrize("hot", [0, 300, 1000])  # a group of as many copies, beyond a shard's quota
def test_law_and_cut(spark, hot):
    rng = np.random.default_rng(hot)
    docs = [(k, f"text {int(rng.integers(300))}" if k % 2 else f"single {k}") for k in range(1000)] + [(2000 + k, "hot") for k in range(hot)] + [(5000, None), (5001, None), (5002, "ä")]
    rows = sh.assign_shards(spark.createDataFrame(docs, "doc_id long, text string"))
    got = rows.collect()
    check(got, docs, sh.SHARDS)
    text = dict(docs)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    cut = sh.cut_edges(rows).first()
    by_hash = sh.cut_edges(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(sh.SHARDS)))).first()
    unavoidable = max(0, hot - -(-len(docs) // sh.SHARDS))
    assert cut.links == by_hash.links and cut.cut - unavoidable <= 0.1 * max(1, by_hash.cut - unavoidable)


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    check(sh.assign_shards(docs).collect(), range(n), sh.SHARDS)
    assert sh.assign_shards(empty(spark)).count() == 0
    same = spark.createDataFrame([(7, "x")] * 100, "doc_id long, text string")
    check(sh.assign_shards(same, shards=3).collect(), range(100), 3)


def test_no_python_in_the_plan(spark):
    docs, _ = awkward(spark)
    plan = sh.assign_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
