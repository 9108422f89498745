"""The pipeline's stages on planted cases, each on what its predecessor kept."""

import numpy as np
from data import DOCS, awkward, empty

import corpus_pipeline
from pairlace.llm import queries


def planted(spark, folder):
    rng = np.random.default_rng(1)
    names = [f"term{k}" for k in range(3000)]
    plain = lambda n: " ".join(rng.choice(names, n)) + "."
    item = plain(40)
    docs = [(k, plain(int(rng.integers(30, 120))), "en", ["a", "b", "c"][k % 3], 0) for k in range(300)]
    docs += [(400 + k, docs[k][1], "en", "a", 0) for k in range(20)]
    docs += [(500 + k, docs[30 + k][1] + " tail", "en", "b", 0) for k in range(20)]
    docs += [(600 + k, f"{plain(30)} {item[:120]} {plain(30)}", "en", "c", 0) for k in range(10)]
    docs += [(700 + k, "!!! $$$ click " * int(rng.integers(10, 30)) + f"{k}", "en", "a", 0) for k in range(80)]
    labels = [(k, 1, 0) for k in range(0, 300, 2)] + [(700 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "shards" or out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = set(range(300))
    after = [set(v) for v in seen.values()]
    assert not after[0] & set(range(700, 780)) and len(after[0] & clean) >= 297
    assert not after[1] & (set(range(400, 420)) | set(range(500, 520))) and after[1] >= after[0] & clean
    assert not after[2] & set(range(600, 610)) and after[2] >= after[1] & clean
    ids = seen["mixture"]
    assert set(ids) <= after[2] and max(map(ids.count, set(ids))) <= 3
    assert sorted(seen["shards"]) == sorted(ids)
    per = docs.groupBy("shard").count().collect()
    assert max(r["count"] for r in per) - min(r["count"] for r in per) <= 1


def test_registered():
    assert len(corpus_pipeline.STAGES) == 5 and sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{k}" for k in range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_run_on_awkward_rows(spark, tmp_path):
    """The whole pipeline over nulls, repeated rows and ids, a very long text and clashing columns; and over no rows."""
    docs, n = awkward(spark)
    for name, rows in (("full", docs), ("none", empty(spark))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, "no such passage of the benchmark is in any of these documents at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert 0 < len(out) <= 3 * n and {r.slot for r in out if r.shard == out[0].shard} == set(range(sum(r.shard == out[0].shard for r in out)))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
