"""Times the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlace.operators.lineage import shared_copy
from pairlace.operators.mi import block_mi
from pairlace.operators.threshold import estimate_threshold
from pairlace.operators.weights import sample_weights
from pairlace.plans.queries import QUERIES

HEADLINE = ["mi_all_pairs", "mi_block", "mi_lines", "mi_weighted", "mi_threshold", "sample_weights", "aracne_edges", "outliers", "couplings", "analysis"]
LOCI, SAMPLES = 2000, 1000


def wide(spark):
    """An alignment of 2,000 loci, about two million pairs, by a rule: what the packed kernel is for."""
    rows = spark.range(SAMPLES).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(LOCI - 1))).alias("pos"))
    return rows.select("sample", "pos", F.pmod(F.xxhash64("sample", F.floor(F.col("pos") / 3), F.pmod(F.xxhash64("pos"), F.lit(3))), F.lit(5)).cast("tinyint").alias("state"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))  # one machine: local mode
    QUERIES["alignment_statistics"](spark, sf).collect()  # warm-up
    timed = {name: (lambda name=name: QUERIES[name](spark, sf)) for name in HEADLINE}
    cells = shared_copy(wide(spark))
    timed["wide_block_mi"] = lambda: block_mi(cells, threshold=0.02)
    timed["wide_threshold"] = lambda: estimate_threshold(cells, None, 20_000)
    timed["wide_sample_weights"] = lambda: sample_weights(cells, 0.9)
    took = {}
    for name, make in timed.items():
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
