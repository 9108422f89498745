"""The engine's functions for SQL callers: ``register(spark)`` makes them known by name.

``linear_distance(a, b)``, ``circular_distance(a, b, length)`` and ``gap_effect(mi, without)`` are SQL functions, which Catalyst puts
in place. ``pair_mi(a, b, w)`` is an aggregate: the mutual information of two columns of states with weights, in Arrow batches; a group
is one pair of loci. ``sample_pairs(loci, iteration, drawn)`` is a table function: the pairs of an iteration of the threshold estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pairlace.config import N_STATES
from pairlace.operators.kernels import entropies

ALPHA = 0.5
PRIME, FACTORS, ADDED = 2147483647, (73856093, 19349663, 83492791), (48271, 69621)  # as in ``scalars.pair_hash``


@pandas_udf(DoubleType())
def pair_mi(a: pd.Series, b: pd.Series, w: pd.Series) -> float:
    counts = np.zeros((N_STATES, N_STATES))
    np.add.at(counts, (a.to_numpy(np.int64), b.to_numpy(np.int64)), w.to_numpy(float))
    here = np.zeros_like(counts, dtype=bool)
    here[np.ix_(a.unique(), b.unique())] = True
    return float(entropies(counts, here, ALPHA))


def pair_hashes(draw: np.ndarray, side: int, iteration: int) -> np.ndarray:
    h = (draw * FACTORS[0] + side * FACTORS[1] + iteration * FACTORS[2] + 17) % PRIME
    for add in ADDED:
        h = (h * h + add) % PRIME
    return h


@udtf(returnType=StructType([StructField("u", LongType()), StructField("v", LongType())]))
class SamplePairs:
    """Indices of the first ``drawn`` distinct pairs u < v of an iteration's draws; at most a tenth of all pairs is ever asked."""

    def eval(self, loci: int, iteration: int, drawn: int) -> Iterator[tuple[int, int]]:
        draw = np.arange(1, 2 * drawn + 101, dtype=np.int64)
        u, v = (pair_hashes(draw, side, iteration) % loci for side in (1, 2))
        pair = (np.minimum(u, v) * loci + np.maximum(u, v))[u != v]
        _, first = np.unique(pair, return_index=True)
        for p in pair[np.sort(first)[:drawn]].tolist():
            yield p // loci, p % loci


def register(spark: SparkSession) -> None:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION linear_distance(a BIGINT, b BIGINT) RETURNS BIGINT RETURN abs(a - b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION circular_distance(a BIGINT, b BIGINT, length BIGINT) RETURNS BIGINT RETURN least(abs(a - b), length - abs(a - b))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gap_effect(mi DOUBLE, without DOUBLE) RETURNS DOUBLE RETURN CASE WHEN mi = 0 THEN 0D ELSE (1 - without / mi) * 100 END")
    spark.udf.register("pair_mi", pair_mi)
    spark.udtf.register("sample_pairs", SamplePairs)
