"""Outlier thresholds from each locus's strongest far pair, and the outlier listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.operators.lineage import shared_copy
from pairlace.operators.selection import values_at


def column_max(edges: DataFrame, ld: int = 0) -> DataFrame:
    """``pos, mi``: each locus's largest MI over evaluated pairs further apart than ``ld``. Needs ``distance``.
    Loci with no such pair are absent."""
    far = edges.where(F.col("distance") > ld)
    return far.select(F.explode(F.array("i", "j")).alias("pos"), "mi").groupBy("pos").agg(F.max("mi").alias("mi"))


def outlier_thresholds(maxima: DataFrame) -> DataFrame:
    """One row ``q1, q3, outlier, extreme``: quartiles by index and the fences 1.5 and 3 ranges above the third.
    Nulls if no locus is left. The quartiles are found by counting intervals, so no task sorts all loci."""
    maxima = shared_copy(maxima.select("mi"))  # some passes over one number a locus
    quarter = maxima.where("mi is not null").count() // 4
    q1, q3 = values_at(maxima, "mi", [quarter, 3 * quarter])
    row = (None,) * 4 if q1 is None else (q1, q3, q3 + 1.5 * (q3 - q1), q3 + 3 * (q3 - q1))
    return maxima.sparkSession.createDataFrame([row], "q1 double, q3 double, outlier double, extreme double")


def outliers(edges: DataFrame, thresholds: DataFrame, ld: int = 0) -> DataFrame:
    """Edges at or above the outlier threshold and further apart than ``ld``; ``extreme`` is strict."""
    one = thresholds.select(F.col("outlier").alias("_o"), F.col("extreme").alias("_e"))
    met = edges.crossJoin(one).where((F.col("mi") >= F.col("_o")) & (F.col("distance") > ld))
    return met.withColumn("extreme", F.col("mi") > F.col("_e")).drop("_o", "_e")


def outlier_nodes(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``pos`` of both ends of edges at or above the outlier threshold, near ones included."""
    strong = edges.crossJoin(thresholds.select(F.col("outlier").alias("_o"))).where(F.col("mi") >= F.col("_o"))
    return strong.select(F.explode(F.array("i", "j")).alias("pos")).distinct()


def outlier_alignment(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    return cells.join(nodes, "pos", "left_semi").select("sample", "pos", "state")
