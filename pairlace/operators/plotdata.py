"""The data behind a Manhattan plot of couplings; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plot_extent(couplings: DataFrame, n_edges: int) -> DataFrame:
    """One row: MI range, largest distance and the axis exponent, over the strongest ``n_edges`` rows."""
    first = couplings.orderBy(F.desc("mi"), "pos1", "pos2").limit(n_edges)
    out = first.agg(F.min("mi").alias("min_mi"), F.max("mi").alias("max_mi"), F.max("distance").alias("max_distance"))
    return out.withColumn("exponent", (F.round(F.log10(F.col("max_distance").cast("double"))) - 1).cast("int"))


def plot_points(couplings: DataFrame) -> DataFrame:
    """All points, indirect ones first as they are drawn: ``distance, mi, direct``."""
    return couplings.select("distance", "mi", F.col("direct").cast("boolean").alias("direct"))
