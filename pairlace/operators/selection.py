"""Values at given places of an ascending order, without sorting all rows anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, SMALL = 2048, 50_000


def values_at(values: DataFrame, column: str, places: list[int], bins: int = BINS, small: int = SMALL) -> list[float | None]:
    """The values at ``places`` (from 0) in ascending order, never interpolated; None beyond the last. Nulls have no place. Each pass
    counts ``bins`` intervals of those that hold the place and goes on with one of them, between its own least and largest value,
    so a handful of passes over few numbers a task finds it; at most ``small`` rows come to the driver. Rows that tie are told by
    an interval with one value."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    return [_value_at(v, k, n, low, high, bins, small) if 0 <= k < n else None for k in places]


def _value_at(v: DataFrame, place: int, n: int, low: float, high: float, bins: int, small: int) -> float:
    while low < high:
        inside = v.where(F.col("v").between(low, high))
        if n <= small:
            return sorted(r.v for r in inside.collect())[place]
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)) if high - low > 1e-300 else F.when(F.col("v") == low, 0).otherwise(1)
        found = sorted(inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for r in found:
            if place < r.n:
                n, low, high = r.n, r.low, r.high
                break
            place -= r.n
        if len(found) == 1 and low < high:  # values too near each other for intervals: the least goes first
            least = inside.where(F.col("v") == low).count()
            if place < least:
                return low
            place, n = place - least, n - least
            low = inside.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return low
