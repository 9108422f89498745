"""Operators on the long form of an alignment: ``cells(sample, pos, state)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlace.config import GAP


class RaggedAlignmentError(ValueError):
    """Samples or loci that should have as many cells as each other don't."""


def include_loci(cells: DataFrame, loci: DataFrame) -> DataFrame:
    return cells.join(loci.select("pos").distinct(), "pos", "left_semi").select(cells.columns)


def exclude_loci(cells: DataFrame, loci: DataFrame) -> DataFrame:
    return cells.join(loci.select("pos").distinct(), "pos", "left_anti").select(cells.columns)


def subsample(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return cells.join(samples.select("sample").distinct(), "sample", "left_semi").select(cells.columns)


def translate_loci(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replaces the column index by the genome position: ``mapping(idx, pos)``."""
    return cells.withColumnRenamed("pos", "idx").join(mapping.select("idx", "pos"), "idx").select("sample", "pos", "state")


def loci_index(cells: DataFrame, base: int = 0) -> DataFrame:
    """``idx, pos``: the dense rank of each position kept, counted from ``base``. The window runs over distinct loci."""
    from pyspark.sql import Window

    return cells.select("pos").distinct().select((F.row_number().over(Window.orderBy("pos")) - 1 + base).alias("idx"), "pos")


def state_frequencies(cells: DataFrame) -> DataFrame:
    """``pos, state, n, freq``; unweighted. The map-side sums leave one row for each state of a locus."""
    counts = cells.groupBy("pos", "state").agg(F.count("*").alias("n"))
    totals = counts.groupBy("pos").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "pos").select("pos", "state", "n", (F.col("n") / F.col("_t")).alias("freq"))


def state_presence(cells: DataFrame, gap_state: int | None = GAP) -> DataFrame:
    """``pos, mask, mask_wo_gaps``: bit s is set where state s occurs."""
    bit = F.expr("shiftleft(1, cast(state as int))")
    wo = bit if gap_state is None else F.when(F.col("state") != gap_state, bit).otherwise(0)
    return cells.groupBy("pos").agg(F.bit_or(bit).alias("mask"), F.bit_or(wo).alias("mask_wo_gaps"))


def gap_presence(cells: DataFrame, gap_state: int = GAP) -> DataFrame:
    return cells.groupBy("pos").agg(F.max((F.col("state") == gap_state).cast("int")).alias("has_gap"))


def locus_profile(cells: DataFrame, n_states: int = 5, gap_state: int | None = GAP) -> DataFrame:
    """``pos, n, n_gap, alleles, second``: the counts that the position filter needs, in one aggregate."""
    real = [s for s in range(n_states) if s != gap_state]
    one = lambda s: F.sum((F.col("state") == s).cast("long"))
    gaps = F.lit(0).cast("long") if gap_state is None else one(gap_state)
    out = cells.groupBy("pos").agg(F.count("*").alias("n"), gaps.alias("n_gap"), F.array(*[one(s) for s in real]).alias("_c"))
    ranked = F.sort_array("_c", asc=False)
    return out.select("pos", "n", "n_gap", F.size(F.filter("_c", lambda x: x > 0)).alias("alleles"), F.get(ranked, F.lit(1)).alias("second"))


def passes_filter(maf: float, gap: float, denominator: str = "all") -> Column:
    """On a locus profile: more than one allele, the second not too rare, gaps not too frequent."""
    base = F.col("n") if denominator == "all" else F.col("n") - F.col("n_gap")
    return (F.col("alleles") > 1) & (F.col("second") >= F.lit(float(maf)) * base) & (F.col("n_gap") <= F.lit(float(gap)) * F.col("n"))


def position_filter(cells: DataFrame, maf: float = 0.01, gap: float = 0.15, denominator: str = "all", n_states: int = 5, gap_state: int | None = GAP) -> DataFrame:
    """The loci kept, with their counts; empty if none passes."""
    return locus_profile(cells, n_states, gap_state).where(passes_filter(maf, gap, denominator))


def filter_positions(cells: DataFrame, **filters) -> DataFrame:
    return include_loci(cells, position_filter(cells, **filters))


def alignment_statistics(cells: DataFrame, gap_state: int = GAP) -> DataFrame:
    """One row: loci, samples, cells, gap share, and loci with one to five states."""
    loci = cells.groupBy("pos").agg(F.count("*").alias("n"), F.sum((F.col("state") == gap_state).cast("long")).alias("g"), F.countDistinct("state").alias("k"))
    samples = cells.select("sample").distinct().agg(F.count("*").alias("n_samples"))
    by_k = [F.sum((F.col("k") == k).cast("long")).alias(f"loci_{k}_states") for k in range(1, 6)]
    return loci.agg(F.count("*").alias("n_loci"), F.sum("n").alias("n_cells"), F.round(F.sum("g") / F.sum("n"), 6).alias("gap_share"), *by_k).crossJoin(samples)
