"""Column expressions and the driver-side scalar rules of the threshold estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlace.config import GAP, STATES


def symbol_state(symbol: Column) -> Column:
    """State code of a one-character symbol of either case; all but A, C, G and T is the gap."""
    up = F.upper(symbol)
    out = F.when(up == "A", STATES["A"])
    for letter in "CGT":
        out = out.when(up == letter, STATES[letter])
    return out.otherwise(GAP).cast("tinyint")


def xlogx(x: Column) -> Column:
    """x ln x, and 0 where x is not positive."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def linear_distance(a: Column, b: Column) -> Column:
    return F.abs(a.cast("long") - b.cast("long"))


def circular_distance(a: Column, b: Column, genome_size: int | Column) -> Column:
    """The shorter way round a circle of ``genome_size`` positions."""
    d = linear_distance(a, b)
    g = genome_size if isinstance(genome_size, Column) else F.lit(int(genome_size))
    return F.least(d, g - d)


def genome_distance(a: Column, b: Column, topology: str, genome_size: int | None) -> Column:
    if topology == "linear" or genome_size is None:
        return linear_distance(a, b)
    return circular_distance(a, b, genome_size)


def gap_effect(mi: Column, mi_wo_gaps: Column) -> Column:
    """Percentage of the MI that vanishes without gaps; 0 where there is no MI."""
    return F.when(mi == 0, F.lit(0.0)).otherwise((1 - mi_wo_gaps / mi) * 100)


def pair_hash(i: Column, j: Column, iteration: Column) -> Column:
    """A number below 2147483647 from plain integer arithmetic, the same on any engine. Squares break up the
    lattice that a linear rule alone would leave between neighbouring inputs."""
    m = F.lit(2147483647)
    h = (i.cast("long") * 73856093 + j.cast("long") * 19349663 + iteration.cast("long") * 83492791 + 17) % m
    for add in (48271, 69621):
        h = (h * h + add) % m
    return h


def pair_count(n_loci: int) -> int:
    return n_loci * (n_loci - 1) // 2


def pairs_to_save(n_loci: int, mi_values: int = 0) -> int:
    return mi_values or min(10_000_000, 100 * n_loci)


def sample_pair_count(n_loci: int, keep: int, asked: int = 0) -> int:
    """Pairs drawn in an iteration: from 100,000 in steps of 10,000 until 100 of them are expected above the
    threshold, 500,000 at most, and never more than a tenth of all pairs."""
    total = pair_count(n_loci)
    n = asked
    if not n:
        n = 100_000
        while n < 500_000 and n * keep < 100 * total:
            n += 10_000
    return min(n, total // 10)


def percentile_index(n_loci: int, keep: int, drawn: int) -> int:
    """Index of the threshold among ``drawn`` ascending values; integer arithmetic throughout."""
    total = pair_count(n_loci)
    return (total - keep) * drawn // total


def lower_median_index(n: int) -> int:
    return (n - 1) // 2
