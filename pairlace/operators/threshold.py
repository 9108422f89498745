"""The MI above which pairs are saved: estimated from repeated samples of pairs, or exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlace.config import N_STATES
from pairlace.functions.scalars import lower_median_index, pair_hash, percentile_index, sample_pair_count
from pairlace.operators.lineage import shared_copy
from pairlace.operators.mi import all_pairs_kept, block_mi, listed_mi
from pairlace.operators.packed import Packed, locus_ranks, pack
from pairlace.operators.selection import values_at


def sampled_pairs(loci: DataFrame, iterations: int, drawn: int) -> DataFrame:
    """``iter, i, j``: for each iteration the first ``drawn`` distinct pairs i < j of a sequence of draws. Draw d
    takes two indices from an arithmetic hash of d and the iteration, so any engine gives the same pairs, and the
    work follows the draws, not the number of pairs. Twice as many draws as needed are made: at most a tenth of
    all pairs is wanted, so these suffice."""
    ranked = loci if "rank" in loci.columns else shared_copy(locus_ranks(loci))
    ranked = ranked.select(F.col("rank").alias("k"), "pos")
    n = ranked.count()
    spark = loci.sparkSession
    draws = spark.range(1, 2 * drawn + 101).select(F.col("id").alias("d"), F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iter"))
    draws = draws.select("iter", "d", (pair_hash(F.col("d"), F.lit(1), F.col("iter")) % n).alias("u"), (pair_hash(F.col("d"), F.lit(2), F.col("iter")) % n).alias("v"))
    pairs = draws.where("u <> v").groupBy("iter", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("d").alias("d"))
    w = Window.partitionBy("iter").orderBy("d")
    first = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= drawn)
    named = first.join(ranked.select(F.col("k").alias("u"), F.col("pos").alias("i")), "u").join(ranked.select(F.col("k").alias("v"), F.col("pos").alias("j")), "v")
    return named.select("iter", "i", "j")


def nth_value(values: DataFrame, column: str, index: int, by: str | None = None) -> DataFrame:
    """The value at ``index`` (from 0) in ascending order, for each ``by``; never interpolated."""
    if by is None:
        return values.sparkSession.createDataFrame([(values_at(values, column, [index])[0],)], f"{column} double")
    w = Window.partitionBy(by).orderBy(column)
    return values.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == index + 1).select(by, column)


def estimate_threshold(cells: DataFrame | Packed, weights: DataFrame | None, keep: int, alpha: float = 0.5, iterations: int = 10, drawn: int = 0, digits: int | None = None, block: int = 128, n_states: int = N_STATES) -> DataFrame:
    """One row, ``threshold``: the lower median over iterations of each sample's percentile. Null means all pairs
    are kept. Only the sampled pairs are evaluated, on packed loci; those are rows of a bounded number."""
    packed = cells if isinstance(cells, Packed) else pack(cells, weights, block)
    n, spark = packed.n_loci, packed.ranks.sparkSession
    if all_pairs_kept(n, keep):
        return spark.range(1).select(F.lit(None).cast("double").alias("threshold"))
    m = sample_pair_count(n, keep, drawn)
    drawn_pairs = shared_copy(sampled_pairs(packed.ranks, iterations, m))
    found = listed_mi(packed, drawn_pairs.select("i", "j"), None, alpha, block, n_states)
    if digits is not None:
        found = found.withColumn("mi", F.round("mi", digits))
    by_iter = nth_value(drawn_pairs.join(shared_copy(found), ["i", "j"]), "mi", percentile_index(n, keep, m), "iter")
    return nth_value(by_iter.select("mi"), "mi", lower_median_index(iterations)).select(F.col("mi").alias("threshold"))


def exact_threshold(edges: DataFrame, keep: int) -> DataFrame:
    """One row, ``threshold``: the MI of the strongest pair that is not among the first ``keep``; null if all are."""
    mi = shared_copy(edges.select("mi"))
    tau = values_at(mi, "mi", [mi.count() - keep - 1])[0]
    return edges.sparkSession.createDataFrame([(tau,)], "threshold double")


def exact_scan(packed: Packed, keep: int, waves: int = 4, **options) -> tuple[DataFrame, float | None]:
    """What ``block_mi`` gives, with the edges above the exact threshold of ``keep`` edges alone, and that threshold. Tiles
    are scanned in waves; a tile tells its ``keep + 1`` strongest edges at most, and those of later waves only what beats the
    bound that all waves before have set. So at most tiles times ``keep + 1`` edges are ever written."""
    if not packed.n_loci:
        return shared_copy(block_mi(packed, **options)), None
    tau, parts = None, None
    for wave in range(waves):
        own = F.pmod(F.col("ti") * 7 + F.col("tj"), F.lit(waves)) == wave
        found = shared_copy(block_mi(packed, threshold=tau, top=keep + 1, tiles=own, **options))
        parts = found if parts is None else parts.unionByName(found)
        edges = parts.where("kind = 'edge'").select("mi")
        tau = values_at(edges, "mi", [edges.count() - keep - 1])[0]
    return parts.where((F.col("kind") != "edge") | (F.col("mi") > (-1.0 if tau is None else tau))), tau


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("mi"), "i", "j").limit(k)


def saved_edges(edges: DataFrame, threshold: float | None) -> DataFrame:
    """Strictly above the threshold; all of them where it is None."""
    return edges if threshold is None else edges.where(F.col("mi") > threshold)
