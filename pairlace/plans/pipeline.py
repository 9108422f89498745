"""The whole analysis, in the order whose effects can be seen in the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairlace.config import CouplingConfig
from pairlace.functions.scalars import gap_effect, genome_distance, pairs_to_save
from pairlace.operators import alignment as al
from pairlace.operators import aracne as ar
from pairlace.operators import mi as m
from pairlace.operators import outliers as ou
from pairlace.operators import threshold as th
from pairlace.operators import weights as we
from pairlace.operators.lineage import counted_copy, shared_copy
from pairlace.operators.packed import Gathered, gather, pack


@dataclass(frozen=True)
class Network:
    couplings: DataFrame
    outliers: DataFrame
    thresholds: DataFrame
    outlier_alignment: DataFrame
    weights: DataFrame
    save_threshold: float | None
    counts: dict[str, int]


def analyse(
    cells: DataFrame | Gathered, config: CouplingConfig = CouplingConfig(), include: DataFrame | None = None, exclude: DataFrame | None = None,
    samples: DataFrame | None = None, weights: DataFrame | None = None,
) -> Network:
    """Include, exclude, filter, sample subset, weights, threshold, all pairs, fences, pruning, listings. The filter
    sees all samples unweighted; weights see the filtered loci only. The genome's length is that of the alignment as given,
    before any list, and needed on a circle only; gathered cells are not laid out again where nothing is left out; listings are shifted by the output base. ``counts`` are taken in passing: loci, samples, cells and gaps that
    are analysed, edges saved, and those of them where a gap is."""
    given = cells if isinstance(cells, Gathered) else None
    c = cells if given is None else given.cells()
    circular, genome = config.topology == "circular", config.genome_size
    whole = include is None and exclude is None and samples is None and not config.filter_alignment
    if circular and not genome and not whole:
        genome = (c.agg(F.max("pos")).first()[0] or 0) + 1
    if include is not None:
        c = al.include_loci(c, include)
    if exclude is not None:
        c = al.exclude_loci(c, exclude)
    if config.filter_alignment:
        c = al.filter_positions(c, maf=config.maf_threshold, gap=config.gap_threshold, denominator=config.maf_denominator, n_states=config.n_states, gap_state=config.gap_state)
    if samples is not None:
        c = al.subsample(c, samples)
    gap = -1 if config.gap_state is None else config.gap_state
    if whole and given is not None:
        held, counts = given, given.counts(gap)
    else:
        seen = Observation()
        held = gather(c.observe(seen, F.count("*").alias("cells"), F.count(F.when(F.col("state") == gap, 1)).alias("gaps"), F.max("pos").alias("last")))
        c, counts = held.cells(), dict(seen.get)
    last = counts.pop("last")
    if circular and not genome:
        genome = (last or 0) + 1
    if weights is None and config.sample_reweighting:
        weights = we.sample_weights(c, config.reweighting_threshold)
    if weights is not None:
        weights = shared_copy(weights)
    packed = pack(held, weights, config.block_loci)
    if weights is None:
        weights = we.unit_weights(packed.samples())
    n_loci, tau = packed.n_loci, config.mi_threshold
    if (tau is None or tau < 0) and not config.exact_threshold:
        keep = pairs_to_save(n_loci, config.mi_values)
        tau = th.estimate_threshold(packed, None, keep, config.pseudocount, config.threshold_iterations, config.threshold_pairs, config.mi_digits, config.block_loci, config.n_states).first()[0]
    circle = genome if circular else None
    how = {"alpha": config.pseudocount, "ld": config.ld_threshold, "genome_size": circle, "n_states": config.n_states, "gap_state": config.gap_state, "digits": config.mi_digits, "gap_mode": config.gap_mode}
    if config.exact_threshold:
        both, tau = th.exact_scan(packed, pairs_to_save(n_loci, config.mi_values), **how)
    else:
        both = shared_copy(m.block_mi(packed, threshold=tau, **how))
    edges, saved = counted_copy(both.where("kind = 'edge'").drop("kind"), edges=F.count("*"), with_gaps=F.count("mi_wo_gaps"))
    edges = edges.withColumn("distance", genome_distance(F.col("i"), F.col("j"), config.topology, genome))
    maxima = both.where("kind = 'max'").groupBy(F.col("i").alias("pos")).agg(F.max("mi").alias("mi"))
    fences = ou.outlier_thresholds(maxima)
    edges = ar.aracne(edges, config.aracne_tolerance) if config.run_aracne else edges.withColumn("direct", F.lit(False))
    edges = edges.withColumn("mi_wo_gaps", F.coalesce("mi_wo_gaps", "mi"))
    edges = edges.withColumn("gap_effect", gap_effect(F.col("mi"), F.col("mi_wo_gaps")))
    out = config.output_base
    shown = lambda df: df.withColumns({"pos1": F.col("i") + out, "pos2": F.col("j") + out})
    nodes = ou.outlier_nodes(edges, fences)
    return Network(
        shown(edges).select("pos1", "pos2", "distance", "direct", "mi"),
        shown(ou.outliers(edges, fences, config.ld_threshold)).select("pos1", "pos2", "distance", "direct", "mi", "mi_wo_gaps", "gap_effect", "extreme"),
        fences, ou.outlier_alignment(c, nodes), weights, tau, {"loci": n_loci, "samples": packed.n_samples, **counts, **saved},
    )
