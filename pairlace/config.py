"""Parameters of an analysis, checked when they are made."""

from __future__ import annotations

import sys
from dataclasses import dataclass

# The state codes. Everything but A, C, G and T is the gap state.
STATES = {"A": 0, "C": 1, "G": 2, "T": 3}
GAP = 4
N_STATES = 5


@dataclass(frozen=True)
class CouplingConfig:
    """``mi_threshold``: None or below 0 estimates it, 0 keeps every positive pair. ``mi_values``: 0 takes
    min(10 million, 100 per locus). ``threshold_pairs``: 0 takes the schedule of ``sample_pair_count``. ``mi_digits`` rounds MI
    before it is compared, since sums in another order differ in their last bits. ``gap_mode``: how MI without gaps is taken
    (``kernels.without_gaps``)."""

    mi_threshold: float | None = None
    mi_values: int = 0
    pseudocount: float = 0.5
    threshold_iterations: int = 10
    threshold_pairs: int = 0
    exact_threshold: bool = False
    ld_threshold: int = 0
    run_aracne: bool = True
    aracne_tolerance: float = sys.float_info.epsilon
    maf_threshold: float = 0.01
    gap_threshold: float = 0.15
    maf_denominator: str = "all"
    filter_alignment: bool = True
    reweighting_threshold: float = 0.9
    sample_reweighting: bool = True
    topology: str = "circular"
    genome_size: int | None = None
    output_base: int = 1
    n_states: int = N_STATES
    gap_state: int | None = GAP
    gap_mode: str = "clean"
    block_loci: int = 128
    mi_digits: int | None = 12

    def __post_init__(self) -> None:
        if self.threshold_iterations < 1:
            raise ValueError("threshold_iterations must be at least 1")
        if self.topology not in ("circular", "linear"):
            raise ValueError("topology is 'circular' or 'linear'")
        if self.gap_mode not in ("clean", "literal"):
            raise ValueError("gap_mode is 'clean' or 'literal'")
        if self.maf_denominator not in ("all", "non_gap"):
            raise ValueError("maf_denominator is 'all' or 'non_gap'")
        for name in ("maf_threshold", "gap_threshold", "reweighting_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("pseudocount", "mi_values", "threshold_pairs", "ld_threshold"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.block_loci < 1:
            raise ValueError("block_loci must be at least 1")
