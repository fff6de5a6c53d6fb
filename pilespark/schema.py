"""Schemas shared by sources and operators."""

from __future__ import annotations

from dataclasses import dataclass

BASES = ("A", "C", "G", "T", "N")

SITE = "chrom string, pos long, bed_line long, within_line long"
READ = "ord long, qname string, flag int, chrom string, pos0 long, mapq int, cigar string, seq string, qual array<int>, nm long, md string, sm int"
CONTIG = "chrom string, tid int, len long"
TILE = "chrom string, start0 long, seq string"

#: The metrics of one site and base, in output order; True for those printed as whole numbers.
METRICS = {
    "count": True,
    "avg_mapping_quality": False,
    "avg_basequality": False,
    "avg_se_mapping_quality": False,
    "num_plus_strand": True,
    "num_minus_strand": True,
    "avg_pos_as_fraction": False,
    "avg_num_mismatches_as_fraction": False,
    "avg_sum_mismatch_qualities": False,
    "num_q2_containing_reads": True,
    "avg_distance_to_q2_start_in_q2_reads": False,
    "avg_clipped_length": False,
    "avg_distance_to_effective_3p_end": False,
}


@dataclass(frozen=True)
class PileupConfig:
    min_mapq: int = 0
    min_baseq: int = 0
    #: Observations of a site beyond this many, in file order, are left out; at the default no cap is planned.
    max_depth: int = 10_000_000
    #: "distinct": one row for each site. "last": duplicates stay; within a chunk the last one gets the counts.
    duplicates: str = "distinct"
    #: "bins" or "explode", as callers say it: both lay reads over the sites of a bin.
    strategy: str = "bins"
    #: Sums doubles in file order, so that results do not depend on how tasks were scheduled.
    exact: bool = False
