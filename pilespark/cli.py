"""Command line: per-base counts of a BAM (or SAM) file at the sites of a BED file."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import sites as S
from .plans.pileup import lines, pileup
from .schema import CONTIG, PileupConfig
from .sources import bam, bed, sam
from .sources.tables import sources

#: Not a contig: a source asked for it alone gives no rows.
NOWHERE = "*"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pilespark", description=__doc__)
    p.add_argument("-f", "--reference-fasta", required=True)
    p.add_argument("-l", "--site-list", required=True)
    p.add_argument("-q", "--min-mapping-quality", type=int, default=0)
    p.add_argument("-b", "--min-base-quality", type=int, default=0)
    p.add_argument("-d", "--max-count", type=int, default=PileupConfig.max_depth)
    p.add_argument("-w", "--max-warnings", type=int, default=1, help="accepted and ignored")
    p.add_argument("-t", "--threads", type=int, default=1, help="local cores, where no cluster is set")
    p.add_argument("--bgzf-threads", type=int, default=2, help="accepted and ignored")
    p.add_argument("-o", "--output", help="a file; standard output if absent")
    p.add_argument("--duplicates", choices=["distinct", "last"], default="distinct")
    p.add_argument("bam")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.master(f"local[{a.threads}]").appName("pilespark").getOrCreate()
    sources(spark)
    sites = bed.read_sites(spark, a.site_list)
    if a.bam.endswith(".sam"):
        text = sam.read_lines(spark, a.bam)
        reads, names = sam.reads(text), sam.contigs(text)
    else:
        source = spark.read.format("bam")
        names = spark.createDataFrame(bam.contigs(a.bam), CONTIG)
        if any(os.path.exists(x) for x in (a.bam + ".bai", a.bam.removesuffix(".bam") + ".bai")):
            # A row for each chunk of 200 sites: with an index only their stretches are read.
            wanted = S.extents(S.chunks(S.known(sites, names))).where("last > 0").collect()
            source = source.option("regions", ",".join(f"{r['chrom']}:{max(0, r['first'] - 1)}-{r['last']}" for r in wanted) or f"{NOWHERE}:0-1")
        reads = source.load(a.bam)
    config = PileupConfig(a.min_mapping_quality, a.min_base_quality, a.max_count, a.duplicates)
    used = [r["chrom"] for r in S.known(sites, names).select("chrom").distinct().collect()]  # contigs with sites
    tiles = spark.read.format("fasta").option("contigs", ",".join(used) or NOWHERE).load(a.reference_fasta)
    wide = pileup(reads, sites, names, tiles, config)
    out = open(a.output, "w") if a.output else sys.stdout
    try:
        for row in lines(wide).toLocalIterator():
            out.write(row["value"] + "\n")
    finally:
        if a.output:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
