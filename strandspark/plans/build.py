"""Whole jobs: target extraction, index tables, k-mer counts and mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.config import MapperConfig
from strandspark.operators import introns, kmers
from strandspark.operators.mapping import map_reads
from strandspark.operators.remapping import remap_reads
from strandspark.sources import formats as X

#: Letters of a stored piece of a contig.
PIECE = 1 << 16


def contig_chunks(spark: SparkSession, fasta: str) -> DataFrame:
    """A genome as (contig, base, chunk) pieces; a header's first word names the contig, "chr" stripped."""
    fa = X.read_fasta(spark, fasta).select(F.regexp_replace(F.substring_index("header", " ", 1), "^chr", "").alias("contig"), "seq")
    return kmers.chunks(fa, "contig", "seq", PIECE, 0)


def extract_genes(spark: SparkSession, fasta: str, fai: str, gtf: str, ids: list[str] | None, upstream: int, downstream: int, out: str, single: bool) -> None:
    """Gene sequences, widened and within their contig, as FASTA: one file a gene, or one folder for all."""
    regions = X.gene_regions(X.genes(X.read_gtf(spark, gtf), ids), X.read_fai(spark, fai), upstream, downstream)
    seqs = X.extract(contig_chunks(spark, fasta), regions.select("contig", "start", "end").distinct()).join(regions, ["contig", "start", "end"])
    rows = seqs.select("gene_id", F.concat_ws("\t", "contig", "gene_id", F.when(F.col("strand"), "+").otherwise("-"), "start", "end").alias("header"), "seq")
    if single:
        X.write_fasta(rows, out)
    else:
        line = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), X.S.fasta_lines(F.col("seq")))
        rows.select("gene_id", line.alias("value")).write.partitionBy("gene_id").mode("overwrite").text(out)


def extract_regions(spark: SparkSession, fasta: str, regions: list[str], out: str) -> None:
    """Regions contig:start-end as FASTA."""
    asked = spark.createDataFrame([(r,) for r in regions], "text string").select("text", X.S.region_string(F.col("text")).alias("r"))
    if asked.where("r is null").count():
        raise ValueError("a region is not contig:start-end with 0 <= start < end")
    asked = asked.select(F.regexp_replace("r.contig", "^chr", "").alias("contig"), "r.start", "r.end")
    seqs = X.extract(contig_chunks(spark, fasta), asked)
    X.write_fasta(seqs.select(F.concat_ws("\t", "contig", F.concat_ws("-", "start", "end"), F.lit("+"), "start", "end").alias("header"), "seq"), out)


def build_index(spark: SparkSession, fasta: str, out: str, mask: str | None = None, counts: str | None = None) -> None:
    """Tables targets, kmer_positions, target_kmer_counts and mask_items under `out`."""
    t = X.target_header(X.read_fasta(spark, fasta)).withColumn("target_id", (F.row_number().over(kmers.W.orderBy("ord")) - 1).cast("int"))  # targets are few
    t.select("target_id", "contig", "gene_id", "strand", "start", "end", "seq").write.mode("overwrite").parquet(f"{out}/targets")
    t = spark.read.parquet(f"{out}/targets")
    posted = kmers.kmers(t, "target_id", "seq")
    posted.write.mode("overwrite").parquet(f"{out}/kmer_positions")
    known = X.read_kmer_counts(spark, counts) if counts else spark.createDataFrame([], "kmer string, count long")
    kmers.occurrences(posted, known).select("target_id", "pos", "count").write.mode("overwrite").parquet(f"{out}/target_kmer_counts")
    items = X.mask_items(X.read_mask(spark, mask), t) if mask else spark.createDataFrame([], "seq_index int, start long, end long, name string, priority int, threshold int")
    items.write.mode("overwrite").parquet(f"{out}/mask_items")


def count_genome_kmers(spark: SparkSession, fasta: str, out: str) -> None:
    """k-mer counts of a genome. Pieces overlap by k - 1 letters, so no k-mer is lost or counted twice."""
    fa = X.read_fasta(spark, fasta).select("ord", F.upper("seq").alias("seq"))
    X.write_kmer_counts(kmers.kmer_counts(fa, "ord", "seq"), out)


def map_files(spark: SparkSession, index: str, first: str, second: str | None, config: MapperConfig, out: str) -> DataFrame:
    """Both passes over read files; writes SAM text under `out` and returns the alignments.

    First-pass alignments are written once, since intron inference and the second pass both read them.
    """
    targets = spark.read.parquet(f"{index}/targets")
    mask = spark.read.parquet(f"{index}/mask_items")
    reads = X.read_fastq(spark, first, 1)
    if second:
        reads = reads.unionByName(X.read_fastq(spark, second, 2))
    reads = reads.withColumn("qname", X.S.read_id(F.col("header")))
    map_reads(reads, targets, config, mask).write.mode("overwrite").parquet(f"{out}/first_pass")
    found = spark.read.parquet(f"{out}/first_pass")
    if config.mode == "rna":
        sure = found.join(introns.confident_pairs(found, config).select("read_ord"), "read_ord", "left_semi").where("complete") if second else found.where("complete")
        jumps = introns.cluster_gaps(introns.gap_evidence(introns.gaps_of(sure, targets, config)), config.confident_delta)
        jumps.write.mode("overwrite").parquet(f"{out}/introns")
        found = remap_reads(found, reads, targets, spark.read.parquet(f"{out}/introns"), config, mask)
    sam = introns.to_sam(found, reads, targets, paired=bool(second))
    lines = X.sam_line(sam).select(F.lit(1).alias("part"), "value")
    header = X.sam_header(targets).select(F.lit(0).alias("part"), "value")
    header.unionByName(lines).write.mode("overwrite").partitionBy("part").text(f"{out}/aligned.sam")
    return found
