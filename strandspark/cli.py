"""Command line: index-pre, index-pre-region, index, kmer-occurrences, map, generate-conf."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from strandspark import config
from strandspark.plans import build


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandspark", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("index-pre", help="extract gene sequences")
    v.add_argument("--gtf", required=True)
    v.add_argument("--fasta", required=True)
    v.add_argument("--fasta-index")
    v.add_argument("--gene-ids")
    v.add_argument("--upstream", type=int, default=0)
    v.add_argument("--downstream", type=int, default=0)
    v.add_argument("--single-file", action="store_true")
    v.add_argument("--output", required=True)
    v = verbs.add_parser("index-pre-region", help="extract regions")
    v.add_argument("--fasta", required=True)
    v.add_argument("--regions", required=True, nargs="+")
    v.add_argument("--output", required=True)
    v = verbs.add_parser("index", help="build the index tables")
    v.add_argument("--fasta", required=True)
    v.add_argument("--mask")
    v.add_argument("--kmer-occurrences")
    v.add_argument("--output", required=True)
    v = verbs.add_parser("kmer-occurrences", help="count k-mers of a genome")
    v.add_argument("--fasta", required=True)
    v.add_argument("--output", required=True)
    v = verbs.add_parser("map", help="map reads")
    v.add_argument("--index", required=True)
    v.add_argument("--first", required=True)
    v.add_argument("--second")
    v.add_argument("--mode", choices=("dna", "rna"), required=True)
    v.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    v.add_argument("--output", required=True)
    v = verbs.add_parser("generate-conf", help="print the settings of a mode")
    v.add_argument("--mode", choices=("dna", "rna"), required=True)
    return top


def settings(mode: str, changes: list[str]) -> config.MapperConfig:
    base = config.DNA if mode == "dna" else config.RNA
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    found = {}
    for change in changes:
        key, _, value = change.partition("=")
        if key not in kinds:
            raise SystemExit(f"unknown setting: {key}")
        found[key] = value.lower() == "true" if kinds[key] is bool else kinds[key](value)
    return replace(base, **found)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.verb == "generate-conf":
        print(settings(a.mode, []).dump(), end="")
        return
    spark = SparkSession.builder.appName("strandspark").getOrCreate()
    if a.verb == "index-pre":
        build.extract_genes(spark, a.fasta, a.fasta_index or f"{a.fasta}.fai", a.gtf, a.gene_ids.split(",") if a.gene_ids else None, a.upstream, a.downstream, a.output, a.single_file)
    elif a.verb == "index-pre-region":
        build.extract_regions(spark, a.fasta, a.regions, a.output)
    elif a.verb == "index":
        build.build_index(spark, a.fasta, a.output, a.mask, a.kmer_occurrences)
    elif a.verb == "kmer-occurrences":
        build.count_genome_kmers(spark, a.fasta, a.output)
    else:
        build.map_files(spark, a.index, a.first, a.second, settings(a.mode, a.set), a.output)


if __name__ == "__main__":
    main()
