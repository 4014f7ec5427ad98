"""Exports of the comparison: read tables, padded read groups, statistics rows and combined alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.operators import intervals as I


def read_groups(records: DataFrame, padding: int = 500) -> DataFrame:
    """Padded and merged places of each read's records, contig by contig; `records` has qname, contig, start, end."""
    wide = records.select("qname", "contig", (F.col("start") - padding).alias("start"), (F.col("end") + padding).alias("end"))
    return I.merge(wide, ["qname", "contig"])


def mapped_by(records: DataFrame, mappers: DataFrame) -> DataFrame:
    """Which mappers mapped each mate, dense: one row a (qname, mate, mapper). Mappers are few."""
    keys = records.select("qname", "mate").distinct().join(F.broadcast(mappers))
    hit = records.select("qname", "mate", "mapper").distinct().withColumn("mapped", F.lit(True))
    return keys.join(hit, ["qname", "mate", "mapper"], "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))


def first_reads(records: DataFrame, order: str) -> DataFrame:
    """First sequence of each read and mate that is not empty, and whether the read has two mates."""
    seq = F.min_by("seq", F.when(F.length("seq") > 0, F.col(order)))
    per = records.groupBy("qname", "mate").agg(seq.alias("seq"))
    return per.withColumn("paired", F.count("mate").over(I.W.partitionBy("qname")) > 1)


def combined(records: DataFrame, state: DataFrame, contig: str, start: int, end: int, hide_accepted: bool = True, hide_discarded: bool = True, only_in_progress: bool = False) -> DataFrame:
    """Records inside the target whose reads the switches let through; `state` has qname, mates and discarded."""
    rows = records.join(state, "qname", "left").withColumn("mates", F.coalesce("mates", F.lit(0))).withColumn("discarded", F.coalesce("discarded", F.lit(False)))
    rows = rows.where((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))
    rows = rows.where("mates < 2") if hide_accepted else rows
    rows = rows.where("not discarded") if hide_discarded else rows
    return rows.where("mates = 1") if only_in_progress else rows


def group_line(records: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a group of alike records: the first one, with the mappers and ordinals of all as tags XM and XI."""
    tags = F.array(F.concat(F.lit("XM:Z:"), F.array_join(F.array_sort(F.collect_set("mapper")), ",")), F.concat(F.lit("XI:Z:"), F.array_join(F.transform(F.array_sort(F.collect_list("ordinal")), lambda x: x.cast("string")), ",")))
    return records.groupBy(*keys).agg(F.min(order).alias("first"), F.array_join(tags, "\t").alias("tags"))


def statistics(alignments: DataFrame) -> DataFrame:
    """One row an alignment for the statistics file; the strand column tells mates truly apart."""
    return alignments.select("qname", "mate", "target_id", (F.col("seq_index") % 2 == 0).cast("int").alias("is_forward"), "pos", "cigar", "mismatches", "anchor", F.size("blocks").alias("regions"), F.col("complete").cast("int").alias("complete"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The table with a running count and its observation: progress without another job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
