"""Exon-intron graphs and the paths through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators import intervals as I


def exon_nodes(introns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Exons between intron ends (or the start) and later intron starts (or the end) that hold no whole intron.

    `introns` has (target_id, start, end), `lengths` (target_id, length).
    """
    left = introns.select("target_id", F.col("end").alias("start")).unionByName(lengths.select("target_id", F.lit(0).cast("long").alias("start"))).distinct()
    right = introns.select("target_id", F.col("start").alias("end")).unionByName(lengths.select("target_id", F.col("length").alias("end"))).distinct()
    spans = left.join(right, "target_id").where("start < end")
    inner = introns.select("target_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    return spans.join(inner, (spans["target_id"] == inner["target_id"]) & (inner["i_start"] >= spans["start"]) & (inner["i_end"] <= spans["end"]), "left_anti")


def edges(exons: DataFrame, introns: DataFrame) -> DataFrame:
    """Exon to exon by an intron that starts where the one ends and ends where the other starts."""
    a = exons.select("target_id", F.col("start").alias("from_start"), F.col("end").alias("i_start"))
    b = exons.select("target_id", F.col("start").alias("i_end"), F.col("end").alias("to_end"))
    i = introns.select("target_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    return a.join(i, ["target_id", "i_start"]).join(b, ["target_id", "i_end"]).select("target_id", "from_start", "i_start", "i_end", "to_end")


def paths_right(starts: DataFrame, exons: DataFrame, introns: DataFrame) -> DataFrame:
    """All region paths that cover exactly `length` bases from `pos` on: (id, path as text, ends by `end`).

    `starts` has (id, target_id, pos, length). A path walks exon, intron, exon; the last exon is clipped, and a path that
    runs out of exons before it is long enough is dropped. The plain stretch without introns is always a path.
    """
    reach = F.least(F.col("end") - F.col("pos"), F.col("length"))
    step = starts.join(exons, "target_id").where("start <= pos and pos < end")
    walk = step.select("id", "target_id", F.concat_ws("-", "pos", F.col("pos") + reach).alias("path"), "end", (F.col("length") - reach).alias("left"))
    links = edges(exons, introns).select("target_id", F.col("i_start").alias("end"), "i_end", "to_end").distinct()
    done = walk.where("left = 0").select("id", "path")
    while True:  # every step uses up bases, so the walks end
        walk = walk.where("left > 0").join(links, ["target_id", "end"])
        take = F.least(F.col("to_end") - F.col("i_end"), F.col("left"))
        walk = walk.select("id", "target_id", F.concat_ws(",", "path", F.concat_ws("-", "i_end", F.col("i_end") + take)).alias("path"), F.col("to_end").alias("end"), (F.col("left") - take).alias("left"))
        if walk.isEmpty():
            break
        done = done.unionByName(walk.where("left = 0").select("id", "path"))
    plain = starts.select("id", F.concat_ws("-", "pos", F.col("pos") + F.col("length")).alias("path"))
    return done.unionByName(plain).distinct()


def high_coverage(runs: DataFrame, keys: list[str], rise: int, rise8: int) -> DataFrame:
    """Places where depth rises by more than `rise` to the next base and by more than `rise8` within eight."""
    w = I.W.partitionBy(*keys).orderBy("pos")
    return runs.withColumn("d1", F.lead("depth", 1).over(w) - F.col("depth")).withColumn("d8", F.lead("depth", 8).over(w) - F.col("depth")).where((F.col("d1") > rise) & (F.col("d8") > rise8))
