"""Confident pairs, intron inference and alignment output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.config import MapperConfig
from strandspark.functions import scalars as S


def best_pairs(first: DataFrame, second: DataFrame, keys: list[str], cost: Column, order: list[Column]) -> DataFrame:
    """The cheapest combination of two mates for each key; of equals the first in order."""
    both = first.join(second, keys).withColumn("cost", cost)
    return both.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy("cost", *order))).where("__rn = 1").drop("__rn")


def confident_pairs(alignments: DataFrame, config: MapperConfig) -> DataFrame:
    """Mates complete on opposite strands of one target, all anchors long, with the fewest mismatches under the limit."""
    good = alignments.where(F.col("complete") & (F.col("anchor") >= config.confident_anchor))
    side = lambda mate, s: good.where(F.col("mate") == mate).select("read_ord", "target_id", *[F.col(c).alias(f"{c}{s}") for c in ("seq_index", "alt", "mismatches", "blocks")])
    both = best_pairs(side(1, 1).join(side(2, 2).select("read_ord", "target_id").distinct(), ["read_ord", "target_id"], "left_semi"), side(2, 2), ["read_ord", "target_id"], F.when(F.abs(F.col("seq_index1") - F.col("seq_index2")) == 1, F.col("mismatches1") + F.col("mismatches2")).otherwise(1 << 20), [F.col("alt1"), F.col("alt2")])
    found = both.where(F.col("cost") < config.confident_mismatches)
    return found.withColumn("__rn", F.row_number().over(W.partitionBy("read_ord").orderBy("target_id"))).where("__rn = 1").drop("__rn")


def gaps_of(alignments: DataFrame, targets: DataFrame, config: MapperConfig) -> DataFrame:
    """Genome gaps of alignments on the plus strand, with 2 less the splice penalty: (target_id, start, end, splice)."""
    size = targets.select("target_id", F.length("seq").cast("long").alias("size"), F.upper("seq").alias("tseq"))
    n = F.size("blocks")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((F.get("blocks", i - 1)["genome_start"] + F.get("blocks", i - 1)["read_end"] - F.get("blocks", i - 1)["read_start"]).alias("s"), F.get("blocks", i)["genome_start"].alias("e"))))
    rows = alignments.select("target_id", "seq_index", F.explode(pairs).alias("g")).join(F.broadcast(size), "target_id")
    rev = F.col("seq_index") % 2 == 1
    start, end = F.when(rev, F.col("size") - F.col("g.e")).otherwise(F.col("g.s")), F.when(rev, F.col("size") - F.col("g.s")).otherwise(F.col("g.e"))
    rows = rows.select("target_id", start.alias("start"), end.alias("end"), "tseq").where(F.col("end") - F.col("start") >= config.intron_length_min)
    donor, acceptor = F.substring(F.col("tseq"), (F.col("start") + 1).cast("int"), F.lit(2)), F.substring(F.col("tseq"), (F.col("end") - 1).cast("int"), F.lit(2))
    fw, rv = S.splice_score(donor, acceptor, F.lit(True)), S.splice_score(donor, acceptor, F.lit(False))
    return rows.select("target_id", "start", "end", (2 - F.least(fw, rv)).alias("splice"), (fw <= rv).alias("plus"))


def gap_evidence(gaps: DataFrame) -> DataFrame:
    """Evidence of each gap: its count times one more than its splice value."""
    return gaps.groupBy("target_id", "start", "end", "splice").agg((F.count(F.lit(1)) * (1 + F.col("splice"))).alias("evidence"), F.count_if("plus").alias("plus"), F.count(F.lit(1)).alias("n"))


def cluster_gaps(evidence: DataFrame, delta: int) -> DataFrame:
    """Introns: gaps by length join the first cluster that they overlap and outgrow by at most `delta` on each side.

    The strongest gap stands for its cluster; clusters of no splice site are dropped. The distinct gaps of a target are
    few, so each target is one group.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(length=rows["end"] - rows["start"]).sort_values(["length", "start", "end", "splice"], kind="stable")
        clusters: list[dict] = []
        for r in rows.to_dict("records"):
            home = next((c for c in clusters if r["start"] < c["hi"] and c["lo"] < r["end"] and 0 <= c["lo"] - r["start"] <= delta and 0 <= r["end"] - c["hi"] <= delta), None)
            if home is None:
                clusters.append({"lo": r["start"], "hi": r["end"], "best": r, "sum": r["evidence"]})
                continue
            home["lo"], home["hi"], home["sum"] = r["start"], r["end"], home["sum"] + r["evidence"]
            if r["evidence"] > home["best"]["evidence"]:
                home["best"] = r
        kept = sorted(({**c["best"], "evidence": c["sum"]} for c in clusters if c["best"]["splice"] > 0), key=lambda r: (r["start"], r["end"]))
        return pd.DataFrame([(r["target_id"], k, r["start"], r["end"], r["evidence"], r["splice"]) for k, r in enumerate(kept)], columns=["target_id", "rank", "start", "end", "evidence", "splice"])

    return evidence.groupBy("target_id").applyInPandas(merge, "target_id int, rank long, start long, end long, evidence long, splice int")


def preferred_strand(gaps: DataFrame) -> DataFrame:
    """Majority strand of each target's gaps and its share; a tie is -1 with 0.5."""
    votes = gaps.where("splice > 0").groupBy("target_id").agg(F.count_if("plus").alias("p"), F.count(F.lit(1)).alias("n"))
    share = F.greatest("p", F.col("n") - F.col("p")) / F.col("n")
    return votes.select("target_id", F.when(2 * F.col("p") == F.col("n"), -1).when(2 * F.col("p") > F.col("n"), 1).otherwise(0).alias("strand"), share.alias("confidence"))


def to_sam(alignments: DataFrame, reads: DataFrame, targets: DataFrame, paired: bool = True) -> DataFrame:
    """Complete alignments as SAM rows, each with its mate marked unmapped (or single end)."""
    base = alignments.where("complete").join(reads.select("read_ord", "mate", "seq", "qual"), ["read_ord", "mate"]).join(F.broadcast(targets.select("target_id", "contig", F.col("start").alias("t_start"))), "target_id")
    rev = F.col("seq_index") % 2 == 1
    flag = F.when(rev, 16).otherwise(0)
    if paired:
        flag = flag + 1 + 8 + F.when(F.col("mate") == 1, 64).otherwise(128)
    letters = F.when(rev, F.reverse(F.translate(F.upper("seq"), "ACGTN", "TGCAN"))).otherwise(F.upper("seq"))
    return base.select(F.col("qname"), flag.alias("flag"), F.col("contig").alias("rname"), (F.col("pos") + F.col("t_start") + 1).cast("int").alias("pos"), F.lit(254).alias("mapq"), "cigar", F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), letters.alias("seq"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), F.array(F.concat(F.lit("XG:i:"), F.col("target_id").cast("string"))).alias("tags"))
