"""Sequences of targets and transcripts, and introns moved to known splice sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions import scalars as S

#: Letters of a piece of a sequence that is joined with the exons in it.
PIECE = 4096
#: Two letters that a known splice site of either strand begins or ends with (fixed values, as in scalars.splice_score).
BEGINNINGS, ENDS = ("GT", "GC", "AT", "CT"), ("AG", "AC", "GC", "AT")


def both_strands(targets: DataFrame) -> DataFrame:
    """Rows (seq_index, sequence) of targets (target_id, sequence): strand 2 i is target i as it stands, 2 i + 1 its
    reverse complement."""
    strands = F.array(F.col("sequence"), S.reverse_complement(F.col("sequence")))
    return targets.select("target_id", F.posexplode(strands).alias("strand", "sequence")).select((2 * F.col("target_id") + F.col("strand")).alias("seq_index"), "sequence")


def transcript_sequences(exons: DataFrame, sequences: DataFrame) -> DataFrame:
    """The joined exons, in start order, of each transcript of exons (transcript, contig, start, end) over sequences
    (contig, sequence). Equal exons count once. What lies beyond a sequence adds nothing.

    Sequences are cut into pieces first, so that no exon carries a whole contig through the join.
    """
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("sequence") / PIECE).cast("int") - 1, F.lit(0)))
    pieces = sequences.select("contig", "sequence", F.explode(cuts).alias("piece")).select("contig", "piece", F.substring("sequence", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("letters"))
    touched = F.sequence(F.expr(f"start div {PIECE}").cast("int"), F.expr(f"greatest(end - 1, start) div {PIECE}").cast("int"))
    parts = exons.select("transcript", "contig", "start", "end", F.explode(touched).alias("piece")).join(pieces, ["contig", "piece"], "left")
    low = F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("piece") * PIECE, F.lit(PIECE)).cast("int")
    part = F.coalesce(F.substring(F.col("letters"), low + 1, F.greatest(high - low, F.lit(0))), F.lit(""))
    ordered = F.array_sort(F.collect_set(F.struct("start", "end", "contig", "piece", part.alias("part"))))
    return parts.groupBy("transcript").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("sequence"))


def has_unknown_splice_sites(scores: Column) -> Column:
    """Whether any gap has a score above 0."""
    return F.exists(scores, lambda s: s > 0)


def uniform_cigar(text: Column) -> Column:
    """A CIGAR string with M for matches and mismatches alike; NA if it is none."""
    return F.when(text.rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$"), S.cigar_string(S.collapse(S.cigar(text)))).otherwise(F.lit("NA"))


def repair_introns(introns: DataFrame, sequences: DataFrame, window: int = 10) -> DataFrame:
    """Introns (target, start, end, splice, forward) of splice 0 moved to the first known splice site, by donor shift and
    then acceptor shift, of those that begin `window` / 2 before the intron's ends; splice is then 2 for a canonical site and
    1 for another. Those without such a site, and all of a better splice, stay."""
    half = window // 2
    donors = F.substring("sequence", F.col("start") - half + 1, F.lit(window + 1))
    acceptors = F.substring("sequence", F.col("end") - half - 1, F.lit(window + 1))
    shifts = F.sequence(F.lit(0), F.lit(window - 1))

    def site(i: Column, j: Column) -> Column:
        score = S.splice_score(F.substring(F.col("donors"), i + 1, F.lit(2)), F.substring(F.col("acceptors"), j + 1, F.lit(2)), F.col("forward"))
        return F.struct((F.col("start") + i - half).alias("start"), (F.col("end") + j - half).alias("end"), (2 - score).alias("splice"))

    first = F.filter(shifts, lambda i: F.substring(F.col("donors"), i + 1, F.lit(2)).isin(*BEGINNINGS))
    last = F.filter(shifts, lambda j: F.substring(F.col("acceptors"), j + 1, F.lit(2)).isin(*ENDS))
    tried = F.flatten(F.transform(first, lambda i: F.transform(last, lambda j: site(i, j))))
    known = F.get(F.filter(tried, lambda s: (s["splice"] > 0) & (s["start"] < s["end"] - 1)), F.lit(0))
    rows = introns.join(sequences, introns["target"] == sequences["contig"], "left").withColumns({"donors": donors, "acceptors": acceptors})
    rows = rows.withColumn("known", F.when(F.col("splice") == 0, known))
    kept = [c for c in introns.columns if c not in ("start", "end", "splice")]
    return rows.select(*kept, *[F.coalesce(F.col("known")[c], F.col(c)).alias(c) for c in ("start", "end", "splice")])
