"""Region pairs, target masks, read details and loading of mapper results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.operators.agreement import deduplicate


def contains(r: Column, start: Column, end: Column) -> Column:
    return (r["start"] <= start) & (end <= r["end"])


def left_overlap(r: Column, start: Column, end: Column) -> Column:
    """[start, end) reaches over the left end of the region into it."""
    return (start < r["start"]) & (r["start"] < end) & (end <= r["end"])


def right_overlap(r: Column, start: Column, end: Column) -> Column:
    return (r["start"] <= start) & (start < r["end"]) & (r["end"] < end)


def normalize(read: Column, genome: Column) -> Column:
    """Paired regions of equal lengths: both vectors are merged on their own, then cut wherever either ends.

    struct<read, genome>; the vectors cover equally many bases.
    """
    ends = lambda v: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: F.aggregate(F.slice(v, F.lit(1), i), F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]))

    def cut(v: Column, own: Column, at: Column) -> Column:
        """The regions of the bases at[i - 1] to at[i]."""

        def piece(end: Column, i: Column) -> Column:
            k = F.size(F.filter(own, lambda e: e < end))
            stop = F.get(v, k)["end"] - (F.get(own, k) - end)
            return R.region(stop - (end - F.when(i > 0, F.get(at, i - 1)).otherwise(0)), stop)

        return F.transform(at, piece)

    let = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    both = F.struct(R.merge(read, strict=True).alias("r"), R.merge(genome, strict=True).alias("g"))
    known = lambda m: F.struct(m["r"].alias("r"), m["g"].alias("g"), ends(m["r"]).alias("re"), ends(m["g"]).alias("ge"))
    at = lambda m: F.array_sort(F.array_union(m["re"], m["ge"]))
    return let(both, lambda m: let(known(m), lambda k: let(at(k), lambda a: F.struct(cut(k["r"], k["re"], a).alias("read"), cut(k["g"], k["ge"], a).alias("genome")))))


def insert_apart(v: Column, start: Column, end: Column) -> Column:
    """The regions with [start, end) put in at its place; null if it overlaps any."""
    return F.when(~R.overlaps_any(v, start, end), F.array_sort(F.array_append(v, R.region(start, end))))


def overlapping(v: Column, r: Column) -> Column:
    """The regions of a vector that overlap a region."""
    return F.filter(v, lambda x: (x["start"] < r["end"]) & (r["start"] < x["end"]))


def inside(positions: Column, start: Column, end: Column) -> Column:
    """Positions within [start, end), such as the mismatches of an anchor."""
    return F.filter(positions, lambda p: (p >= start) & (p < end))


def detailed_cigar(ops: Column, read: Column, reference: Column) -> Column:
    """A CIGAR whose matches are told apart into = and X by the read's and the reference's letters.

    Clips and insertions use up the read, deletions and gaps the reference; H and P use up neither.
    """
    uses = lambda o, kinds: F.when(F.lit(kinds).contains(o["op"]), o["len"]).otherwise(0)
    before = lambda i, kinds: F.aggregate(F.slice(ops, F.lit(1), i), F.lit(0), lambda s, o: s + uses(o, kinds))

    def spell(o: Column, i: Column) -> Column:
        a, b = before(i, "MIS=X"), before(i, "MDN=X")
        same = lambda k: F.substring(read, a + k + 1, F.lit(1)) == F.substring(reference, b + k + 1, F.lit(1))
        letters = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(o["len"] - 1, F.lit(0))), lambda k: F.when(same(k), "=").otherwise("X")), "")
        runs = F.transform(F.regexp_extract_all(letters, F.lit("(=+|X+)"), 1), lambda run: F.concat(F.length(run).cast("string"), F.substring(run, 1, 1)))
        return F.when(F.lit("M=X").contains(o["op"]), F.array_join(runs, "")).otherwise(F.concat(o["len"].cast("string"), o["op"]))

    return F.array_join(F.transform(ops, spell), "")


def mask_in_target(repeats: DataFrame, targets: DataFrame) -> DataFrame:
    """Repeats that lie fully in a target, relative to its start (`start`, `end`) and mirrored for its other strand."""
    both = repeats.join(targets.select("contig", "target_id", F.col("start").alias("t0"), F.col("end").alias("t1")), "contig").where("start >= t0 and end <= t1")
    return both.select("target_id", "name", (F.col("start") - F.col("t0")).alias("start"), (F.col("end") - F.col("t0")).alias("end"), (F.col("t1") - F.col("end")).alias("mirrored_start"), (F.col("t1") - F.col("start")).alias("mirrored_end"))


def repeats_from_target(repeats: DataFrame, targets: DataFrame) -> DataFrame:
    """Repeats that begin in a target, wherever they end."""
    return repeats.join(targets.select("contig", "target_id", F.col("start").alias("t0"), F.col("end").alias("t1")), "contig").where("t0 <= start and start < t1").select("target_id", "name", "start", "end")


def multimapping_reads(reads: DataFrame, high: DataFrame) -> DataFrame:
    """Reads with a mismatch that overlap a region of high coverage on their contig."""
    regions = high.select("contig", F.col("start").alias("h0"), F.col("end").alias("h1"))
    return reads.where("mismatches >= 1").join(regions, "contig").where("start < h1 and h0 < end").select("read").distinct()


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter of so many items at a rate of false positives."""
    bits = max(1, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(items, 1) * math.log(2)))


def bloom_bits(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item, from 32-bit parts of MD5 digests."""
    return F.array(*[F.pmod(F.conv(F.substring(F.md5(F.concat(item.cast("string"), F.lit(f"/{i}"))), 1, 8), 16, 10).cast("long"), F.lit(bits)) for i in range(hashes)])


def bloom_check(members: DataFrame, asked: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """(item, maybe): whether all bits of an asked item are set by the members."""
    of = lambda df: df.select(item, F.explode(F.array_distinct(bloom_bits(F.col(item), bits, hashes))).alias("bit"))
    known = of(members).select("bit").distinct().withColumn("set", F.lit(True))
    return of(asked.select(item).distinct()).join(known, "bit", "left").groupBy(item).agg(F.count_if(F.col("set").isNull()).alias("unset")).select(item, (F.col("unset") == 0).alias("maybe"))


def load_results(records: DataFrame) -> DataFrame:
    """Records of all mappers without unmapped ones and duplicates, numbered within each read and mate in the file's order."""
    mapped = deduplicate(records.where("contig <> '*'"), ["mapper", "qname", "contig", "pos", "detail", "mate"], "ordinal")
    return mapped.withColumn("place", F.row_number().over(W.partitionBy("qname", "mate").orderBy("ordinal")).cast("long"))


def read_clusters(records: DataFrame, length: int) -> DataFrame:
    """Clusters of each read's records: (qname, contig, start, end, records) of merged [pos, pos + length)."""
    order = W.partitionBy("qname", "contig").orderBy("pos", "ordinal")
    new = (F.col("pos") >= F.lag("pos").over(order) + length) | F.lag("pos").over(order).isNull()
    marked = records.withColumn("new", new.cast("int")).withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("qname", "contig", "cluster").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end"), F.count(F.lit(1)).alias("records")).drop("cluster")


def strict_confident(records: DataFrame, most_mismatches: int = 6) -> DataFrame:
    """Reads of which either mate has one record, both with few mismatches and on opposite strands."""
    side = lambda m, c: F.max(F.when(F.col("mate") == m, F.col(c)))
    per = records.groupBy("qname").agg(F.count_if(F.col("mate") == 0).alias("n0"), F.count_if(F.col("mate") == 1).alias("n1"), F.max("mismatches").alias("mm"), side(0, "strand").alias("s0"), side(1, "strand").alias("s1"))
    return per.where((F.col("n0") == 1) & (F.col("n1") == 1) & (F.col("mm") < most_mismatches) & (F.col("s0") != F.col("s1"))).select("qname")
