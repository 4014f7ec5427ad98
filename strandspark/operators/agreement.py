"""Comparison of several mappers: who mapped what, how alike, and with what confidence.

A records table has one row per alignment: mapper, qname, mate, contig, pos, cigar (or another detail) and an ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deduplicate(records: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of records that agree in all keys the first by ordinal."""
    return records.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(ordinal))).where("__rn = 1").drop("__rn")


def counts(records: DataFrame) -> DataFrame:
    """Records of each read by mapper."""
    return records.groupBy("mapper", "qname").agg(F.count(F.lit(1)).alias("n"))


def heatmap(records: DataFrame) -> DataFrame:
    """Reads by number of records for each mapper, dense from 1 to the largest number."""
    seen = counts(records)
    hist = seen.groupBy("mapper", "n").agg(F.count(F.lit(1)).alias("reads"))
    top = seen.agg(F.max("n").alias("top"))
    grid = seen.select("mapper").distinct().join(F.broadcast(top)).select("mapper", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("n"))
    return grid.join(hist, ["mapper", "n"], "left").withColumn("reads", F.coalesce("reads", F.lit(0).cast("long")))


def density(records: DataFrame) -> DataFrame:
    """Number of reads, largest and summed number of records for each mapper."""
    return counts(records).groupBy("mapper").agg(F.count(F.lit(1)).alias("reads"), F.max("n").alias("most"), F.sum("n").alias("records"))


def parallel(records: DataFrame, mappers: list[str]) -> DataFrame:
    """Records of each read by mapper, side by side, 0 where there is none."""
    return records.groupBy("qname").pivot("mapper", mappers).count().na.fill(0)


def unequal(pivoted: DataFrame, mappers: list[str], usual: int = 2) -> DataFrame:
    """Reads that some mapper maps other than the usual number of times."""
    return pivoted.where(" or ".join(f"`{m}` <> {usual}" for m in mappers))


def sankey(pivoted: DataFrame, mappers: list[str]) -> DataFrame:
    """Links between the counts of neighbouring columns."""
    links = F.array(*[F.struct(F.concat(F.lit(a + ":"), F.col(f"`{a}`")).alias("source"), F.concat(F.lit(b + ":"), F.col(f"`{b}`")).alias("target")) for a, b in zip(mappers, mappers[1:], strict=False)])
    return pivoted.select(F.inline(links)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("value"))


def ridge(records: DataFrame, low: float = 0.5, high: float = 10.0, bins: int = 19) -> DataFrame:
    """Share of each mapper's reads by bin of their record counts."""
    binned = counts(records).withColumn("bin", F.width_bucket(F.col("n").cast("double"), F.lit(low), F.lit(high), F.lit(bins)))
    total = W.partitionBy("mapper")
    by = binned.groupBy("mapper", "bin").agg(F.count(F.lit(1)).alias("k"))
    return by.select("mapper", "bin", F.round(F.col("k") / F.sum("k").over(total), 6).alias("share"))


def mapper_sets(records: DataFrame, key: list[Column]) -> DataFrame:
    """The sorted set of mappers of each key (mate and read, with position or detail if asked for)."""
    return records.groupBy(F.concat_ws("::", *key).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("mapper")), ",").alias("mappers"))


def intersections(sets: DataFrame) -> DataFrame:
    """Keys of each exact set of mappers."""
    return sets.groupBy("mappers").agg(F.count(F.lit(1)).alias("n"))


def inclusive_sizes(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode(F.split("mappers", ",")).alias("mapper")).groupBy("mapper").agg(F.count(F.lit(1)).alias("n"))


def shared_records(records: DataFrame, keys: list[str]) -> DataFrame:
    """For ordered pairs of different mappers the records of b that a has too (by keys).

    The mappers of each key are gathered (there are few), so no mapper pair is joined in full.
    """
    per = records.groupBy(*keys, "mapper").agg(F.count(F.lit(1)).alias("n"))
    have = per.groupBy(*keys).agg(F.collect_list(F.struct("mapper", "n")).alias("m"))
    pairs = have.select(F.explode("m").alias("x"), "m").select(F.col("x.mapper").alias("a"), F.explode("m").alias("y")).select("a", F.col("y.mapper").alias("b"), F.col("y.n").alias("n")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def read_info(records: DataFrame, length: str) -> DataFrame:
    """Records, first length and whether both mates occur, by read."""
    return records.groupBy("qname").agg(F.count(F.lit(1)).alias("records"), F.min_by(length, "ordinal").alias("length"), (F.count_distinct("mate") > 1).alias("paired"))


def record_pairs(records: DataFrame) -> DataFrame:
    """All pairs of records of one read and mate (bounded by the mappers' records of a read)."""
    a = records.select("qname", "mate", *[F.col(c).alias(f"{c}_a") for c in ("ordinal", "mapper", "contig", "pos", "detail")])
    b = records.select("qname", "mate", *[F.col(c).alias(f"{c}_b") for c in ("ordinal", "mapper", "contig", "pos", "detail")])
    return a.join(b, ["qname", "mate"]).where("ordinal_a < ordinal_b")


def record_distance(read_a: Column, genome_a: Column, read_b: Column, genome_b: Column, same_contig: Column, read_length: Column) -> Column:
    """Distance of two alignments of a read: 1 on other contigs, else the mean of three weighted shares.

    Shares: read bases that only one aligns (weight 1/2), bases that both align to other places (1), and gap bounds
    that differ (1/2). Interval arithmetic over paired regions replaces a walk along the read.
    """
    from strandspark.functions import regions as R

    def common(same_place: bool) -> Column:
        zip_a, zip_b = F.arrays_zip(read_a.alias("r"), genome_a.alias("g")), F.arrays_zip(read_b.alias("r"), genome_b.alias("g"))

        def overlap(x: Column, y: Column) -> Column:
            size = F.greatest(F.least(x["r"]["end"], y["r"]["end"]) - F.greatest(x["r"]["start"], y["r"]["start"]), F.lit(0))
            if not same_place:
                return size
            return F.when(x["g"]["start"] - x["r"]["start"] == y["g"]["start"] - y["r"]["start"], size).otherwise(0)

        return F.aggregate(zip_a, F.lit(0).cast("long"), lambda s, x: s + F.aggregate(zip_b, F.lit(0).cast("long"), lambda t, y: t + overlap(x, y)))

    both, same = common(False), common(True)
    one = (R.length(read_a) + R.length(read_b) - 2 * both) / read_length
    share = F.when(both > 0, same / F.greatest(both, F.lit(1))).otherwise(0.0)
    gaps_a, gaps_b = R.gaps(genome_a), R.gaps(genome_b)
    hit = lambda part: F.size(F.filter(gaps_a, lambda g: F.exists(gaps_b, lambda h: g[part] == h[part])))
    n = F.size(gaps_a) + F.size(gaps_b)
    bounds = F.when(n > 0, (hit("start") + hit("end")) / F.greatest(n, F.lit(1))).otherwise(1.0)
    return F.when(~same_contig, F.lit(1.0)).otherwise((0.5 * one + (1 - share) + 0.5 * (1 - bounds)) / 3)


def confidence(groups: DataFrame, mappers: int) -> DataFrame:
    """Confidence 1 to 5 of each read and mate from the sizes of its groups of alike records."""
    sized = groups.groupBy("qname", "mate").agg(F.max("size").alias("largest"), F.min("size").alias("smallest"), F.count(F.lit(1)).alias("groups"))
    level = F.when(F.col("largest") == mappers, F.when(F.col("groups") == 1, 5).when(F.col("smallest") == mappers, 4).otherwise(3)).when(F.col("largest") > 1, 2).otherwise(1)
    return sized.withColumn("level", level)


def read_confidence(levels: DataFrame) -> DataFrame:
    """The lower level of the two mates; a mate without records has level 1."""
    both = levels.groupBy("qname").agg(F.min("level").alias("low"), F.count_distinct("mate").alias("mates"))
    return both.select("qname", F.when(F.col("mates") < 2, 1).otherwise(F.col("low")).alias("level"))


def mean_distances(pairs: DataFrame) -> DataFrame:
    """Mean distance over the record pairs of each read and mate."""
    return pairs.groupBy("qname", "mate").agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.count(F.lit(1)).alias("pairs"))


def similar_groups(records: DataFrame, pairs: DataFrame, schema: str = "qname string, mate int, ordinal long, group long") -> DataFrame:
    """Records of a read and mate that are linked by distance zero; a group is named by its smallest ordinal.

    Groups are found read by read: their records are few, so each read's links are merged in one Arrow batch.
    """

    def link(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        up = {int(o): int(o) for o in left["ordinal"]}

        def find(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        for a, b in zip(right["ordinal_a"], right["ordinal_b"], strict=True):
            x, y = find(int(a)), find(int(b))
            up[max(x, y)] = min(x, y)
        return pd.DataFrame({"qname": key[0], "mate": key[1], "ordinal": list(up), "group": [find(o) for o in up]})

    zero = pairs.where("distance = 0").select("qname", "mate", "ordinal_a", "ordinal_b")
    return records.select("qname", "mate", "ordinal").groupBy("qname", "mate").cogroup(zero.groupBy("qname", "mate")).applyInPandas(link, schema)


def curation_state(events: DataFrame) -> DataFrame:
    """Current state of each read and mate from the append-only log of accept, unaccept, discard and reset events.

    `events` has qname, mate, action, record and seq (a total order). Discarding marks the read and keeps what was
    accepted; a reset clears both.
    """
    act = F.col("action")
    last = lambda kinds, value: F.max_by(value, F.when(act.isin(*kinds), F.col("seq")))
    mate = events.where(act.isin("accept", "unaccept", "reset")).groupBy("qname", "mate").agg(last(("accept", "unaccept", "reset"), F.when(act == "accept", F.col("record"))).alias("accepted"))
    read = events.groupBy("qname").agg(F.coalesce(last(("discard", "reset"), act == "discard"), F.lit(False)).alias("discarded"))
    return read.join(mate, "qname", "left")


def general_info(state: DataFrame) -> DataFrame:
    """Reads in all, accepted (both mates), in progress (one), discarded, and to do."""
    per = state.groupBy("qname").agg(F.count("accepted").alias("mates"), F.max("discarded").alias("discarded"))
    info = per.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("mates") >= 2).alias("accepted"), F.count_if(F.col("mates") == 1).alias("in_progress"), F.count_if("discarded").alias("discarded"))
    return info.withColumn("todo", F.col("total") - F.col("accepted") - F.col("discarded"))
