"""Interval algebra on tables: half-open intervals [start, end), one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of an interval table that are broadcast at most.
BROADCAST_ROWS = 200_000


def merge(df: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """Union of the intervals of each key; those that touch (or lie within `tolerance`) become one."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col("start") <= reach + tolerance, 0).otherwise(1))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("__island")


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between neighbouring intervals, those of no length included."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    return df.select(*keys, F.col("end").alias("start"), F.lead("start").over(w).alias("__next")).where("__next is not null").withColumnRenamed("__next", "end")


def complement(df: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """What of [low, high) no interval of the key covers; low and high are aggregates of the key's rows."""
    bounds = df.groupBy(*keys).agg(low.alias("__low"), high.alias("__high"))
    edges = bounds.select(*keys, F.inline(F.array(F.struct(F.col("__low").alias("start"), F.col("__low").alias("end")), F.struct(F.col("__high").alias("start"), F.col("__high").alias("end")))))
    merged = merge(df, keys).select(*keys, "start", "end").unionByName(edges)
    return gaps(merged, keys).where("start < end")


def classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint segments between all boundaries that some interval covers, with their depth."""
    events = df.select(*keys, F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))))
    net = events.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*keys).orderBy("pos")
    swept = net.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long").alias("depth"))
    return swept.where("depth > 0 and end is not null")


def coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal depth, neighbouring runs of one depth joined."""
    runs = classes(df, keys)
    w = W.partitionBy(*keys).orderBy("start")
    new = F.when((F.lag("depth").over(w) == F.col("depth")) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    island = runs.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    return island.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("depth").alias("depth")).drop("__island")


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals with their rank from 0 in order of start and end."""
    return df.withColumn("rank", (F.row_number().over(W.partitionBy(*keys).orderBy("start", "end")) - 1).cast("long"))


def flatten_priorities(df: DataFrame, keys: list[str], priority: str, label: str) -> DataFrame:
    """Overlapping intervals made disjoint: each piece goes to the highest priority (of equals the first label), and
    neighbouring pieces of one label are joined."""
    cuts = df.select(*keys, F.explode(F.array("start", "end")).alias("pos")).distinct()
    w = W.partitionBy(*keys).orderBy("pos")
    pieces = cuts.select(*keys, F.col("pos").alias("p_start"), F.lead("pos").over(w).alias("p_end")).where("p_end is not null")
    held = pieces.join(df, keys).where((F.col("start") <= F.col("p_start")) & (F.col("end") >= F.col("p_end")))
    won = held.groupBy(*keys, "p_start", "p_end").agg(F.min_by(label, F.struct(-F.col(priority), F.col(label))).alias(label))
    w = W.partitionBy(*keys).orderBy("p_start")
    new = F.when((F.lag(label).over(w) == F.col(label)) & (F.lag("p_end").over(w) == F.col("p_start")), 0).otherwise(1)
    island = won.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    return island.groupBy(*keys, label, "__island").agg(F.min("p_start").alias("start"), F.max("p_end").alias("end")).drop("__island")


def _binned(df: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of a left interval (start, end) and a right one (r_start, r_end) of one key that overlap.

    Both sides are dealt into bins of `width` and equi-joined on key and bin; a pair is reported in the bin where the
    later of the two starts lies, so it comes once. `closed` counts ends as inside.
    """
    reach = 0 if closed else 1
    a = _binned(left, F.col("start"), F.greatest(F.col("end") - reach, F.col("start")), width)
    b = _binned(right, F.col("r_start"), F.greatest(F.col("r_end") - reach, F.col("r_start")), width)
    meet = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) if closed else (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    home = F.floor(F.greatest("start", "r_start") / width) == F.col("__bin")
    return a.join(b, [*keys, "__bin"]).where(meet & home).drop("__bin")


def stab(points: DataFrame, ranges: DataFrame, keys: list[str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of a point `pos` and an interval (start, end) of its key that holds it."""
    a = points.withColumn("__bin", F.floor(F.col("pos") / width))
    b = _binned(ranges, F.col("start"), F.col("end"), width)
    upper = F.col("pos") <= F.col("end") if closed else F.col("pos") < F.col("end")
    return a.join(b, [*keys, "__bin"]).where((F.col("start") <= F.col("pos")) & upper).drop("__bin")


def as_of(points: DataFrame, starts: DataFrame, keys: list[str], point_id: list[str], forward: bool = False) -> DataFrame:
    """For each point the last start at or before it (or, forward, the first at or after it); null without one.

    One sort of the union by key and place instead of a range join.
    """
    p = points.select(*keys, *point_id, "pos", F.lit(1 if not forward else 0).alias("__kind"), F.lit(None).cast("long").alias("__start"))
    s = starts.select(*keys, *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in point_id], F.col("start").alias("pos"), F.lit(0 if not forward else 1).alias("__kind"), F.col("start").cast("long").alias("__start"))
    w = W.partitionBy(*keys).orderBy("pos", "__kind")
    found = F.first("__start", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)) if forward else F.last("__start", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    both = p.unionByName(s).withColumn("found", found)
    return both.where(F.col("__kind") == (0 if forward else 1)).select(*keys, *point_id, "pos", "found")


def clip_to_labels(regions: DataFrame, labels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Regions split by the labelled intervals (r_start, r_end) that they overlap: the common parts."""
    return overlap_join(regions, labels, keys, width).withColumn("c_start", F.greatest("start", "r_start")).withColumn("c_end", F.least("end", "r_end"))
