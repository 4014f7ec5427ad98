"""Queries of the comparison layer: event types stand for mappers, users for reads, hours for positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.operators import agreement as A


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark, d):
    ts = F.col("ts").cast("timestamp")
    hour = F.floor(F.unix_micros(ts) / 3_600_000_000).cast("long")
    minute = (F.floor(F.unix_micros(ts) / 60_000_000) % 1440).cast("long")
    return _t(spark, d, "events").select(
        F.col("event_type").alias("mapper"), F.col("user_id").cast("string").alias("qname"), (F.col("event_id") % 2).cast("int").alias("mate"), (F.col("event_id") % 3).cast("string").alias("contig"),
        hour.alias("hour"), (minute - minute % 240).alias("pos"), (F.floor("value") % 3).cast("long").alias("detail"), F.col("event_id").alias("ordinal"),
    )


def _mappers(records):
    return sorted(r[0] for r in records.select("mapper").distinct().collect())  # few, by nature


def a16(spark, d):
    return A.heatmap(_records(spark, d))


def a17(spark, d):
    return A.density(_records(spark, d))


def a18(spark, d):
    r = _records(spark, d)
    wide = A.parallel(r, _mappers(r))
    return wide.unpivot(["qname"], [c for c in wide.columns if c != "qname"], "mapper", "n")


def f22(spark, d):
    r = _records(spark, d)
    m = _mappers(r)
    return A.unequal(A.parallel(r, m), m).select("qname")


def a22(spark, d):
    r = _records(spark, d)
    m = _mappers(r)
    return A.sankey(A.parallel(r, m), m)


def a23(spark, d):
    return A.ridge(_records(spark, d))


def a20(spark, d):
    r = _records(spark, d)
    return A.mapper_sets(r, [F.col("mate").cast("string"), F.col("qname"), F.col("pos").cast("string")])


def a21(spark, d):
    r = _records(spark, d)
    return A.intersections(A.mapper_sets(r, [F.col("mate").cast("string"), F.col("qname")]))


def a21_sizes(spark, d):
    r = _records(spark, d)
    return A.inclusive_sizes(A.mapper_sets(r, [F.col("mate").cast("string"), F.col("qname")]))


def j22(spark, d):
    return A.shared_records(_records(spark, d), ["qname", "contig", "pos"])


def j25(spark, d):
    """Pairs of mappers that share keys, from loose to strict."""
    r, out = _records(spark, d), None
    for level, keys in enumerate((["qname"], ["qname", "mate"], ["qname", "mate", "contig"], ["qname", "mate", "contig", "pos"], ["qname", "mate", "contig", "pos", "detail"])):
        part = A.shared_records(r.select("mapper", *keys).distinct(), keys).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def u2(spark, d):
    return A.deduplicate(_records(spark, d), ["mapper", "qname", "contig", "pos", "detail", "mate"], "ordinal").select("ordinal")


def a31(spark, d):
    return A.read_info(_records(spark, d), "detail")


def a39(spark, d):
    return A.counts(_records(spark, d))


def _first_records(spark, d):
    """The first record of each mapper, read and mate, with a two-block alignment."""
    r = A.deduplicate(_records(spark, d), ["mapper", "qname", "mate"], "ordinal")
    cut, gap = 40 + 10 * F.col("detail"), 20 + 20 * (F.col("detail") % 2)
    read = F.array(R.region(F.lit(0), cut), R.region(cut, F.lit(100)))
    genome = F.array(R.region(F.col("pos"), F.col("pos") + cut), R.region(F.col("pos") + cut + gap, F.col("pos") + 100 + gap))
    return r.withColumn("read", read).withColumn("genome", genome)


def _distances(spark, d):
    r = _first_records(spark, d)
    pick = lambda s: r.select("qname", "mate", *[F.col(c).alias(f"{c}_{s}") for c in ("ordinal", "contig", "read", "genome")])
    pairs = pick("a").join(pick("b"), ["qname", "mate"]).where("ordinal_a < ordinal_b")
    dist = A.record_distance(F.col("read_a"), F.col("genome_a"), F.col("read_b"), F.col("genome_b"), F.col("contig_a") == F.col("contig_b"), F.lit(100.0))
    return pairs.withColumn("distance", F.round(dist, 6))


def j23(spark, d):
    return A.record_pairs(A.deduplicate(_records(spark, d), ["mapper", "qname", "mate"], "ordinal")).select("ordinal_a", "ordinal_b")


def j24(spark, d):
    return _distances(spark, d).select("ordinal_a", "ordinal_b", "distance")


def a26(spark, d):
    return A.mean_distances(_distances(spark, d))


def m22(spark, d):
    return A.similar_groups(_first_records(spark, d), _distances(spark, d))


def _levels(spark, d):
    groups = m22(spark, d).groupBy("qname", "mate", "group").agg(F.count(F.lit(1)).alias("size"))
    return A.confidence(groups, 5)


def a25(spark, d):
    return _levels(spark, d).select("qname", "mate", "level")


def a25_reads(spark, d):
    return A.read_confidence(_levels(spark, d))


def a24(spark, d):
    """Summary of every read: places, mappers, length and confidence."""
    r = _first_records(spark, d)
    base = r.groupBy("qname").agg(F.count_distinct("contig", "pos").alias("locations"), F.array_join(F.array_sort(F.collect_set("mapper")), ",").alias("mapped_by"), F.max("detail").alias("length"))
    return base.join(A.read_confidence(_levels(spark, d)), "qname")


def _log(spark, d):
    """Curation events: the event's kind of action by its number."""
    names = F.array(*[F.lit(x) for x in ("accept", "accept", "unaccept", "discard", "accept", "reset", "accept")])
    return _t(spark, d, "events").select((F.col("user_id") % 300).cast("string").alias("qname"), (F.col("event_id") % 2).cast("int").alias("mate"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("action"), F.col("event_id").alias("record"), F.col("event_id").alias("seq"))


def e9(spark, d):
    state = A.curation_state(_log(spark, d))
    return state.select("qname", F.coalesce("mate", F.lit(-1)).alias("mate"), F.coalesce("accepted", F.lit(-1)).alias("accepted"), "discarded")


def a19(spark, d):
    return A.general_info(A.curation_state(_log(spark, d)))


def r5(spark, d):
    return A.curation_state(_log(spark, d)).where("accepted is not null").select("qname", "mate", "accepted")


def f21(spark, d):
    """Reads that are neither accepted in full nor discarded."""
    per = A.curation_state(_log(spark, d)).groupBy("qname").agg(F.count("accepted").alias("mates"), F.max("discarded").alias("discarded"))
    return per.where("mates < 2 and not discarded").select("qname")


def o5(spark, d):
    """Own mapper first, the others by name."""
    own = F.when(F.col("mapper") == "purchase", 0).otherwise(1)
    names = _records(spark, d).select("mapper").distinct()
    return names.select("mapper", F.row_number().over(A.W.orderBy(own, "mapper")).cast("long").alias("place"))


def o6(spark, d):
    """A page of the summary table, sorted by a key."""
    return _t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(30).limit(15).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


def o4(spark, d):
    """All rows of the smallest value, ties kept."""
    r = F.rank().over(A.W.partitionBy("l_suppkey").orderBy("l_quantity"))
    return _t(spark, d, "lineitem").withColumn("r", r).where("r = 1").select("l_suppkey", "l_orderkey", "l_linenumber")


_REC = "rec AS (SELECT event_type AS mapper, CAST(user_id AS VARCHAR) AS qname, event_id % 2 AS mate, CAST(event_id % 3 AS VARCHAR) AS contig, (epoch_us(ts) // 60000000) % 1440 - (epoch_us(ts) // 60000000) % 1440 % 240 AS pos, CAST(floor(value) AS BIGINT) % 3 AS detail, event_id AS ordinal FROM events), cnt AS (SELECT mapper, qname, count(*) AS n FROM rec GROUP BY ALL)"
_FULL = "ms AS (SELECT DISTINCT mapper FROM rec), qs AS (SELECT DISTINCT qname FROM rec), wide AS (SELECT qs.qname, ms.mapper, coalesce(n, 0) AS n FROM qs CROSS JOIN ms LEFT JOIN cnt ON cnt.qname = qs.qname AND cnt.mapper = ms.mapper)"
_DIST = """fr AS (SELECT *, 40 + 10 * detail AS cut, 20 + 20 * (detail % 2) AS gap FROM rec QUALIFY row_number() OVER (PARTITION BY mapper, qname, mate ORDER BY ordinal) = 1),
pr AS (SELECT a.qname, a.mate, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, a.contig = b.contig AS same, a.pos AS pa, b.pos AS pb, a.cut AS ca, b.cut AS cb, a.gap AS ga, b.gap AS gb FROM fr a JOIN fr b ON a.qname = b.qname AND a.mate = b.mate AND a.ordinal < b.ordinal),
ov AS (SELECT *, CASE WHEN pa = pb THEN least(ca, cb) ELSE 0 END + CASE WHEN pa + ga = pb + gb THEN 100 - greatest(ca, cb) ELSE 0 END + CASE WHEN pa = pb + gb THEN greatest(ca - cb, 0) ELSE 0 END + CASE WHEN pa + ga = pb THEN greatest(cb - ca, 0) ELSE 0 END AS eq,
  CAST(pa + ca = pb + cb AS INT) + CAST(pa + ca + ga = pb + cb + gb AS INT) AS bounds FROM pr),
dist AS (SELECT qname, mate, ordinal_a, ordinal_b, round(CASE WHEN NOT same THEN 1.0::DOUBLE ELSE ((1 - eq / 100.0::DOUBLE) + 0.5 * (1 - bounds / 2.0::DOUBLE)) / 3 END, 6) AS distance FROM ov)"""
_GROUPS = """zero AS (SELECT qname, mate, ordinal_a AS x, ordinal_b AS y FROM dist WHERE distance = 0),
reach(x, y) AS (SELECT ordinal, ordinal FROM fr UNION SELECT reach.x, e.y FROM reach JOIN (SELECT x, y FROM zero UNION ALL SELECT y, x FROM zero) e ON reach.y = e.x),
grp AS (SELECT qname, CAST(mate AS INT) AS mate, ordinal, low AS "group" FROM fr JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) l ON l.x = fr.ordinal),
sz AS (SELECT qname, mate, "group", count(*) AS size FROM grp GROUP BY ALL),
lv AS (SELECT qname, mate, CAST(CASE WHEN max(size) = 5 THEN CASE WHEN count(*) = 1 THEN 5 WHEN min(size) = 5 THEN 4 ELSE 3 END WHEN max(size) > 1 THEN 2 ELSE 1 END AS INT) AS level FROM sz GROUP BY qname, mate),
rc AS (SELECT qname, CAST(CASE WHEN count(DISTINCT mate) < 2 THEN 1 ELSE min(level) END AS INT) AS level FROM lv GROUP BY qname)"""
_LOG = """lg AS (SELECT CAST(user_id % 300 AS VARCHAR) AS qname, event_id % 2 AS mate, (['accept','accept','unaccept','discard','accept','reset','accept'])[1 + event_id % 7] AS action, event_id AS seq FROM events),
mt AS (SELECT qname, mate, arg_max(CASE WHEN action = 'accept' THEN seq ELSE -1 END, seq) AS accepted FROM lg WHERE action IN ('accept', 'unaccept', 'reset') GROUP BY ALL),
rd AS (SELECT qname, coalesce(arg_max(action = 'discard', seq) FILTER (action IN ('discard', 'reset')), FALSE) AS discarded FROM lg GROUP BY qname),
st AS (SELECT rd.qname, coalesce(mate, -1) AS mate, coalesce(accepted, -1) AS accepted, discarded FROM rd LEFT JOIN mt USING (qname)),
pq AS (SELECT qname, count(*) FILTER (accepted >= 0) AS mates, bool_or(discarded) AS discarded FROM st GROUP BY qname)"""
_LEVELS = " UNION ALL ".join(f"SELECT a.mapper AS a, b.mapper AS b, count(*) AS shared, CAST({i} AS INT) AS level FROM (SELECT DISTINCT mapper, {k} FROM rec) a JOIN (SELECT DISTINCT mapper, {k} FROM rec) b USING ({k}) WHERE a.mapper <> b.mapper GROUP BY ALL" for i, k in enumerate(("qname", "qname, mate", "qname, mate, contig", "qname, mate, contig, pos", "qname, mate, contig, pos, detail")))

QUERIES = {
    "A16_multimapping_heatmap": (a16, f"WITH {_REC}, top AS (SELECT max(n) AS t FROM cnt), g AS (SELECT mapper, unnest(range(1, t + 1)) AS n FROM (SELECT DISTINCT mapper FROM rec), top), h AS (SELECT mapper, n, count(*) AS reads FROM cnt GROUP BY ALL) SELECT g.mapper, g.n, coalesce(reads, 0) AS reads FROM g LEFT JOIN h ON g.mapper = h.mapper AND g.n = h.n"),
    "A17_multimapping_density": (a17, f"WITH {_REC} SELECT mapper, count(*) AS reads, max(n) AS most, CAST(sum(n) AS BIGINT) AS records FROM cnt GROUP BY mapper"),
    "A18_multimapping_parallel": (a18, f"WITH {_REC}, {_FULL} SELECT qname, mapper, n FROM wide"),
    "F22_sankey_filter": (f22, f"WITH {_REC}, {_FULL} SELECT DISTINCT qname FROM wide WHERE n <> 2"),
    "A22_sankey_links": (a22, f"WITH {_REC}, {_FULL}, o AS (SELECT qname, mapper || ':' || n AS source, lead(mapper || ':' || n) OVER (PARTITION BY qname ORDER BY mapper) AS target FROM wide) SELECT source, target, count(*) AS value FROM o WHERE target IS NOT NULL GROUP BY ALL"),
    "A23_ridge_histogram": (a23, f"WITH {_REC}, b AS (SELECT mapper, CAST(CASE WHEN n < 0.5 THEN 0 WHEN n >= 10 THEN 20 ELSE floor((n - 0.5) / 0.5) + 1 END AS BIGINT) AS bin, count(*) AS k FROM cnt GROUP BY ALL) SELECT mapper, bin, round(k / sum(k) OVER (PARTITION BY mapper), 6) AS share FROM b"),
    "A20_upset_sets": (a20, f"WITH {_REC} SELECT mate || '::' || qname || '::' || pos AS key, string_agg(DISTINCT mapper, ',' ORDER BY mapper) AS mappers FROM rec GROUP BY ALL"),
    "A21_upset_intersections": (a21, f"WITH {_REC}, s AS (SELECT mate, qname, string_agg(DISTINCT mapper, ',' ORDER BY mapper) AS mappers FROM rec GROUP BY ALL) SELECT mappers, count(*) AS n FROM s GROUP BY mappers"),
    "A21_inclusive_sizes": (a21_sizes, f"WITH {_REC} SELECT mapper, count(DISTINCT (mate, qname)) AS n FROM rec GROUP BY mapper"),
    "J22_mapper_distances": (j22, f"WITH {_REC}, k AS (SELECT qname, contig, pos, mapper, count(*) AS n FROM rec GROUP BY ALL) SELECT a.mapper AS a, b.mapper AS b, CAST(sum(b.n) AS BIGINT) AS shared FROM k a JOIN k b ON a.qname = b.qname AND a.contig = b.contig AND a.pos = b.pos AND a.mapper <> b.mapper GROUP BY ALL"),
    "J25_compare_results": (j25, f"WITH {_REC} {_LEVELS}"),
    "U2_duplicate_records": (u2, f"WITH {_REC} SELECT min(ordinal) AS ordinal FROM rec GROUP BY mapper, qname, contig, pos, detail, mate"),
    "A31_read_info": (a31, f"WITH {_REC} SELECT qname, count(*) AS records, arg_min(detail, ordinal) AS length, count(DISTINCT mate) > 1 AS paired FROM rec GROUP BY qname"),
    "A39_records_by_read": (a39, f"WITH {_REC} SELECT * FROM cnt"),
    "J23_record_pairs": (j23, f"WITH {_REC}, {_DIST} SELECT ordinal_a, ordinal_b FROM pr"),
    "J24_record_distance": (j24, f"WITH {_REC}, {_DIST} SELECT ordinal_a, ordinal_b, distance FROM dist"),
    "A26_mean_distance": (a26, f"WITH {_REC}, {_DIST} SELECT qname, CAST(mate AS INT) AS mate, round(avg(distance), 6) AS mean_distance, count(*) AS pairs FROM dist GROUP BY qname, mate"),
    "M22_similar_groups": (m22, f'WITH RECURSIVE {_REC}, {_DIST}, {_GROUPS} SELECT qname, mate, ordinal, "group" FROM grp'),
    "A25_confidence": (a25, f"WITH RECURSIVE {_REC}, {_DIST}, {_GROUPS} SELECT qname, mate, level FROM lv"),
    "A25_read_confidence": (a25_reads, f"WITH RECURSIVE {_REC}, {_DIST}, {_GROUPS} SELECT qname, level FROM rc"),
    "A24_read_summary": (a24, f"WITH RECURSIVE {_REC}, {_DIST}, {_GROUPS}, b AS (SELECT qname, count(DISTINCT (contig, pos)) AS locations, string_agg(DISTINCT mapper, ',' ORDER BY mapper) AS mapped_by, max(detail) AS length FROM fr GROUP BY qname) SELECT qname, locations, mapped_by, length, level FROM b JOIN rc USING (qname)"),
    "E9_curation_state": (e9, f"WITH {_LOG} SELECT qname, CAST(mate AS INT) AS mate, accepted, discarded FROM st"),
    "A19_general_info": (a19, f"WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (mates >= 2) AS accepted, count(*) FILTER (mates = 1) AS in_progress, count(*) FILTER (discarded) AS discarded, count(*) - count(*) FILTER (mates >= 2) - count(*) FILTER (discarded) AS todo FROM pq"),
    "R5_accepted_records": (r5, f"WITH {_LOG} SELECT qname, CAST(mate AS INT) AS mate, accepted FROM st WHERE accepted >= 0"),
    "F21_summary_filter": (f21, f"WITH {_LOG} SELECT qname FROM pq WHERE mates < 2 AND NOT discarded"),
    "O5_mapper_order": (o5, "SELECT mapper, row_number() OVER (ORDER BY mapper <> 'purchase', mapper) AS place FROM (SELECT DISTINCT event_type AS mapper FROM events)"),
    "O6_sorted_page": (o6, "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30"),
    "O4_top_with_ties": (o4, "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) = 1"),
}
