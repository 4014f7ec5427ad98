"""Queries of region pairs, target masks, read details and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.functions import scalars as S
from strandspark.operators import agreement as A
from strandspark.operators import details as D
from strandspark.plans.agreement_queries import _LOG, _REC, _log, _records


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark, d):
    """The items of each order in order, with at most 40 bases each."""
    q = F.least(F.col("l_quantity").cast("long"), F.lit(40).cast("long"))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", q.alias("q")))).alias("items"))


def _pairs(spark, d):
    """Read regions end to end, and genome regions that begin every 40 bases."""
    size = F.transform("items", lambda x: x["q"])
    items = _items(spark, d).withColumn("q", size)
    upto = lambda i: F.aggregate(F.slice("q", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)
    read = F.transform("q", lambda x, i: R.region(upto(i), upto(i) + x))
    genome = F.transform("q", lambda x, i: R.region(40 * i, 40 * i + x))
    return items.select("l_orderkey", read.alias("read"), genome.alias("genome"))


def c15(spark, d):
    q = F.col("l_quantity").cast("long")
    r = R.region(F.col("l_linenumber") * 40, F.col("l_linenumber") * 40 + q)
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    r, a, b = F.col("r"), F.lit(100), F.lit(130)
    return x.select("l_orderkey", "l_linenumber", (r["end"] - r["start"]).alias("length"), D.contains(r, a, b).alias("contains"), D.left_overlap(r, a, b).alias("left"), D.right_overlap(r, a, b).alias("right"))


def w3(spark, d):
    p = _pairs(spark, d)
    return p.select("l_orderkey", R.text(R.merge(F.col("read"))).alias("read"), R.text(R.merge(F.col("genome"))).alias("genome"))


def w6(spark, d):
    p = _pairs(spark, d).select("l_orderkey", D.normalize(F.col("read"), F.col("genome")).alias("n"))
    return p.select("l_orderkey", R.text(F.col("n.read")).alias("read"), R.text(F.col("n.genome")).alias("genome"))


def r9(spark, d):
    """Items that overlap the first and the last one of their order, as intervals of days."""
    r = R.region(F.col("l_partkey") % 97, F.col("l_partkey") % 97 + 15)
    v = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(r)).alias("v"))
    first, last = F.get("v", F.lit(0)), F.element_at("v", -1)
    return v.select("l_orderkey", R.text(D.overlapping(F.col("v"), first)).alias("first"), R.text(D.overlapping(F.col("v"), last)).alias("last"))


def r10(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey") % 200)).alias("p"))
    return p.select("l_orderkey", F.array_join(D.inside(F.col("p"), F.lit(60), F.lit(130)), ",").alias("inside"))


def r11(spark, d):
    left = F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 5)))
    right = F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey") % 5))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(left.alias("a"), right.alias("b")).select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("paddings"))


def r12(spark, d):
    p = _pairs(spark, d)
    return p.select("l_orderkey", F.coalesce(R.text(D.insert_apart(F.col("genome"), F.lit(35), F.lit(40))), F.lit("overlap")).alias("genome"))


def r19(spark, d):
    p = _pairs(spark, d)
    return p.select("l_orderkey", R.text(F.reverse("read")).alias("read"), R.text(F.reverse("genome")).alias("genome"))


def u8(spark, d):
    """Distinct paths, compared region by region."""
    return _pairs(spark, d).select("genome").distinct().select(R.text(F.col("genome")).alias("path"))


def c11(spark, d):
    text = F.col("text")
    b = _t(spark, d, "benchmark").where("length(text) >= 60").select("item_id", F.substring(text, 1, 60).alias("read"), F.substring(F.translate(text, "eu", "ao"), 1, 60).alias("ref"))
    ops = S.cigar(F.lit("3S20M2I10M4D15M"))
    return b.select("item_id", D.detailed_cigar(ops, F.col("read"), F.concat(F.substring("ref", 4, 20), F.substring("ref", 26, 10), F.lit("----"), F.substring("ref", 36, 15))).alias("cigar"))


def _repeats(spark, d):
    start = (F.col("l_partkey") % 400).cast("long")
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("contig"), F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("name"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def _targets(spark, d):
    return _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("target_id"), F.col("r_regionkey").cast("long").alias("contig"), (F.col("r_regionkey") * 50).cast("long").alias("start"), (F.col("r_regionkey") * 50 + 120).cast("long").alias("end"))


def s21(spark, d):
    return D.mask_in_target(_repeats(spark, d), _targets(spark, d))


def s22(spark, d):
    return D.repeats_from_target(_repeats(spark, d), _targets(spark, d))


def a12(spark, d):
    reads = _repeats(spark, d).withColumnRenamed("name", "read").withColumn("mismatches", F.col("end") % 3)
    return D.multimapping_reads(reads, _targets(spark, d))


def a33(spark, d):
    bits, hashes = D.bloom_size(500, 0.01)
    return D.bloom_check(_t(spark, d, "customer").where("c_custkey % 3 = 0 and c_custkey <= 1500"), _t(spark, d, "customer"), "c_custkey", bits, hashes)


def _with_star(spark, d):
    return _records(spark, d).withColumn("contig", F.when(F.col("ordinal") % 11 == 0, "*").otherwise(F.col("contig")))


def r2(spark, d):
    return D.load_results(_with_star(spark, d)).select("qname", "mate", "mapper", "ordinal", "place")


def e6(spark, d):
    return D.read_clusters(D.load_results(_with_star(spark, d)), 300)


def e3(spark, d):
    """Places, mappers and acceptance of every read."""
    r = D.load_results(_with_star(spark, d))
    per = r.groupBy("qname").agg(F.count_distinct("contig", "pos").alias("locations"), F.array_join(F.array_sort(F.collect_set("mapper")), ",").alias("mapped_by"))
    state = A.curation_state(_log(spark, d)).groupBy("qname").agg(F.count("accepted").alias("accepted"), F.max("discarded").alias("discarded"))
    return per.join(state, "qname", "left").select("qname", "locations", "mapped_by", F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), F.coalesce("discarded", F.lit(False)).alias("discarded"))


def c23(spark, d):
    """Contig, position from 1 and end from 0 of each record."""
    return _records(spark, d).select("ordinal", "contig", (F.col("pos") + 1).alias("start"), (F.col("pos") + 100).alias("end"))


def f18(spark, d):
    """Items stand for records: orders with one odd and one even item of few mismatches on opposite strands."""
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qname"), (F.col("l_linenumber") % 2).alias("mate"), (F.col("l_partkey") % 8).alias("mismatches"), (F.col("l_suppkey") % 2 == 0).alias("strand"))
    return D.strict_confident(r)


_IT = """it AS (SELECT l_orderkey, row_number() OVER w - 1 AS i, least(CAST(l_quantity AS BIGINT), 40) AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, least(CAST(l_quantity AS BIGINT), 40))),
pr AS (SELECT l_orderkey, i, CAST(sum(q) OVER (PARTITION BY l_orderkey ORDER BY i) - q AS BIGINT) AS r0, CAST(sum(q) OVER (PARTITION BY l_orderkey ORDER BY i) AS BIGINT) AS r1, 40 * i AS g0, 40 * i + q AS g1 FROM it),
isl AS (SELECT *, sum(CASE WHEN was = g0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM (SELECT *, lag(g1) OVER (PARTITION BY l_orderkey ORDER BY i) AS was FROM pr)),
blk AS (SELECT l_orderkey, k, min(r0) AS r0, max(r1) AS r1, min(g0) AS g0, max(g1) AS g1 FROM isl GROUP BY l_orderkey, k)"""
_TX = "string_agg({0}0 || '-' || {0}1, ',' ORDER BY {1})"
_RP = "rp AS (SELECT l_suppkey % 7 AS contig, l_orderkey || '/' || l_linenumber AS name, l_partkey % 400 AS s, l_partkey % 400 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), tg AS (SELECT CAST(r_regionkey AS BIGINT) AS target_id, r_regionkey * 50 AS t0, r_regionkey * 50 + 120 AS t1 FROM region)"
_BLOOM = ", ".join(f"CAST('0x' || substr(md5(c_custkey || '/{i}'), 1, 8) AS BIGINT) % {{bits}}" for i in range(7))
_LD = "st AS (SELECT * REPLACE (CASE WHEN ordinal % 11 = 0 THEN '*' ELSE contig END AS contig) FROM rec), ld AS (SELECT * FROM st WHERE contig <> '*' QUALIFY row_number() OVER (PARTITION BY mapper, qname, contig, pos, detail, mate ORDER BY ordinal) = 1)"
_C11 = """WITH b AS (SELECT item_id, substring(text, 1, 60) AS rd, substring(translate(text, 'eu', 'ao'), 1, 60) AS rf FROM benchmark WHERE length(text) >= 60),
p AS (SELECT item_id, seg, k, CASE WHEN substring(rd, k, 1) = substring(rf, k, 1) THEN '=' ELSE 'X' END AS o FROM b, (SELECT 1 AS seg, unnest(range(4, 24)) AS k UNION ALL SELECT 2, unnest(range(26, 36)) UNION ALL SELECT 3, unnest(range(36, 51))) u),
g AS (SELECT *, sum(n) OVER (PARTITION BY item_id, seg ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(o) OVER (PARTITION BY item_id, seg ORDER BY k) = o THEN 0 ELSE 1 END AS n FROM p)),
r AS (SELECT item_id, seg, run, count(*) || any_value(o) AS t FROM g GROUP BY ALL), s AS (SELECT item_id, seg, string_agg(t, '' ORDER BY run) AS t FROM r GROUP BY ALL)
SELECT item_id, '3S' || max(t) FILTER (seg = 1) || '2I' || max(t) FILTER (seg = 2) || '4D' || max(t) FILTER (seg = 3) AS cigar FROM s GROUP BY item_id"""
_V9 = "v AS (SELECT l_orderkey, l_partkey % 97 AS s FROM lineitem), b AS (SELECT l_orderkey, min(s) AS f, max(s) AS l FROM v GROUP BY 1)"

QUERIES = {
    "C15_region_predicates": (c15, 'WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 40 AS s, l_linenumber * 40 + CAST(l_quantity AS BIGINT) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, e - s AS length, s <= 100 AND 130 <= e AS contains, 100 < s AND s < 130 AND 130 <= e AS "left", s <= 100 AND 100 < e AND e < 130 AS "right" FROM r'),
    "W3_merge_pairs": (w3, f"WITH {_IT} SELECT l_orderkey, '0-' || max(r1) AS read, {_TX.format('g', 'k')} AS genome FROM blk GROUP BY l_orderkey"),
    "W6_normalize_pairs": (w6, f"WITH {_IT} SELECT l_orderkey, {_TX.format('r', 'k')} AS read, {_TX.format('g', 'k')} AS genome FROM blk GROUP BY l_orderkey"),
    "R9_end_introns": (r9, f"WITH {_V9} SELECT l_orderkey, string_agg(s || '-' || (s + 15), ',' ORDER BY s) FILTER (s < f + 15) AS first, string_agg(s || '-' || (s + 15), ',' ORDER BY s) FILTER (s + 15 > l) AS last FROM v JOIN b USING (l_orderkey) GROUP BY l_orderkey"),
    "R10_anchor_mismatches": (r10, "SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey % 200 AS VARCHAR), ',' ORDER BY l_partkey % 200) FILTER (l_partkey % 200 >= 60 AND l_partkey % 200 < 130), '') AS inside FROM lineitem GROUP BY 1"),
    "R11_equal_paddings": (r11, "WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber % 2 AS side, l_suppkey % 5 AS p FROM lineitem), b AS (SELECT l_orderkey, p FROM x GROUP BY ALL HAVING count(*) = 2) SELECT o.l_orderkey, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') AS paddings FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN b USING (l_orderkey) GROUP BY 1"),
    "R12_insert_apart": (r12, f"WITH {_IT} SELECT l_orderkey, CASE WHEN bool_or(g0 < 40 AND 35 < g1) THEN 'overlap' ELSE string_agg(g0 || '-' || g1, ',' ORDER BY g0) END AS genome FROM (SELECT l_orderkey, g0, g1 FROM pr UNION ALL SELECT DISTINCT l_orderkey, 35, 40 FROM pr WHERE l_orderkey NOT IN (SELECT l_orderkey FROM pr WHERE g0 < 40 AND 35 < g1)) GROUP BY 1".replace("bool_or(g0 < 40 AND 35 < g1)", "bool_or(g0 < 40 AND 35 < g1 AND g0 <> 35)")),
    "R19_reverse_regions": (r19, f"WITH {_IT} SELECT l_orderkey, {_TX.format('r', 'i DESC')} AS read, {_TX.format('g', 'i DESC')} AS genome FROM pr GROUP BY l_orderkey"),
    "U8_distinct_paths": (u8, f"WITH {_IT} SELECT DISTINCT path FROM (SELECT l_orderkey, {_TX.format('g', 'i')} AS path FROM pr GROUP BY 1)"),
    "C11_detailed_cigar": (c11, _C11),
    "S21_target_mask": (s21, f'WITH {_RP} SELECT target_id, name, s - t0 AS start, e - t0 AS "end", t1 - e AS mirrored_start, t1 - s AS mirrored_end FROM rp JOIN tg ON contig = target_id WHERE s >= t0 AND e <= t1'),
    "S22_repeats_of_targets": (s22, f'WITH {_RP} SELECT target_id, name, s AS start, e AS "end" FROM rp JOIN tg ON contig = target_id WHERE t0 <= s AND s < t1'),
    "A12_multimapping_reads": (a12, f"WITH {_RP} SELECT DISTINCT name AS read FROM rp JOIN tg ON contig = target_id WHERE s < t1 AND t0 < e AND e % 3 >= 1"),
    "A33_bloom_filter": (a33, f"WITH x AS (SELECT c_custkey, unnest(list_distinct([{_BLOOM.format(bits=4793)}])) AS bit FROM customer), k AS (SELECT DISTINCT bit FROM x WHERE c_custkey % 3 = 0 AND c_custkey <= 1500) SELECT c_custkey, count(*) FILTER (k.bit IS NULL) = 0 AS maybe FROM x LEFT JOIN k USING (bit) GROUP BY c_custkey"),
    "R2_load_results": (r2, f"WITH {_REC}, {_LD} SELECT qname, CAST(mate AS INT) AS mate, mapper, ordinal, row_number() OVER (PARTITION BY qname, mate ORDER BY ordinal) AS place FROM ld"),
    "E6_read_clusters": (e6, f'WITH {_REC}, {_LD}, m AS (SELECT *, CASE WHEN pos < lag(pos) OVER w + 300 THEN 0 ELSE 1 END AS n FROM ld WINDOW w AS (PARTITION BY qname, contig ORDER BY pos, ordinal)), c AS (SELECT *, sum(n) OVER (PARTITION BY qname, contig ORDER BY pos, ordinal) AS k FROM m) SELECT qname, contig, min(pos) AS start, max(pos) + 300 AS "end", count(*) AS records FROM c GROUP BY qname, contig, k'),
    "E3_read_details": (e3, f"WITH {_REC}, {_LD.replace('st AS', 'sr AS').replace('FROM st', 'FROM sr')}, {_LOG}, p AS (SELECT qname, count(DISTINCT (contig, pos)) AS locations, string_agg(DISTINCT mapper, ',' ORDER BY mapper) AS mapped_by FROM ld GROUP BY qname) SELECT qname, locations, mapped_by, coalesce(mates, 0) AS accepted, coalesce(discarded, FALSE) AS discarded FROM p LEFT JOIN pq USING (qname)"),
    "C23_genomic_interval": (c23, f'WITH {_REC} SELECT ordinal, contig, pos + 1 AS start, pos + 100 AS "end" FROM rec'),
    "F18_strict_confident": (f18, "SELECT l_orderkey AS qname FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 2 = 0) = 1 AND count(*) FILTER (l_linenumber % 2 = 1) = 1 AND max(l_partkey % 8) < 6 AND bool_or(l_suppkey % 2 = 0) FILTER (l_linenumber % 2 = 0) <> bool_or(l_suppkey % 2 = 0) FILTER (l_linenumber % 2 = 1)"),
}
