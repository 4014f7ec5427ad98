"""Queries of the scalar and region functions over lineitem, orders, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.functions import scalars as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d):
    """Line items with a CIGAR string built from their numbers."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    text = F.concat(n, F.lit("S"), q, F.lit("="), n, F.lit("X"), q, F.lit("M2I"), q, F.lit("N"), n, F.lit("=3D"), q, F.lit("M"))
    pos = (F.col("l_partkey") % 1000).cast("long")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cigar"), pos.alias("pos"), "l_quantity")


def _vectors(spark, d):
    """A region vector for each order: its items as [40 n, 40 n + quantity), n from the line number."""
    start = (F.col("l_linenumber") * 40).cast("long")
    r = R.region(start, start + F.col("l_quantity").cast("long"))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(r)).alias("v"))


def c1(spark, d):
    letters = F.regexp_replace(F.upper(F.col("text")), "[^ACGTN]", "")
    return _t(spark, d, "benchmark").select("item_id", S.reverse_complement(letters).alias("rc"))


def c2(spark, d):
    return _t(spark, d, "benchmark").select("item_id", S.reverse_complement_acgt(F.upper(F.col("text"))).alias("rc"))


def c3(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.reverse("text").alias("reversed"))


def c4(spark, d):
    fw = F.col("l_suppkey") % 2 == 0
    donor, acceptor = F.get(F.array(*[F.lit(x) for x in ("GT", "GC", "AT", "CT", "AG", "AC")]), (F.col("l_orderkey") % 6).cast("int")), F.get(F.array(*[F.lit(x) for x in ("AG", "AC", "GC", "AT", "GT", "CT")]), (F.col("l_partkey") % 6).cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.splice_score(donor, acceptor, fw).alias("score"))


def c5(spark, d):
    ops = S.cigar(F.col("cigar"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.size(ops).alias("n_ops"), S.cigar_string(ops).alias("cigar"))


def c6(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.cigar_string(S.collapse(S.cigar(F.col("cigar")))).alias("uniform"))


def c7(spark, d):
    ops = S.cigar(F.col("cigar"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.ops_length(ops, S.MATCH_OPS).alias("matched"), S.ops_length(ops, "X").alias("mismatches"), S.ops_length(ops, "N").alias("gap_length"), S.ops_count(ops, "N").alias("n_gaps"))


def c8(spark, d):
    ops = S.cigar(F.col("cigar"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.ops_length(ops, S.READ_OPS).alias("read_bases"), S.ops_length(ops, S.REFERENCE_OPS).alias("reference_bases"))


def c12(spark, d):
    v = F.col("v")  # a column of its own, so that it is computed once
    lines = _lines(spark, d).withColumn("v", R.from_cigar(F.col("pos"), S.cigar(F.col("cigar"))))
    return lines.select("l_orderkey", "l_linenumber", R.text(v["read"]).alias("read_regions"), R.text(v["genome"]).alias("genome_regions"))


def c13(spark, d):
    flag = (F.col("l_orderkey") % 4096).cast("int")
    row = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"))
    return row.select("l_orderkey", "l_linenumber", *[S.has_flag(F.col("flag"), n).alias(n) for n in S.FLAGS], S.set_flag(F.col("flag"), "reverse", F.col("l_linenumber") % 2 == 0).alias("turned"))


def c14(spark, d):
    i = F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", S.is_forward(i).alias("forward"), S.mirror_index(i).alias("mirror"))


def c16(spark, d):
    s = F.concat(F.lit("chr"), (F.col("o_custkey") % 23).cast("string"), F.lit(":"), (F.col("o_custkey") % 500).cast("string"), F.lit("-"), (F.col("o_orderkey") % 700).cast("string"))
    r = S.region_string(s)
    return _t(spark, d, "orders").where(r.isNotNull()).select("o_orderkey", r["contig"].alias("contig"), r["start"].alias("start"), r["end"].alias("end"))


def c17(spark, d):
    p = S.pack(F.col("o_custkey"), F.col("o_orderkey") % 536870912)
    return _t(spark, d, "orders").select("o_orderkey", p.alias("packed"), S.unpack_index(p).alias("index"), S.unpack_value(p).alias("value"))


def c18(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", S.duration(F.col("o_orderkey") * 1_000_000_000).alias("took"))


def c19(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


def c22(spark, d):
    return _t(spark, d, "events").select("event_id", F.concat_ws("::", "event_type", F.col("user_id").cast("string")).alias("key"))


def f10(spark, d):
    v = R.length(F.col("v"))
    return _vectors(spark, d).where(v >= 70).select("l_orderkey", v.alias("mapped"))


def f11(spark, d):
    return _vectors(spark, d).select("l_orderkey", R.valid_gaps(F.col("v"), 60, 4).alias("valid"))


def f13(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    code = S.target_overlap(F.col("o_orderpriority"), day, day + 400, F.lit("1-URGENT"), F.lit(9800), F.lit(10150))
    return _t(spark, d, "orders").select("o_orderkey", code.alias("code"))


def f14(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return _t(spark, d, "orders").select("o_orderkey", ((F.col("o_orderpriority") == "1-URGENT") & (day >= 9800) & (day + 30 <= 10500)).alias("inside"))


def f16(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.mismatch_budget(F.col("n_chars")).alias("budget"), S.mismatch_budget(F.col("n_chars"), 7).alias("fixed"))


def f17(spark, d):
    return _vectors(spark, d).select("l_orderkey", R.long_anchors(F.col("v"), 20).alias("long"))


def w7(spark, d):
    return _vectors(spark, d).select("l_orderkey", R.text(R.merge(F.col("v"))).alias("merged"))


def w10(spark, d):
    v = F.col("v")
    g = R.nth_gap(v, 0)
    return _vectors(spark, d).select("l_orderkey", R.has_gaps(v).alias("has_gaps"), F.coalesce(g["start"], F.lit(-1)).alias("g_start"), F.coalesce(g["end"], F.lit(-1)).alias("g_end"), R.gap_index_after(v, F.lit(100)).alias("after"))


def w17(spark, d):
    v = F.col("v")
    return _vectors(spark, d).select("l_orderkey", R.size_left(v, F.lit(0)).alias("left"), R.size_right(v, F.lit(1)).alias("right"))


def w18(spark, d):
    return _vectors(spark, d).select("l_orderkey", R.region_of_base(F.col("v"), F.lit(60)).alias("region"))


def w20(spark, d):
    v = F.col("v")
    lines = _lines(spark, d).withColumn("v", R.from_cigar(F.col("pos"), S.cigar(F.col("cigar"))))
    return lines.select("l_orderkey", "l_linenumber", F.coalesce(R.lift(F.lit(12), v["read"], v["genome"]), F.lit(-1)).alias("at"))


def u3(spark, d):
    v = R.remove(F.col("v"), F.lit(60), F.lit(130))
    return _vectors(spark, d).select("l_orderkey", R.text(v).alias("left"))


def u5(spark, d):
    a, b = F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey")))
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.size(F.array_except(a, b)).alias("only_n"))


def u7(spark, d):
    return _t(spark, d, "part").select("p_brand").distinct()


def s10(spark, d):
    text = F.concat(F.lit('gene_id "G'), F.col("o_custkey").cast("string"), F.lit('"; transcript_id "T'), F.col("o_orderkey").cast("string"), F.lit('";'))
    return _t(spark, d, "orders").select("o_orderkey", S.attribute(text, "gene_id").alias("gene_id"), S.attribute(text, "transcript_id").alias("transcript_id"))


def s25(spark, d):
    return _t(spark, d, "benchmark").select("item_id", S.fasta_lines(F.regexp_replace("text", "\n", " ")).alias("lines"))


_VEC = "vec AS (SELECT l_orderkey, l_linenumber * 40 AS s, l_linenumber * 40 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
_CIG = "cg AS (SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS pos, CAST(l_quantity AS INT) AS q, l_linenumber AS n, concat(l_linenumber, 'S', CAST(l_quantity AS INT), '=', l_linenumber, 'X', CAST(l_quantity AS INT), 'M2I', CAST(l_quantity AS INT), 'N', l_linenumber, '=3D', CAST(l_quantity AS INT), 'M') AS cigar FROM lineitem)"
_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
_MERGED = """m1 AS (SELECT l_orderkey, s, e, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM vec),
m2 AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT l_orderkey, min(s) AS s, max(e) AS e FROM m2 GROUP BY l_orderkey, g)"""
_GAPS = "gp AS (SELECT l_orderkey, e AS gs, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS ge, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) - 1 AS i, s, e FROM vec)"

QUERIES = {
    "C1_reverse_complement": (c1, "SELECT item_id, reverse(translate(regexp_replace(upper(text), '[^ACGTN]', '', 'g'), 'ACGTN', 'TGCAN')) AS rc FROM benchmark"),
    "C2_reverse_complement_acgt": (c2, "SELECT item_id, reverse(translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'ACGT', 'TGCA')) AS rc FROM benchmark"),
    "C3_reverse": (c3, "SELECT item_id, reverse(text) AS reversed FROM benchmark"),
    "C4_splice_sites": (c4, "WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS fw, (['GT','GC','AT','CT','AG','AC'])[1 + l_orderkey % 6] || '/' || (['AG','AC','GC','AT','GT','CT'])[1 + l_partkey % 6] AS site FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN fw THEN CASE site WHEN 'GT/AG' THEN 0 WHEN 'GC/AG' THEN 1 WHEN 'AT/AC' THEN 1 ELSE 2 END ELSE CASE site WHEN 'CT/AC' THEN 0 WHEN 'CT/GC' THEN 1 WHEN 'GT/AT' THEN 1 ELSE 2 END END AS score FROM x"),
    "C5_parse_cigar": (c5, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, CAST(len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS INT) AS n_ops, cigar FROM cg"),
    "C6_uniform_cigar": (c6, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, concat(n, 'S', q + n + q, 'M2I', q, 'N', n, 'M3D', q, 'M') AS uniform FROM cg"),
    "C7_cigar_counts": (c7, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, CAST(3 * q + 2 * n AS INT) AS matched, CAST(n AS INT) AS mismatches, q AS gap_length, 1 AS n_gaps FROM cg"),
    "C8_cigar_consumption": (c8, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, CAST(3 * n + 3 * q + 2 AS INT) AS read_bases, CAST(2 * n + 4 * q + 3 AS INT) AS reference_bases FROM cg"),
    "C12_cigar_regions": (c12, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, concat(n, '-', n + q, ',', n + q, '-', 2 * n + q, ',', 2 * n + q, '-', 2 * n + 2 * q, ',', 2 * n + 2 * q + 2, '-', 3 * n + 2 * q + 2, ',', 3 * n + 2 * q + 2, '-', 3 * n + 3 * q + 2) AS read_regions, concat(pos, '-', pos + q, ',', pos + q, '-', pos + q + n, ',', pos + q + n, '-', pos + 2 * q + n, ',', pos + 3 * q + n, '-', pos + 3 * q + 2 * n, ',', pos + 3 * q + 2 * n + 3, '-', pos + 4 * q + 2 * n + 3) AS genome_regions FROM cg"),
    "C13_flags": (c13, "SELECT l_orderkey, l_linenumber, " + ", ".join(f"l_orderkey % 4096 & {b} = {b} AS {n}" for n, b in S.FLAGS.items()) + ", CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 4096 | 16 ELSE l_orderkey % 4096 & ~16 END AS INT) AS turned FROM lineitem"),
    "C14_strand_index": (c14, "SELECT o_orderkey, o_custkey % 2 = 0 AS forward, xor(o_custkey, 1) AS mirror FROM orders"),
    "C16_region_string": (c16, "SELECT o_orderkey, c AS contig, s AS start, e AS \"end\" FROM (SELECT o_orderkey, 'chr' || o_custkey % 23 AS c, o_custkey % 500 AS s, o_orderkey % 700 AS e, o_custkey % 500 < o_orderkey % 700 AS ok FROM orders) WHERE ok"),
    "C17_pack": (c17, "SELECT o_orderkey, (o_custkey << 29) | (o_orderkey % 536870912) AS packed, o_custkey AS \"index\", o_orderkey % 536870912 AS value FROM orders"),
    "C18_duration": (c18, "SELECT o_orderkey, printf('%02dh %02dm %02ds', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60) AS took FROM orders"),
    "C19_array_text": (c19, "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey"),
    "C22_read_key": (c22, "SELECT event_id, event_type || '::' || user_id AS key FROM events"),
    "F10_length_rules": (f10, f"WITH {_VEC} SELECT l_orderkey, CAST(sum(e - s) AS BIGINT) AS mapped FROM vec GROUP BY l_orderkey HAVING sum(e - s) >= 70"),
    "F11_valid_maps": (f11, f"WITH {_VEC}, {_GAPS} SELECT l_orderkey, count(*) FILTER (ge > gs) <= 4 AND coalesce(max(ge - gs), 0) <= 60 AS valid FROM gp GROUP BY l_orderkey"),
    "F13_target_overlap": (f13, f"SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN 0 WHEN d < 9800 AND d + 400 > 10150 THEN 4 WHEN d >= 9800 AND d + 400 <= 10150 THEN 1 WHEN d < 9800 AND d + 400 > 9800 THEN 2 WHEN d < 10150 AND d + 400 > 10150 THEN 3 ELSE -1 END AS code FROM (SELECT *, {_DAY} AS d FROM orders)"),
    "F14_contained_in_target": (f14, f"SELECT o_orderkey, o_orderpriority = '1-URGENT' AND {_DAY} >= 9800 AND {_DAY} + 30 <= 10500 AS inside FROM orders"),
    "F16_mismatch_budget": (f16, "SELECT doc_id, CAST(floor(n_chars * 0.1::DOUBLE) AS INT) AS budget, 7 AS fixed FROM documents"),
    "F17_long_anchors": (f17, f"WITH {_VEC} SELECT l_orderkey, min(e - s) >= 20 AS long FROM vec GROUP BY l_orderkey"),
    "W7_alignment_blocks": (w7, f"WITH {_VEC}, {_MERGED} SELECT l_orderkey, string_agg(s || '-' || e, ',' ORDER BY s) AS merged FROM m3 GROUP BY l_orderkey"),
    "W10_gap_lookup": (w10, f"WITH {_VEC}, {_GAPS} SELECT l_orderkey, coalesce(bool_or(ge > gs), FALSE) AS has_gaps, coalesce(arg_min(gs, i) FILTER (ge > gs), -1) AS g_start, coalesce(arg_min(ge, i) FILTER (ge > gs), -1) AS g_end, CAST(coalesce(min(i) FILTER (gs > 100 AND ge > gs), -1) AS INT) AS after FROM gp GROUP BY l_orderkey"),
    "W17_sizes": (w17, f"WITH {_VEC}, {_GAPS} SELECT l_orderkey, CAST(sum(e - s) FILTER (i = 0) AS BIGINT) AS \"left\", CAST(coalesce(sum(e - s) FILTER (i >= 1), 0) AS BIGINT) AS \"right\" FROM gp GROUP BY l_orderkey"),
    "W18_region_of_base": (w18, f"WITH {_VEC}, {_GAPS}, r AS (SELECT l_orderkey, i, sum(e - s) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM gp) SELECT l_orderkey, CAST(coalesce(min(i) FILTER (run > 60), -1) AS INT) AS region FROM r GROUP BY l_orderkey"),
    "W20_lift": (w20, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, CASE WHEN 12 < n THEN -1 WHEN 12 < 2 * n + 2 * q THEN pos + 12 - n WHEN 12 < 2 * n + 2 * q + 2 THEN -1 WHEN 12 < 3 * n + 2 * q + 2 THEN pos + 3 * q + n + 12 - (2 * n + 2 * q + 2) WHEN 12 < 3 * n + 3 * q + 2 THEN pos + 3 * q + 2 * n + 3 + 12 - (3 * n + 2 * q + 2) ELSE -1 END AS at FROM cg"),
    "U3_remove_region": (u3, f"WITH {_VEC}, p AS (SELECT l_orderkey, s, least(e, 60) AS e FROM vec WHERE s < 60 UNION ALL SELECT l_orderkey, greatest(s, 130), e FROM vec WHERE e > 130), k AS (SELECT DISTINCT l_orderkey FROM vec) SELECT k.l_orderkey, coalesce(string_agg(s || '-' || e, ',' ORDER BY s, e) FILTER (e > s), '') AS \"left\" FROM k LEFT JOIN p USING (l_orderkey) GROUP BY k.l_orderkey"),
    "U5_except": (u5, "SELECT s.l_suppkey, CAST(count(DISTINCT n.l_partkey) AS INT) AS only_n FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N') n USING (l_suppkey) GROUP BY s.l_suppkey"),
    "U7_distinct_ids": (u7, "SELECT DISTINCT p_brand FROM part"),
    "S10_attribute": (s10, "SELECT o_orderkey, 'G' || o_custkey AS gene_id, 'T' || o_orderkey AS transcript_id FROM orders"),
    "S25_fasta_lines": (s25, r"SELECT item_id, regexp_replace(regexp_replace(replace(text, chr(10), ' '), '(.{60})', '\1' || chr(10), 'g'), chr(10) || '$', '') AS lines FROM benchmark"),
}
