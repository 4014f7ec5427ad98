"""Queries of target and transcript sequences, region equality and repaired introns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandspark.operators import loading as L
from strandspark.plans.detail_queries import _IT, _pairs, _t
from strandspark.plans.scalar_queries import _CIG, _lines

SMALL = "abcdefghijklmnopqrstuvwxyz"
#: Letters read as bases in M9.
LETTERS, BASES = "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC"


def _sequences(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("contig"), F.translate("text", SMALL, SMALL.upper()).alias("sequence"))


def _spans(spark, d):
    """Items stand for spans of documents, one after the other in an order."""
    start = F.col("l_linenumber").cast("long") * 60 + F.col("l_suppkey") % 20
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def s11(spark, d):
    x = L.transcript_sequences(_spans(spark, d).withColumnRenamed("l_orderkey", "transcript"), _sequences(spark, d))
    return x.select("transcript", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("md5"))


def r4(spark, d):
    letters = F.regexp_replace("sequence", "[^ACGT]", "")
    x = L.both_strands(_sequences(spark, d).select(F.col("contig").alias("target_id"), letters.alias("sequence")))
    return x.select("seq_index", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("md5"))


def r13(spark, d):
    return _pairs(spark, d).select("l_orderkey", (F.col("read") == F.col("genome")).alias("equal"))


def r14(spark, d):
    scores = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 3).alias("scores"))
    return scores.select("l_orderkey", L.has_unknown_splice_sites(F.col("scores")).alias("unknown"))


def r15(spark, d):
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat("cigar", F.lit("?"))).otherwise(F.col("cigar"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", L.uniform_cigar(text).alias("uniform"))


def m9(spark, d):
    """Spans stand for introns, and letters for bases; the spans of odd items have no splice site yet."""
    x = _spans(spark, d).withColumnRenamed("contig", "target")
    x = x.withColumns({"splice": F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(1), "forward": F.col("l_orderkey") % 2 == 0})
    bases = _sequences(spark, d).withColumn("sequence", F.translate("sequence", LETTERS, BASES))
    return L.repair_introns(x, bases).select("l_orderkey", "l_linenumber", "target", "start", "end", "splice")


_SP = f"""sp AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS contig, l_linenumber * 60 + l_suppkey % 20 AS s, l_linenumber * 60 + l_suppkey % 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
sq AS (SELECT doc_id AS contig, translate(text, '{SMALL}', '{SMALL.upper()}') AS t FROM documents)"""
_M9 = f"""WITH {_SP}, bs AS (SELECT contig, translate(t, '{LETTERS}', '{BASES}') AS t FROM sq), k(donor, acceptor, forward, score) AS (VALUES ('GT', 'AG', true, 2), ('GC', 'AG', true, 1), ('AT', 'AC', true, 1), ('CT', 'AC', false, 2), ('CT', 'GC', false, 1), ('GT', 'AT', false, 1)),
x AS (SELECT sp.*, i - 5 AS i, j - 5 AS j, score FROM sp JOIN bs USING (contig), range(0, 10) a(i), range(0, 10) b(j), k
  WHERE l_linenumber % 2 = 1 AND forward = (l_orderkey % 2 = 0) AND substring(t, s + i - 5 + 1, 2) = donor AND substring(t, e + j - 5 - 1, 2) = acceptor AND s + i - 5 < e + j - 5 - 1),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, contig, s, e ORDER BY i, j) = 1)
SELECT l_orderkey, l_linenumber, contig AS target, s + coalesce(i, 0) AS start, e + coalesce(j, 0) AS "end", CAST(coalesce(score, 1 - l_linenumber % 2) AS INT) AS splice
FROM sp LEFT JOIN f USING (l_orderkey, l_linenumber, contig, s, e)"""

QUERIES = {
    "S11_transcript_sequences": (s11, f"WITH {_SP}, x AS (SELECT l_orderkey AS transcript, coalesce(string_agg(substring(t, s + 1, e - s), '' ORDER BY s, e, contig), '') AS q FROM (SELECT DISTINCT l_orderkey, contig, s, e FROM sp) LEFT JOIN sq USING (contig) GROUP BY 1) SELECT transcript, length(q) AS n, md5(q) AS md5 FROM x"),
    "R4_both_strands": (r4, f"WITH {_SP}, x AS (SELECT contig, regexp_replace(t, '[^ACGT]', '', 'g') AS q FROM sq), y AS (SELECT 2 * contig AS seq_index, q FROM x UNION ALL SELECT 2 * contig + 1, reverse(translate(q, 'ACGT', 'TGCA')) FROM x) SELECT seq_index, length(q) AS n, md5(q) AS md5 FROM y"),
    "R13_equal_regions": (r13, f"WITH {_IT} SELECT l_orderkey, bool_and(r0 = g0 AND r1 = g1) AS equal FROM pr GROUP BY 1"),
    "R14_unknown_splice_sites": (r14, "SELECT l_orderkey, max(l_partkey % 3) > 0 AS unknown FROM lineitem GROUP BY 1"),
    "R15_uniform_or_na": (r15, f"WITH {_CIG} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'NA' ELSE concat(n, 'S', q + n + q, 'M2I', q, 'N', n, 'M3D', q, 'M') END AS uniform FROM cg"),
    "M9_repaired_introns": (m9, _M9),
}
