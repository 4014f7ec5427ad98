"""Queries of the k-mer layer: benchmark passages are the reads, documents the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import kmers as K


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    # few files hold many k-mers: deal the texts out before they are multiplied
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return docs.repartition(max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return K.read_kmers(_t(spark, d, "benchmark"), "item_id", "text")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return K.seeds(_reads(spark, d), K.kmers(_docs(spark, d), "doc_id", "text"), "item_id", "doc_id")


def f1_read_kmers(spark, d):
    return _reads(spark, d)


def f2_target_kmers(spark, d):
    """Overlapping k-mers, as counts and checks for each document."""
    return K.kmers(_docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


def f3_target_kmers_small(spark, d):
    return K.kmers(_t(spark, d, "benchmark"), "item_id", "text", 5)


def j1_seeds(spark, d):
    return _hits(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))


def j2_kmer_lookup(spark, d):
    reads = _reads(spark, d)
    return reads.join(K.kmers(_docs(spark, d), "doc_id", "text").select("kmer"), "kmer", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("known"))


def a2_diagonals(spark, d):
    return K.diagonals(_hits(spark, d), "item_id", "doc_id").where("hits >= 3").select("item_id", "doc_id", "diag", "hits", "from_read", "to_read")


def a3_most_hits(spark, d):
    return K.most_hits(K.diagonals(_hits(spark, d), "item_id", "doc_id"), "item_id", "doc_id")


def w13_best_diagonal(spark, d):
    """Best diagonal of each (passage, document) that reaches the DNA threshold of seven hits."""
    best = K.best_diagonal(K.diagonals(_hits(spark, d), "item_id", "doc_id"), "item_id", "doc_id")
    return best.where("hits >= 7").select("item_id", "doc_id", "diag", "hits")


def f4_global_filter(spark, d):
    return K.global_filter(_hits(spark, d), "item_id", F.col("doc_id") % 2 == 0, 6)


def f5_bin_filter(spark, d):
    return K.bin_filter(_hits(spark, d).withColumn("pos", F.col("pos")), "item_id", 30, 2)


def f6_overlapping_bins(spark, d):
    return K.bin_filter(_hits(spark, d), "item_id", 30, 2, overlapping=True)


def f9_first_diagonal_span(spark, d):
    diags = K.diagonals(_hits(spark, d), "item_id", "doc_id").withColumn("span", F.col("to_read") - F.col("from_read"))
    return diags.where("span >= 50").select("item_id", "doc_id", "diag", "span")


def a1_kmer_counts(spark, d):
    return K.kmer_counts(_t(spark, d, "benchmark"), "item_id", "text")


def j3_occurrences(spark, d):
    asked = K.kmers(_t(spark, d, "benchmark"), "item_id", "text")
    counts = K.kmer_counts(_docs(spark, d), "doc_id", "text", only=asked)
    return K.occurrences(asked, counts).select("item_id", "pos", "count")


def a15_occurrence_weight(spark, d):
    at = j3_occurrences(spark, d)
    return at.groupBy("item_id").agg(F.round(K.harmonic_mean(F.col("count")), 6).alias("harmonic"), F.round(K.geometric_mean(F.col("count")), 6).alias("geometric"))


def a32_spread(spark, d):
    return K.spread(K.kmers(_t(spark, d, "benchmark"), "item_id", "text", 20), 50, "kmer", "item_id", "pos")


_HITS = """
rk AS (SELECT item_id, r AS rpos, substring(text, r + 1, 10) AS kmer FROM benchmark, unnest(range(0, greatest(length(text) - 9, 0), 10)) u(r)),
rset AS (SELECT DISTINCT kmer FROM rk),
tk AS (SELECT doc_id, p AS pos, substring(text, p + 1, 10) AS kmer FROM documents, unnest(range(0, greatest(length(text) - 9, 0))) u(p)),
tk2 AS (SELECT tk.* FROM tk SEMI JOIN rset USING (kmer)),
hits AS (SELECT item_id, doc_id, rpos, pos, pos - rpos AS diag FROM rk JOIN tk2 USING (kmer)),
diags AS (SELECT item_id, doc_id, diag, count(*) AS hits, min(rpos) AS from_read, max(rpos) + 10 AS to_read FROM hits GROUP BY ALL)
"""
_BK = "bk AS (SELECT item_id, p AS pos, substring(text, p + 1, {k}) AS kmer FROM benchmark, unnest(range(0, greatest(length(text) - {k} + 1, 0))) u(p))"

QUERIES = {
    "F1_read_kmers": (f1_read_kmers, f"WITH {_HITS} SELECT item_id, rpos, kmer FROM rk"),
    "F2_target_kmers": (f2_target_kmers, f"WITH {_HITS} SELECT doc_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, min(kmer) AS first_kmer, max(kmer) AS last_kmer FROM tk GROUP BY doc_id"),
    "F3_target_kmers_small": (f3_target_kmers_small, f"WITH {_BK.format(k=5)} SELECT * FROM bk"),
    "J1_seeds": (j1_seeds, f"WITH {_HITS} SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits GROUP BY item_id"),
    "J2_kmer_lookup": (j2_kmer_lookup, f"WITH {_HITS} SELECT item_id, count(*) AS known FROM rk WHERE kmer IN (SELECT kmer FROM tk2) GROUP BY item_id"),
    "A2_diagonals": (a2_diagonals, f"WITH {_HITS} SELECT * FROM diags WHERE hits >= 3"),
    "A3_most_hits": (a3_most_hits, f"WITH {_HITS} SELECT doc_id, max(hits) AS max_hits, count(DISTINCT item_id) AS reads FROM diags GROUP BY doc_id"),
    "W13_best_diagonal": (w13_best_diagonal, f"WITH {_HITS} SELECT item_id, doc_id, diag, hits FROM diags QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC, diag) = 1 AND hits >= 7"),
    "F4_global_filter": (f4_global_filter, f"WITH {_HITS}, c AS (SELECT item_id, count(DISTINCT rpos) FILTER (doc_id % 2 = 0) AS first_hits, count(DISTINCT rpos) FILTER (doc_id % 2 <> 0) AS other_hits FROM hits GROUP BY item_id) SELECT *, first_hits >= 6 OR other_hits >= 6 AS keep FROM c"),
    "F5_bin_filter": (f5_bin_filter, f"WITH {_HITS}, b AS (SELECT item_id, pos // 30 AS bin, count(*) AS n FROM hits GROUP BY ALL) SELECT item_id, max(n) AS most, max(n) >= 2 AS keep FROM b GROUP BY item_id"),
    "F6_overlapping_bins": (f6_overlapping_bins, f"WITH {_HITS}, b AS (SELECT item_id, 0 AS g, pos // 30 AS bin, count(*) AS n FROM hits GROUP BY ALL UNION ALL SELECT item_id, 1, (pos + 15) // 30, count(*) FROM hits GROUP BY ALL) SELECT item_id, max(n) AS most, max(n) >= 2 AS keep FROM b GROUP BY item_id"),
    "F9_first_diagonal_span": (f9_first_diagonal_span, f"WITH {_HITS} SELECT item_id, doc_id, diag, to_read - from_read AS span FROM diags WHERE to_read - from_read >= 50"),
    "A1_kmer_counts": (a1_kmer_counts, f"WITH {_BK.format(k=10)} SELECT kmer, count(*) AS count FROM bk GROUP BY kmer"),
    "J3_occurrences": (j3_occurrences, f"WITH {_HITS}, {_BK.format(k=10)}, c AS (SELECT kmer, count(*) AS n FROM tk WHERE kmer IN (SELECT kmer FROM bk) GROUP BY kmer) SELECT item_id, pos, coalesce(n, 1) AS count FROM bk LEFT JOIN c USING (kmer)"),
    "A15_occurrence_weight": (a15_occurrence_weight, f"WITH {_HITS}, {_BK.format(k=10)}, c AS (SELECT kmer, count(*) AS n FROM tk WHERE kmer IN (SELECT kmer FROM bk) GROUP BY kmer), o AS (SELECT item_id, coalesce(n, 1) AS n FROM bk LEFT JOIN c USING (kmer)) SELECT item_id, round(count(*) / sum(1.0 / n::DOUBLE), 6) AS harmonic, round(exp(avg(ln(n))), 6) AS geometric FROM o GROUP BY item_id"),
    "A32_spread": (a32_spread, f"WITH {_BK.format(k=20)} SELECT kmer, count(DISTINCT (item_id, pos // 50)) AS bins FROM bk GROUP BY kmer"),
}
