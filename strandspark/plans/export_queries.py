"""Queries of the exports and of the remaining small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.operators import exports as X
from strandspark.operators import intervals as I
from strandspark.operators import kmers as K


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark, d):
    o = _t(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select((F.col("o_custkey") % 100).alias("qname"), (F.col("o_orderkey") % 2).alias("mate"), F.col("o_orderpriority").alias("mapper"), F.col("o_orderstatus").alias("contig"), day.alias("start"), (day + 20).alias("end"), day.alias("pos"), F.col("o_orderkey").alias("ordinal"))


def w23(spark, d):
    return X.read_groups(_records(spark, d)).select("qname", "contig", "start", "end")


def e4(spark, d):
    r = _records(spark, d)
    return X.mapped_by(r, r.select("mapper").distinct())


def r1(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("qname"), (F.col("turn") % 2).alias("mate"), F.col("text").alias("seq"), "turn")
    return X.first_reads(c, "turn").select("qname", "mate", F.length("seq").alias("n"), "paired")


def _state(spark, d):
    return _t(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("qname")).agg((F.min("o_orderkey") % 3).cast("int").alias("mates"), (F.max("o_orderkey") % 5 == 0).alias("discarded"))


def f12(spark, d):
    return X.combined(_records(spark, d), _state(spark, d), "F", 9000, 10500).select("ordinal")


def s41(spark, d):
    return X.group_line(_records(spark, d), ["qname", "contig", "mate"], F.col("ordinal")).select("qname", "contig", "mate", "first", F.replace("tags", F.lit("\t"), F.lit(" ")).alias("tags"))


def w21(spark, d):
    """Gaps of [0, q) and [40, 40 + q) that the mapped region [30, 36) leaves free."""
    q = F.col("l_quantity").cast("long")
    read = F.array(R.region(F.lit(0), F.least(q, F.lit(38))), R.region(F.lit(40), 40 + q))
    genome = F.array(R.region(F.lit(900), F.least(q, F.lit(38)) + 900), R.region(F.lit(940), 940 + q))
    free = R.diagonal_gaps(read, genome, F.array(R.region(F.lit(30), F.lit(36))), F.array(R.region(F.lit(2000), F.lit(2010))))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(free).alias("gaps"), F.coalesce(F.get(free, F.lit(0))["read"]["start"], F.lit(-1)).alias("start"))


def j26(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def j28(spark, d):
    """Exact occurrences of whole passages: seeds by the first k-mer, then the whole pattern is compared."""
    pattern = _t(spark, d, "benchmark").where(F.length("text") >= K.K).select("item_id", F.col("text").alias("pattern"), F.substring("text", 1, K.K).alias("kmer"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    few = pattern.limit(K.BROADCAST_KMERS + 1).count() <= K.BROADCAST_KMERS
    heads = pattern.select("item_id", "kmer")
    found = K.kmers(docs.repartition(spark.sparkContext.defaultParallelism), "doc_id", "text").join(F.broadcast(heads) if few else heads, "kmer")
    both = found.select("item_id", "doc_id", "pos").join(docs, "doc_id").join(pattern.select("item_id", "pattern"), "item_id")
    same = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.length("pattern")) == F.col("pattern")
    return both.where(same).select("item_id", "doc_id", "pos")


def u6(spark, d):
    """Postings of two target sets united, the second's indices moved behind the first's."""
    a = K.read_kmers(_t(spark, d, "region"), "r_regionkey", "r_name", 3).select(F.col("r_regionkey").cast("long").alias("seq_index"), "rpos", "kmer")
    b = K.read_kmers(_t(spark, d, "nation"), "n_nationkey", "n_name", 3).select((F.col("n_nationkey") + 5).cast("long").alias("seq_index"), "rpos", "kmer")
    return a.unionByName(b)


def a13(spark, d):
    q = (F.col("l_partkey") % 9).cast("long")
    return _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(K.harmonic_mean(q), 6).alias("harmonic"))


def a14(spark, d):
    q = (F.col("l_partkey") % 9).cast("long")
    return _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(K.geometric_mean(q), 6).alias("geometric"))


def a10(spark, d):
    """Depth by strand."""
    r = _records(spark, d).withColumn("strand", F.col("mate"))
    return I.coverage(r, ["contig", "strand"]).select("contig", "strand", "start", "end", "depth")


def f20(spark, d):
    return _t(spark, d, "documents").where(F.col("doc_id") == 7).select("doc_id", "n_chars")


def o1(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("sorted"))


_REC = "rec AS (SELECT o_custkey % 100 AS qname, o_orderkey % 2 AS mate, o_orderpriority AS mapper, o_orderstatus AS contig, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, o_orderkey AS ordinal FROM orders)"

QUERIES = {
    "W23_read_groups": (w23, f'WITH {_REC}, a AS (SELECT qname, contig, s - 500 AS s, s + 520 AS e FROM rec), m1 AS (SELECT *, max(e) OVER (PARTITION BY qname, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM a), m2 AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY qname, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1) SELECT qname, contig, min(s) AS start, max(e) AS "end" FROM m2 GROUP BY qname, contig, g'),
    "E4_mapped_by": (e4, f"WITH {_REC} SELECT k.qname, k.mate, m.mapper, EXISTS (SELECT 1 FROM rec r WHERE r.qname = k.qname AND r.mate = k.mate AND r.mapper = m.mapper) AS mapped FROM (SELECT DISTINCT qname, mate FROM rec) k, (SELECT DISTINCT mapper FROM rec) m"),
    "R1_read_info": (r1, "WITH x AS (SELECT conv_id AS qname, turn % 2 AS mate, arg_min(text, turn) FILTER (length(text) > 0) AS seq FROM conversations GROUP BY ALL) SELECT qname, mate, CAST(length(seq) AS INT) AS n, count(*) OVER (PARTITION BY qname) > 1 AS paired FROM x"),
    "F12_combined_filter": (f12, f"WITH {_REC}, st AS (SELECT o_custkey % 100 AS qname, min(o_orderkey) % 3 AS mates, max(o_orderkey) % 5 = 0 AS discarded FROM orders GROUP BY 1) SELECT ordinal FROM rec JOIN st USING (qname) WHERE contig = 'F' AND s >= 9000 AND s < 10500 AND mates < 2 AND NOT discarded"),
    "S41_group_lines": (s41, f"WITH {_REC} SELECT qname, contig, mate, min(ordinal) AS first, 'XM:Z:' || string_agg(DISTINCT mapper, ',' ORDER BY mapper) || ' XI:Z:' || string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS tags FROM rec GROUP BY qname, contig, mate"),
    "W21_diagonal_gaps": (w21, "WITH x AS (SELECT l_orderkey, l_linenumber, least(CAST(l_quantity AS BIGINT), 38) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN q >= 36 THEN 1 ELSE 0 END AS INT) AS gaps, CASE WHEN q >= 36 THEN q ELSE -1 END AS start FROM x"),
    "J26_left_anti": (j26, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "J28_exact_pattern": (j28, "WITH p AS (SELECT item_id, text AS pattern, substring(text, 1, 10) AS kmer FROM benchmark WHERE length(text) >= 10), w AS (SELECT doc_id, i AS pos, substring(text, i + 1, 10) AS kmer FROM documents, unnest(range(0, greatest(length(text) - 9, 0))) u(i)), s AS (SELECT item_id, pattern, doc_id, pos FROM w JOIN p USING (kmer)) SELECT item_id, doc_id, pos FROM s JOIN documents USING (doc_id) WHERE substring(text, pos + 1, length(pattern)) = pattern"),
    "U6_union_postings": (u6, "SELECT r_regionkey AS seq_index, r AS rpos, substring(r_name, r + 1, 3) AS kmer FROM region, unnest(range(0, length(r_name) - 2, 3)) u(r) UNION ALL SELECT n_nationkey + 5, r, substring(n_name, r + 1, 3) FROM nation, unnest(range(0, length(n_name) - 2, 3)) u(r)"),
    "A13_harmonic_mean": (a13, "SELECT l_suppkey, l_linenumber, round(CASE WHEN min(l_partkey % 9) = 0 THEN 0 ELSE count(*) / sum(1.0::DOUBLE / nullif(l_partkey % 9, 0)) END, 6) AS harmonic FROM lineitem GROUP BY ALL"),
    "A14_geometric_mean": (a14, "SELECT l_suppkey, l_linenumber, round(CASE WHEN min(l_partkey % 9) = 0 THEN 0 ELSE exp(avg(ln(nullif(l_partkey % 9, 0)))) END, 6) AS geometric FROM lineitem GROUP BY ALL"),
    "A10_strand_coverage": (a10, f'WITH {_REC}, e2 AS (SELECT contig, mate, p, sum(d) AS d FROM (SELECT contig, mate, s AS p, 1 AS d FROM rec UNION ALL SELECT contig, mate, s + 20, -1 FROM rec) GROUP BY ALL), seg AS (SELECT contig, mate, p AS s, lead(p) OVER w AS e, CAST(sum(d) OVER (PARTITION BY contig, mate ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM e2 WINDOW w AS (PARTITION BY contig, mate ORDER BY p)), c AS (SELECT * FROM seg WHERE depth > 0 AND e IS NOT NULL), i AS (SELECT *, CASE WHEN lag(depth) OVER w = depth AND lag(e) OVER w = s THEN 0 ELSE 1 END AS nw FROM c WINDOW w AS (PARTITION BY contig, mate ORDER BY s)), i2 AS (SELECT *, sum(nw) OVER (PARTITION BY contig, mate ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM i) SELECT contig, mate AS strand, min(s) AS start, max(e) AS "end", max(depth) AS depth FROM i2 GROUP BY contig, mate, g'),
    "F20_debug_filter": (f20, "SELECT doc_id, n_chars FROM documents WHERE doc_id = 7"),
    "O1_sorted_regions": (o1, "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS sorted FROM lineitem GROUP BY l_orderkey"),
}
