"""Queries of mates, pairings, embeddings and gap evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.operators import embedding as E
from strandspark.operators import introns as N


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mate(spark, d, mate):
    """Every two turns of a conversation are the mates of a read."""
    c = _t(spark, d, "conversations").where(F.col("turn") % 2 == mate)
    return c.select(F.col("conv_id"), F.expr("turn div 2").alias("read_ord"), F.col("text").alias("seq"))


def j30(spark, d):
    """Mates joined by ordinal."""
    a, b = _mate(spark, d, 0), _mate(spark, d, 1).withColumnRenamed("seq", "seq2")
    return a.join(b, ["conv_id", "read_ord"]).select("conv_id", "read_ord", F.length("seq").alias("n1"), F.length("seq2").alias("n2"))


def f8(spark, d):
    """Pairs of which both mates are long enough; a missing mate passes."""
    a, b = _mate(spark, d, 0), _mate(spark, d, 1).withColumnRenamed("seq", "seq2")
    return a.join(b, ["conv_id", "read_ord"], "left").where("length(seq) >= 40 and (seq2 is null or length(seq2) >= 40)").select("conv_id", "read_ord")


def j17(spark, d):
    """Alignments of both mates brought together by target (index div 2), each side kept."""
    c = _t(spark, d, "conversations").select("conv_id", (F.col("turn") / 2).cast("long").alias("target"), (F.col("turn") % 2).alias("side"), F.length("text").alias("n"))
    fw, rv = c.where("side = 0").select("conv_id", "target", F.col("n").alias("fw")), c.where("side = 1").select("conv_id", "target", F.col("n").alias("rv"))
    return fw.join(rv, ["conv_id", "target"], "full").select("conv_id", "target", F.coalesce("fw", F.lit(-1)).alias("fw"), F.coalesce("rv", F.lit(-1)).alias("rv"))


def j18(spark, d):
    """The pair of user and assistant turns of least summed length, adjacent ones only; first by turn."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t1"), F.col("n").alias("n1"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t2"), F.col("n").alias("n2"))
    cost = F.when(F.abs(F.col("t1") - F.col("t2")) == 1, F.col("n1") + F.col("n2")).otherwise(1 << 30)
    return N.best_pairs(a, b, ["conv_id"], cost, [F.col("t1"), F.col("t2")]).where(F.col("cost") < 1 << 30).select("conv_id", "t1", "t2", "cost")


def j19(spark, d):
    """The first target with a combination."""
    return j18(spark, d).withColumn("target", (F.col("t1") / 2).cast("long")).groupBy("conv_id").agg(F.min("target").alias("target"))


def j20(spark, d):
    """All pairings of the two mates' alignments, within a pair."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    a, b = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t1")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t2"))
    return a.join(b, "conv_id")


def j21(spark, d):
    """Product of three paddings a gap."""
    pads = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return _t(spark, d, "region").select("r_regionkey", F.explode(pads).alias("left")).select("r_regionkey", "left", F.explode(pads).alias("right"))


def _gaps(spark, d):
    c = F.col
    return _t(spark, d, "lineitem").select((c("l_suppkey") % 7).cast("int").alias("target_id"), (c("l_partkey") % 50).cast("long").alias("start"), (c("l_partkey") % 50 + 20 + c("l_linenumber")).cast("long").alias("end"), (c("l_orderkey") % 3).cast("int").alias("splice"), (c("l_orderkey") % 2 == 0).alias("plus"))


def a5(spark, d):
    return N.gap_evidence(_gaps(spark, d)).select("target_id", "start", "end", "splice", "evidence")


def a6(spark, d):
    return N.cluster_gaps(N.gap_evidence(_gaps(spark, d)), 100)


def a7(spark, d):
    return N.preferred_strand(_gaps(spark, d)).select("target_id", "strand", F.round("confidence", 6).alias("confidence"))


def a8(spark, d):
    return _gaps(spark, d).select("target_id", (1000 - F.col("end")).alias("start"), (1000 - F.col("start")).alias("end")).distinct()


def a29(spark, d):
    l = _t(spark, d, "lineitem")
    return l.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("mismatches"), F.sum(F.col("l_quantity").cast("long")).alias("bases"), F.round(F.sum("l_linenumber") / F.sum(F.col("l_quantity").cast("long")), 6).alias("share"))


def a28(spark, d):
    o = _t(spark, d, "orders").groupBy().agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("mapped"))
    return o.select("total", "mapped", F.round(100.0 * F.col("mapped") / F.col("total"), 2).alias("percent"))


def a35(spark, d):
    """Nearest vector of another label for each vector whose id is divisible by 50, against all."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    near = E.nearest(e.where("id % 50 = 0"), e)
    return near.groupBy("q_id").agg(F.round(F.min("dist"), 4).alias("dist"))


def a36(spark, d):
    e = _t(spark, d, "embeddings")
    return E.centroids(e, "label", "embedding").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 4).alias("mean"))


def a36_components(spark, d):
    return E.principal_components(E.centroids(_t(spark, d, "embeddings"), "label", "embedding"), "label")


def a34(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("mapper"), F.col("user_id").cast("string").alias("qname"), (F.col("event_id") % 3).cast("string").alias("contig"), (F.col("event_id") % 1000 + 1).alias("pos"), F.col("event_id").alias("ordinal"))
    return E.record_embedding(e).select("ordinal", "mapper", "read_no", "contig_no", F.round("place", 6).alias("place"))


def w15(spark, d):
    """Best split of each order: prefix cost from the left plus suffix cost from the right, the first of equals."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = (F.col("l_partkey") % 7).cast("long")
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("left"), F.coalesce(F.sum((F.col("l_suppkey") % 5).cast("long")).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0)).alias("right"))
    x = x.withColumn("cost", F.col("left") + F.col("right"))
    return x.groupBy("l_orderkey").agg(F.min("cost").alias("cost"), F.min_by("l_linenumber", F.struct("cost", "l_linenumber")).alias("split"))


def w16(spark, d):
    """As W15, the last of equals."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum((F.col("l_partkey") % 7).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("left"), F.coalesce(F.sum((F.col("l_suppkey") % 5).cast("long")).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0)).alias("right"))
    x = x.withColumn("cost", F.col("left") + F.col("right"))
    return x.groupBy("l_orderkey").agg(F.min("cost").alias("cost"), F.min_by("l_linenumber", F.struct("cost", -F.col("l_linenumber"))).alias("split"))


def m21(spark, d):
    """Largest anchor: the longest item of at most 20 % cost, else the one of the lowest share."""
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"), (F.col("l_partkey") % 11).cast("long").alias("mm"))
    good = F.col("mm") * 5 <= F.col("n")
    order = F.struct((~good).alias("a"), F.when(good, -F.col("n").cast("double")).otherwise(F.col("mm") / F.col("n")).alias("b"), F.col("l_linenumber"))
    return x.groupBy("l_orderkey").agg(F.min_by("l_linenumber", order).alias("anchor"))


_MATES = "a AS (SELECT conv_id, turn // 2 AS read_ord, text AS seq FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, turn // 2 AS read_ord, text AS seq2 FROM conversations WHERE turn % 2 = 1)"
_GP = 'gp AS (SELECT CAST(l_suppkey % 7 AS INT) AS target_id, l_partkey % 50 AS s, l_partkey % 50 + 20 + l_linenumber AS e, CAST(l_orderkey % 3 AS INT) AS splice, l_orderkey % 2 = 0 AS plus FROM lineitem)'
_J18 = "p AS (SELECT a.conv_id, a.turn AS t1, b.turn AS t2, length(a.text) + length(b.text) AS cost FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' AND abs(a.turn - b.turn) = 1 QUALIFY row_number() OVER (PARTITION BY a.conv_id ORDER BY cost, t1, t2) = 1)"
_SPLIT = "x AS (SELECT l_orderkey, l_linenumber, sum(l_partkey % 7) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) + coalesce(sum(l_suppkey % 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS cost FROM lineitem)"

QUERIES = {
    "J30_mate_zip": (j30, f"WITH {_MATES} SELECT conv_id, read_ord, CAST(length(seq) AS INT) AS n1, CAST(length(seq2) AS INT) AS n2 FROM a JOIN b USING (conv_id, read_ord)"),
    "F8_pair_filter": (f8, f"WITH {_MATES} SELECT conv_id, read_ord FROM a LEFT JOIN b USING (conv_id, read_ord) WHERE length(seq) >= 40 AND (seq2 IS NULL OR length(seq2) >= 40)"),
    "J17_assign_results": (j17, "WITH c AS (SELECT conv_id, turn // 2 AS target, turn % 2 AS side, CAST(length(text) AS INT) AS n FROM conversations) SELECT conv_id, target, coalesce(f.n, -1) AS fw, coalesce(r.n, -1) AS rv FROM (SELECT * FROM c WHERE side = 0) f FULL JOIN (SELECT * FROM c WHERE side = 1) r USING (conv_id, target)"),
    "J18_best_combination": (j18, f"WITH {_J18} SELECT conv_id, t1, t2, CAST(cost AS INT) AS cost FROM p"),
    "J19_first_configuration": (j19, f"WITH {_J18} SELECT conv_id, t1 // 2 AS target FROM p"),
    "J20_all_pairings": (j20, "SELECT a.conv_id, a.turn AS t1, b.turn AS t2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'"),
    "J21_padding_product": (j21, "SELECT r_regionkey, CAST(a AS INT) AS \"left\", CAST(b AS INT) AS \"right\" FROM region, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)"),
    "A5_gap_evidence": (a5, f'WITH {_GP} SELECT target_id, s AS start, e AS "end", splice, count(*) * (1 + any_value(splice)) AS evidence FROM gp GROUP BY target_id, s, e, splice'),
    "A6_gap_clusters": (a6, None),
    "A7_preferred_strand": (a7, f"WITH {_GP}, v AS (SELECT target_id, count(*) FILTER (plus) AS p, count(*) AS n FROM gp WHERE splice > 0 GROUP BY target_id) SELECT target_id, CAST(CASE WHEN 2 * p = n THEN -1 WHEN 2 * p > n THEN 1 ELSE 0 END AS INT) AS strand, round(greatest(p, n - p) / n::DOUBLE, 6) AS confidence FROM v"),
    "A8_invert_introns": (a8, f'WITH {_GP} SELECT DISTINCT target_id, 1000 - e AS start, 1000 - s AS "end" FROM gp'),
    "A29_mismatch_totals": (a29, "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS mismatches, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bases, round(sum(l_linenumber) / sum(CAST(l_quantity AS BIGINT)), 6) AS share FROM lineitem GROUP BY 1"),
    "A28_progress_percent": (a28, "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS mapped, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS percent FROM orders"),
    "A35_nearest_distance": (a35, "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT q.vec_id AS q_id, round(min(list_distance(q.e, o.e)), 4) AS dist FROM e q JOIN e o ON q.label <> o.label WHERE q.vec_id % 50 = 0 GROUP BY 1"),
    "A36_centroids": (a36, "SELECT label, dim, round(avg(x), 4) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL"),
    "A36_components": (a36_components, None),
    "A34_record_embedding": (a34, "SELECT event_id AS ordinal, event_type AS mapper, dense_rank() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS read_no, dense_rank() OVER (ORDER BY event_id % 3) - 1 AS contig_no, round((event_id % 1000 + 1) / max(event_id % 1000 + 1) OVER (PARTITION BY event_id % 3)::DOUBLE, 6) AS place FROM events"),
    "W15_best_split_first": (w15, f"WITH {_SPLIT} SELECT l_orderkey, CAST(min(cost) AS BIGINT) AS cost, first(l_linenumber ORDER BY cost, l_linenumber) AS split FROM x GROUP BY 1"),
    "W16_best_split_last": (w16, f"WITH {_SPLIT} SELECT l_orderkey, CAST(min(cost) AS BIGINT) AS cost, first(l_linenumber ORDER BY cost, l_linenumber DESC) AS split FROM x GROUP BY 1"),
    "M21_largest_anchor": (m21, "WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, l_partkey % 11 AS mm FROM lineitem) SELECT l_orderkey, first(l_linenumber ORDER BY mm * 5 > n, CASE WHEN mm * 5 <= n THEN -n::DOUBLE ELSE mm / n::DOUBLE END, l_linenumber) AS anchor FROM x GROUP BY 1"),
}
