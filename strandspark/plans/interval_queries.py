"""Queries of the interval layer over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import intervals as I


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _day(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _ship(spark, d):
    """One interval of l_quantity days for each line item, by supplier."""
    return _t(spark, d, "lineitem").select("l_suppkey", _day("l_shipdate").alias("start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order_id"), _day("o_orderdate").alias("start"), (_day("o_orderdate") + 30).alias("end"))


def _points(spark, d):
    """Ship days by customer."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _day("l_shipdate").alias("pos")).join(o, "l_orderkey")


def _right(df):
    return df.select("cust", F.col("order_id").alias("r_order"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def _events(spark, d):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    rank = F.dense_rank().over(I.W.orderBy("event_type"))
    kinds = _t(spark, d, "events").select("event_type").distinct().select("event_type", rank.cast("long").alias("priority"))
    e = _t(spark, d, "events").where("ts is not null").select("user_id", "event_type", minute.alias("start"), (minute + 240).alias("end"))
    return e.join(F.broadcast(kinds), "event_type").distinct()


W = 64


def w1(spark, d):
    return I.merge(_ship(spark, d), ["l_suppkey"]).select("l_suppkey", "start", "end", "n")


def r18(spark, d):
    return I.merge(_ship(spark, d), ["l_suppkey"], 1).select("l_suppkey", "start", "end", "n")


def w8(spark, d):
    return I.gaps(_orders(spark, d), ["cust"]).select("cust", "start", "end")


def w11(spark, d):
    return I.classes(_ship(spark, d), ["l_suppkey"]).select("l_suppkey", "start", "end", "depth")


def w12(spark, d):
    return I.ranked(_orders(spark, d).select("cust", "start", "end"), ["cust"])


def u4(spark, d):
    return I.complement(_orders(spark, d), ["cust"], F.min("start") - 5, F.max("end") + 5).select("cust", "start", "end")


def a9(spark, d):
    return I.coverage(_ship(spark, d), ["l_suppkey"]).select("l_suppkey", "start", "end", "depth")


def w9(spark, d):
    return I.flatten_priorities(_events(spark, d), ["user_id"], "priority", "event_type").select("user_id", "event_type", "start", "end")


def j4(spark, d):
    o = _orders(spark, d)
    both = I.overlap_join(o, _right(o), ["cust"], W, closed=True).where("order_id < r_order")
    return both.select("cust", "order_id", "r_order")


def j10(spark, d):
    o = _orders(spark, d)
    return I.overlap_join(o, _right(o), ["cust"], W).where("order_id <> r_order").select("cust", "order_id", "r_order")


def j5(spark, d):
    return I.stab(_points(spark, d), _orders(spark, d), ["cust"], W).select("cust", "l_orderkey", "l_linenumber", "order_id")


def j9(spark, d):
    return I.stab(_points(spark, d), _orders(spark, d), ["cust"], W, closed=True).groupBy("cust", "pos").agg(F.count_distinct("order_id").alias("intervals"))


def j6(spark, d):
    o = _orders(spark, d)
    return I.as_of(_points(spark, d), o, ["cust"], ["l_orderkey", "l_linenumber"]).where("found is not null").select("l_orderkey", "l_linenumber", "pos", F.col("found").alias("start"), (F.col("pos") - F.col("found")).alias("offset"))


def j12(spark, d):
    return I.as_of(_points(spark, d), _orders(spark, d), ["cust"], ["l_orderkey", "l_linenumber"], forward=True).where("found is not null").select("l_orderkey", "l_linenumber", "pos", F.col("found").alias("next_start"))


def j13(spark, d):
    return I.as_of(_points(spark, d), _orders(spark, d), ["cust"], ["l_orderkey", "l_linenumber"]).where("found is not null").select("l_orderkey", "l_linenumber", "pos", F.col("found").alias("prev_start"))


def j7(spark, d):
    o = _orders(spark, d).join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority")), "order_id")
    r = o.select("cust", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "priority", F.col("order_id").alias("r_order"))
    both = I.overlap_join(o.drop("priority"), r, ["cust"], W)
    size = F.least("end", "r_end") - F.greatest("start", "r_start")
    return both.groupBy("order_id").agg(F.max("priority").alias("priority"), F.sum(size).alias("overlap"))


def j11(spark, d):
    o = _orders(spark, d)
    hit = I.overlap_join(o, _right(o), ["cust"], W).where("order_id <> r_order").select("order_id")
    return o.join(hit, "order_id", "left_semi").select("order_id", "cust")


def j14(spark, d):
    o = _orders(spark, d)
    hit = I.overlap_join(o, _right(o), ["cust"], W).where("order_id <> r_order").select("order_id").distinct().withColumn("hit", F.lit(True))
    return o.join(hit, "order_id", "left").select("order_id", F.coalesce("hit", F.lit(False)).alias("overlaps"))


def j16(spark, d):
    o = _orders(spark, d)
    wide = o.select("cust", "order_id", (F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end"))
    both = I.overlap_join(wide, _right(o), ["cust"], W).where("start <= r_start and r_end <= end and order_id <> r_order")
    return both.groupBy("order_id").agg(F.count(F.lit(1)).alias("contained"))


def f23(spark, d):
    e = _events(spark, d)
    regions = e.groupBy("user_id").agg(F.min("start").alias("start"), (F.min("start") + 1000).alias("end"))
    labels = I.flatten_priorities(e, ["user_id"], "priority", "event_type").select("user_id", "event_type", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.clip_to_labels(regions, labels, ["user_id"], 512).select("user_id", "event_type", "c_start", "c_end")


_SHIP = "ship AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
_ORD = "ord AS (SELECT o_custkey AS cust, o_orderkey AS id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 AS e FROM orders)"
_PTS = "pts AS (SELECT l_orderkey, l_linenumber, o_custkey AS cust, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_EV = "ev AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 60000000 AS s, epoch_us(ts) // 60000000 + 240 AS e, priority FROM events JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS priority FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) WHERE ts IS NOT NULL)"


def _merge(src: str, key: str, tol: int = 0) -> str:
    return f"""m1 AS (SELECT {key}, s, e, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {src}),
m2 AS (SELECT *, sum(CASE WHEN s <= r + {tol} THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
merged AS (SELECT {key}, min(s) AS s, max(e) AS e, count(*) AS n FROM m2 GROUP BY {key}, g)"""


_SWEEP = """ev2 AS (SELECT l_suppkey, p, sum(d) AS d FROM (SELECT l_suppkey, s AS p, 1 AS d FROM ship UNION ALL SELECT l_suppkey, e, -1 FROM ship) GROUP BY ALL),
seg AS (SELECT l_suppkey, p AS s, lead(p) OVER w AS e, CAST(sum(d) OVER (PARTITION BY l_suppkey ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM ev2 WINDOW w AS (PARTITION BY l_suppkey ORDER BY p)),
cls AS (SELECT * FROM seg WHERE depth > 0 AND e IS NOT NULL)"""
_FLAT = """cut AS (SELECT DISTINCT user_id, p FROM (SELECT user_id, s AS p FROM ev UNION ALL SELECT user_id, e FROM ev)),
pc AS (SELECT user_id, p AS ps, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS pe FROM cut),
won AS (SELECT pc.user_id, ps, pe, event_type FROM pc JOIN ev ON pc.user_id = ev.user_id AND s <= ps AND e >= pe WHERE pe IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pc.user_id, ps ORDER BY priority DESC, event_type) = 1),
isl AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND lag(pe) OVER w = ps THEN 0 ELSE 1 END AS nw FROM won WINDOW w AS (PARTITION BY user_id ORDER BY ps)),
isl2 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ps ROWS UNBOUNDED PRECEDING) AS g FROM isl),
flat AS (SELECT user_id, event_type, min(ps) AS s, max(pe) AS e FROM isl2 GROUP BY user_id, event_type, g)"""

QUERIES = {
    "W1_merge_intervals": (w1, f'WITH {_SHIP}, {_merge("ship", "l_suppkey")} SELECT l_suppkey, s AS start, e AS "end", n FROM merged'),
    "R18_merge_with_tolerance": (r18, f'WITH {_SHIP}, {_merge("ship", "l_suppkey", 1)} SELECT l_suppkey, s AS start, e AS "end", n FROM merged'),
    "W8_gaps": (w8, f'WITH {_ORD} SELECT cust, e AS start, nx AS "end" FROM (SELECT cust, e, lead(s) OVER (PARTITION BY cust ORDER BY s, e) AS nx FROM ord) WHERE nx IS NOT NULL'),
    "W11_equivalence_classes": (w11, f'WITH {_SHIP}, {_SWEEP} SELECT l_suppkey, s AS start, e AS "end", depth FROM cls'),
    "W12_region_ranks": (w12, f'WITH {_ORD} SELECT cust, s AS start, e AS "end", row_number() OVER (PARTITION BY cust ORDER BY s, e) - 1 AS rank FROM ord'),
    "U4_uncovered": (u4, f'WITH {_ORD}, {_merge("ord", "cust")}, al AS (SELECT cust, s, e FROM merged UNION ALL SELECT cust, min(s) - 5, min(s) - 5 FROM ord GROUP BY cust UNION ALL SELECT cust, max(e) + 5, max(e) + 5 FROM ord GROUP BY cust), g AS (SELECT cust, e AS s, lead(s) OVER (PARTITION BY cust ORDER BY s, e) AS e FROM al) SELECT cust, s AS start, e AS "end" FROM g WHERE s < e'),
    "A9_coverage": (a9, f'WITH {_SHIP}, {_SWEEP}, i AS (SELECT *, CASE WHEN lag(depth) OVER w = depth AND lag(e) OVER w = s THEN 0 ELSE 1 END AS nw FROM cls WINDOW w AS (PARTITION BY l_suppkey ORDER BY s)), i2 AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM i) SELECT l_suppkey, min(s) AS start, max(e) AS "end", max(depth) AS depth FROM i2 GROUP BY l_suppkey, g'),
    "W9_priority_flatten": (w9, f'WITH {_EV}, {_FLAT} SELECT user_id, event_type, s AS start, e AS "end" FROM flat'),
    "F23_mask_regions": (f23, f"WITH {_EV}, {_FLAT}, r AS (SELECT user_id, min(s) AS rs, min(s) + 1000 AS re FROM ev GROUP BY user_id) SELECT flat.user_id, event_type, greatest(s, rs) AS c_start, least(e, re) AS c_end FROM flat JOIN r ON flat.user_id = r.user_id AND s < re AND rs < e"),
    "J4_mask_overlap_closed": (j4, f"WITH {_ORD} SELECT a.cust, a.id AS order_id, b.id AS r_order FROM ord a JOIN ord b ON a.cust = b.cust AND a.id < b.id AND a.s <= b.e AND b.s <= a.e"),
    "J10_overlap": (j10, f"WITH {_ORD} SELECT a.cust, a.id AS order_id, b.id AS r_order FROM ord a JOIN ord b ON a.cust = b.cust AND a.id <> b.id AND a.s < b.e AND b.s < a.e"),
    "J11_overlap_semi": (j11, f"WITH {_ORD} SELECT id AS order_id, cust FROM ord a WHERE EXISTS (SELECT 1 FROM ord b WHERE a.cust = b.cust AND a.id <> b.id AND a.s < b.e AND b.s < a.e)"),
    "J14_overlaps_any": (j14, f"WITH {_ORD} SELECT id AS order_id, EXISTS (SELECT 1 FROM ord b WHERE a.cust = b.cust AND a.id <> b.id AND a.s < b.e AND b.s < a.e) AS overlaps FROM ord a"),
    "J16_contained": (j16, f"WITH {_ORD} SELECT a.id AS order_id, count(*) AS contained FROM ord a JOIN ord b ON a.cust = b.cust AND a.id <> b.id AND a.s - 20 <= b.s AND b.e <= a.e + 20 GROUP BY a.id"),
    "J5_point_in_interval": (j5, f"WITH {_ORD}, {_PTS} SELECT ord.cust, l_orderkey, l_linenumber, id AS order_id FROM pts JOIN ord ON pts.cust = ord.cust AND s <= pos AND pos < e"),
    "J9_stab_closed": (j9, f"WITH {_ORD}, {_PTS} SELECT ord.cust, pos, count(DISTINCT id) AS intervals FROM pts JOIN ord ON pts.cust = ord.cust AND s <= pos AND pos <= e GROUP BY ALL"),
    "J6_as_of_offset": (j6, f"WITH {_ORD}, {_PTS}, o AS (SELECT DISTINCT cust, s FROM ord) SELECT l_orderkey, l_linenumber, pos, s AS start, pos - s AS \"offset\" FROM pts ASOF JOIN o ON pts.cust = o.cust AND pts.pos >= o.s"),
    "J12_next_interval": (j12, f"WITH {_ORD}, {_PTS}, o AS (SELECT DISTINCT cust, s FROM ord) SELECT l_orderkey, l_linenumber, pos, s AS next_start FROM pts ASOF JOIN o ON pts.cust = o.cust AND pts.pos <= o.s"),
    "J13_prev_interval": (j13, f"WITH {_ORD}, {_PTS}, o AS (SELECT DISTINCT cust, s FROM ord) SELECT l_orderkey, l_linenumber, pos, s AS prev_start FROM pts ASOF JOIN o ON pts.cust = o.cust AND pts.pos >= o.s"),
    "J7_most_important_overlap": (j7, f"WITH {_ORD}, p AS (SELECT o_orderkey AS id, CAST(left(o_orderpriority, 1) AS BIGINT) AS pr FROM orders) SELECT a.id AS order_id, max(pr) AS priority, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap FROM ord a JOIN ord b ON a.cust = b.cust AND a.s < b.e AND b.s < a.e JOIN p ON p.id = b.id GROUP BY a.id"),
}
