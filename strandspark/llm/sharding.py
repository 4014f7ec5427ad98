"""Extendible hashing into byte-bounded shards: Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that a directory can use.
HASH_BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a number from 0."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: Column) -> Column:
    """The first `depth` bits (0 to HASH_BITS)."""
    return F.call_function("shiftright", bits, (F.lit(HASH_BITS) - depth).cast("int"))


def shard_documents(docs: DataFrame, limit_bytes: int, step: int = 8) -> DataFrame:
    """Assign each document to a shard of at most `limit_bytes` UTF-8 bytes.

    The directory is indexed by the first bits of the MD5 of doc_id. All documents start in the bucket of depth 0; a
    bucket over the limit splits on the next bit, and only such buckets do. Bytes are counted for all prefix lengths of
    a round of `step` bits in one pre-aggregated pass; later rounds see only the buckets that are still too large.
    Documents whose hashes do not differ (repeated ids) cannot be split by bits: their bucket stops at full depth and
    overflows into pages in order of size, each within the limit. A document larger than the limit has a page of its own.

    Returns one row per input row: doc_id, n_bytes, depth, prefix, page. Null texts have 0 bytes; a null doc_id hashes as
    the empty string; an empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    # equal (id, size) rows are interchangeable: they travel as one row with a count
    rows = rows.withColumn("bits", hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keys = rows.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"))
    leaves = None
    open_ = keys.withColumn("depth", F.lit(None).cast("int"))
    low = 0
    while True:
        high = min(low + step, HASH_BITS)
        depths = F.sequence(F.lit(low), F.lit(high))
        paths = open_.select("bits", "bytes", F.explode(depths).alias("depth"))
        sums = paths.groupBy("depth", prefix(F.col("bits"), F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        over = sums.where(F.col("bytes") > limit_bytes)
        # a leaf is a prefix that fits (or is full) below a parent that does not
        parents = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        fits = sums.where((F.col("bytes") <= limit_bytes) | (F.col("depth") == HASH_BITS))
        top = fits.where(F.col("depth") == 0) if low == 0 else fits.limit(0)
        found = fits.join(parents, ["depth", "prefix"], "left_semi").unionByName(top)
        leaves = found if leaves is None else leaves.unionByName(found)
        if high == HASH_BITS:
            break
        still = over.where(F.col("depth") == high).select("prefix")
        if still.isEmpty():
            break
        open_ = keys.withColumn("prefix", prefix(F.col("bits"), F.lit(high))).join(still, "prefix", "left_semi").drop("prefix")
        low = high
    leaves = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
    used = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most HASH_BITS + 1 numbers
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("bits"), F.lit(d)).alias("prefix")) for d in sorted(used)])) if used else None
    if tries is None:
        return rows.select("doc_id", "n_bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("page"))
    placed = rows.groupBy("doc_id", "bits", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    placed = placed.select("doc_id", "bits", "n_bytes", "copies", tries.alias("at")).select("doc_id", "bits", "n_bytes", "copies", "at.depth", "at.prefix").join(leaves, ["depth", "prefix"])
    return _pages(placed, limit_bytes)


def _pages(placed: DataFrame, limit_bytes: int) -> DataFrame:
    """Cut buckets that stay too large into pages. Only such buckets are ordered, by distinct (id, size)."""
    whole = placed.where(F.col("shard_bytes") <= limit_bytes).select("doc_id", "n_bytes", "copies", "depth", "prefix", F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("per"))
    large = placed.where(F.col("shard_bytes") > limit_bytes)
    # copies of one size fill pages of their own: `per` to a page
    per = F.greatest(F.floor(F.lit(limit_bytes) / F.greatest("n_bytes", F.lit(1))), F.lit(1)).cast("long")
    pages = F.ceil(F.col("copies") / per).cast("long")
    w = "sum(pages) over (partition by depth, prefix order by n_bytes, doc_id nulls first rows between unbounded preceding and current row)"
    large = large.withColumn("per", per).withColumn("pages", pages).withColumn("base", F.expr(w) - F.col("pages"))
    rows = whole.unionByName(large.select("doc_id", "n_bytes", "copies", "depth", "prefix", "base", "per"))
    one = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    page = F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(F.col("base") + F.floor(F.col("k") / F.col("per")).cast("long"))
    return one.select("doc_id", "n_bytes", "depth", "prefix", page.alias("page"))
