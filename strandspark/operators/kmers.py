"""k-mer tables, seeds and diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of a k-mer.
K = 10
#: Characters of a chunk: substring() walks from the start of its string, so long texts are cut before k-mers are.
CHUNK = 256
#: Read-side k-mers that are broadcast at most; beyond them the seed join shuffles on the k-mer.
BROADCAST_KMERS = 1_000_000


def chunks(df: DataFrame, key: str, seq: str, size: int = CHUNK, overlap: int = K - 1) -> DataFrame:
    """Rows (key, base, chunk): each text cut into pieces that overlap, so that every k-mer lies in exactly one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(size))
    piece = lambda s: F.struct(s.alias("base"), F.substring(F.col(seq), s + 1, F.lit(size + overlap)).alias("chunk"))
    return df.where(F.length(seq) > 0).select(key, F.inline(F.transform(starts, piece)))


def kmers(df: DataFrame, key: str, seq: str, k: int = K, include_last: bool = True) -> DataFrame:
    """Overlapping k-mers of each text: (key, pos, kmer), positions from 0. Shorter texts have none."""
    cut = chunks(df, key, seq, CHUNK, k - 1)
    last = F.least(F.length("chunk") - k, F.lit(CHUNK - 1))
    offsets = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = cut.select(key, "base", "chunk", F.explode(offsets).alias("o"))
    out = rows.select(key, (F.col("base") + F.col("o")).cast("long").alias("pos"), F.substring(F.col("chunk"), F.col("o") + 1, F.lit(k)).alias("kmer"))
    if include_last:
        return out
    ends = df.select(key, (F.length(seq) - k).alias("__last"))
    return out.join(ends, key).where("pos < __last").drop("__last")


def read_kmers(df: DataFrame, key: str, seq: str, k: int = K) -> DataFrame:
    """k-mers of reads at offsets 0, k, 2k, ...: (key, rpos, kmer); the remainder and shorter reads are dropped."""
    last = F.length(seq) - k
    rows = df.where(last >= 0).select(key, seq, F.explode(F.sequence(F.lit(0), last, F.lit(k))).alias("rpos"))
    return rows.select(key, F.col("rpos").cast("long").alias("rpos"), F.substring(F.col(seq), F.col("rpos") + 1, F.lit(k)).alias("kmer"))


def seeds(reads: DataFrame, targets: DataFrame, read_key: str, target_key: str) -> DataFrame:
    """Seed hits: read k-mers that equal target k-mers, with their diagonal (target position less read position).

    The read side is broadcast while it has at most BROADCAST_KMERS rows; otherwise both sides shuffle on the k-mer.
    """
    small = reads.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS
    side = F.broadcast(reads) if small else reads
    return targets.join(side, "kmer").select(read_key, target_key, "rpos", "pos", (F.col("pos") - F.col("rpos")).alias("diag"))


def diagonals(hits: DataFrame, read_key: str, target_key: str) -> DataFrame:
    """Hits of each (read, target, diagonal), with the read span that they cover."""
    return hits.groupBy(read_key, target_key, "diag").agg(F.count(F.lit(1)).alias("hits"), F.min("rpos").alias("from_read"), (F.max("rpos") + K).alias("to_read"))


def best_diagonal(diags: DataFrame, read_key: str, target_key: str) -> DataFrame:
    """The diagonal of most hits for each (read, target); of equals the smallest."""
    best = F.min_by(F.struct("diag", "hits", "from_read", "to_read"), F.struct(-F.col("hits"), F.col("diag")))
    return diags.groupBy(read_key, target_key).agg(best.alias("b")).select(read_key, target_key, "b.*")


def most_hits(diags: DataFrame, read_key: str, target_key: str) -> DataFrame:
    """Hits of the fullest diagonal for each target."""
    return diags.groupBy(target_key).agg(F.max("hits").alias("max_hits"), F.count_distinct(read_key).alias("reads"))


def global_filter(hits: DataFrame, read_key: str, is_first: Column, least: int) -> DataFrame:
    """Reads of which at least `least` k-mers hit the first target, or at least `least` any other."""
    mine = F.count_distinct(F.when(is_first, F.col("rpos")))
    other = F.count_distinct(F.when(~is_first, F.col("rpos")))
    return hits.groupBy(read_key).agg(mine.alias("first_hits"), other.alias("other_hits")).withColumn("keep", (F.col("first_hits") >= least) | (F.col("other_hits") >= least))


def bin_filter(hits: DataFrame, read_key: str, width: int, least: int, overlapping: bool = False) -> DataFrame:
    """Reads with a bin of target positions that holds at least `least` hits; a second grid is shifted by half a bin."""
    grids = [F.struct(F.lit(0).alias("grid"), F.floor(F.col("pos") / width).alias("bin"))]
    if overlapping:
        grids.append(F.struct(F.lit(1).alias("grid"), F.floor((F.col("pos") + width // 2) / width).alias("bin")))
    rows = hits.select(read_key, F.inline(F.array(*grids)))
    counts = rows.groupBy(read_key, "grid", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(read_key).agg(F.max("n").cast("long").alias("most")).withColumn("keep", F.col("most") >= least)


def kmer_counts(df: DataFrame, key: str, seq: str, k: int = K, include_last: bool = True, only: DataFrame | None = None) -> DataFrame:
    """How often each k-mer occurs; with `only`, those of a table's column kmer, sought before they are counted."""
    rows = kmers(df, key, seq, k, include_last).select("kmer")
    if only is not None:
        asked = only.select("kmer").distinct()
        small = asked.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS
        rows = rows.join(F.broadcast(asked) if small else asked, "kmer", "left_semi")
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))


def occurrences(target_kmers: DataFrame, counts: DataFrame, missing: int = 1) -> DataFrame:
    """Genome counts at target positions; a k-mer that was not counted has the pseudocount `missing`."""
    return target_kmers.join(counts, "kmer", "left").withColumn("count", F.coalesce("count", F.lit(missing).cast("long")))


def harmonic_mean(x: Column) -> Column:
    """n / sum(1 / x); 0 if any value is 0, null without values."""
    return F.when(F.min(x) == 0, F.lit(0.0)).otherwise(F.count(x) / F.sum(F.when(x != 0, F.lit(1.0) / F.nullif(x, F.lit(0)))))


def geometric_mean(x: Column) -> Column:
    """exp(mean(ln x)); 0 if any value is 0, null without values."""
    return F.when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.nullif(x, F.lit(0))))))


def spread(df: DataFrame, bin_width: int, kmer: str, contig: str, pos: str) -> DataFrame:
    """In how many distinct bins of a contig each k-mer lies."""
    bins = df.select(kmer, contig, F.floor(F.col(pos) / bin_width).alias("bin"))
    return bins.distinct().groupBy(kmer).agg(F.count(F.lit(1)).alias("bins"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
