"""Readers and writers of sequence formats, on Spark's own text and CSV readers (gzip by file name).

Nothing is inferred: every reader returns a fixed schema. Ordinals are numbers that keep the order of a file, made from
the place where a record was read, not after a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.functions import scalars as S

FAI = "reference string, length long, offset long, linebases int, linewidth int"
GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
#: Mandatory columns of an alignment line.
SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Whole records between separators, with their file and a number that grows along it."""
    return spark.read.option("lineSep", sep).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, header, seq): lines are trimmed and joined, blank ones skipped; text before the first ">" is dropped."""
    rec = _records(spark, path, "\n>")
    body = F.when(F.col("value").startswith(">"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    cut = rec.select("ord", F.trim(F.substring_index(body, "\n", 1)).alias("header"), F.regexp_replace(F.regexp_replace(body, r"\A[^\n]*", ""), r"\s+", "").alias("seq"))
    return cut.where("header <> '' or seq <> ''")


def target_header(df: DataFrame, header: str = "header") -> DataFrame:
    """Columns contig, gene_id, strand, start and end of a tab-separated target header."""
    p = F.split(header, "\t")
    return df.select("*", F.get(p, F.lit(0)).alias("contig"), F.get(p, F.lit(1)).alias("gene_id"), (F.get(p, F.lit(2)) == "+").alias("strand"), F.get(p, F.lit(3)).try_cast("long").alias("start"), F.get(p, F.lit(4)).try_cast("long").alias("end"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=FAI)


def read_fastq(spark: SparkSession, path: str, mate: int) -> DataFrame:
    """Rows (read_ord, mate, header, seq, qual) from four-line records, the leading @ dropped.

    Lines are numbered within the file; a line's number comes from counts of the lines in the partitions before its own.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33))
    sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = lines.join(F.broadcast(before), "part").withColumn("line", F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rec = numbered.groupBy(F.floor(F.col("line") / 4).alias("read_ord")).agg(at(0).alias("header"), at(1).alias("seq"), at(3).alias("qual"))
    return rec.where("seq is not null").select("read_ord", F.lit(mate).alias("mate"), F.regexp_replace("header", "^@", "").alias("header"), "seq", F.coalesce("qual", F.lit("")).alias("qual"))


def pair_reads(first: DataFrame, second: DataFrame | None, check_names: bool = False) -> DataFrame:
    """Mates zipped by ordinal; without a second file the mate is null, with one the shorter file decides.

    With `check_names` pairs whose names differ are kept and marked.
    """
    one = first.select("read_ord", *[F.col(c).alias(f"{c}1") for c in ("header", "seq", "qual")])
    if second is None:
        return one.select("*", *[F.lit(None).cast("string").alias(f"{c}2") for c in ("header", "seq", "qual")])
    both = one.join(second.select("read_ord", *[F.col(c).alias(f"{c}2") for c in ("header", "seq", "qual")]), "read_ord")
    return both.withColumn("names_agree", S.read_id(F.col("header1")) == S.read_id(F.col("header2"))) if check_names else both


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows with gene_id and transcript_id; comment lines skipped, "chr" stripped, starts from 0."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="")
    return raw.select(F.regexp_replace("seqname", "^chr", "").alias("contig"), "feature", (F.col("start") - 1).alias("start"), "end", (F.col("strand") == "+").alias("strand"), S.attribute(F.col("attributes"), "gene_id").alias("gene_id"), S.attribute(F.col("attributes"), "transcript_id").alias("transcript_id"))


def genes(gtf: DataFrame, ids: list[str] | None = None) -> DataFrame:
    found = gtf.where("feature = 'gene'").drop("feature", "transcript_id")
    return found.where(F.col("gene_id").isin(ids)) if ids else found


def gene_models(gtf: DataFrame) -> DataFrame:
    """Genes with their transcripts and coding parts, nested; parents are joined by id."""
    cds = gtf.where("lower(feature) = 'cds'").groupBy("gene_id", "transcript_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    per = cds.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("transcript_id", "exons"))).alias("transcripts"))
    return genes(gtf).join(per, "gene_id", "left")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED4 rows; rows with other than numbers as bounds are dropped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value not rlike '^(#|track|browser|\\\\s*$)'")
    bed = rows.select(F.get(p, F.lit(0)).alias("contig"), F.get(p, F.lit(1)).try_cast("int").alias("start"), F.get(p, F.lit(2)).try_cast("int").alias("end"), F.get(p, F.lit(3)).alias("name"))
    return bed.where("start is not null and end is not null")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """BED6 region mask: contig, start, end, name, priority, max_mismatches."""
    return spark.read.csv(path, sep="\t", comment="#", schema="contig string, start long, end long, name string, priority int, max_mismatches int")


def mask_items(mask: DataFrame, targets: DataFrame) -> DataFrame:
    """Mask intervals relative to each strand of the targets that they overlap (closed test); strand 2i, 2i + 1."""
    t = targets.select("target_id", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    hit = mask.join(F.broadcast(t), "contig").where("start <= t_end and end >= t_start")
    size = F.col("t_end") - F.col("t_start")
    lo, hi = F.greatest(F.col("start") - F.col("t_start"), F.lit(0)), F.least(F.col("end") - F.col("t_start"), size)
    both = F.array(F.struct((F.col("target_id") * 2).alias("seq_index"), lo.alias("m_start"), hi.alias("m_end")), F.struct((F.col("target_id") * 2 + 1).alias("seq_index"), (size - hi).alias("m_start"), (size - lo).alias("m_end")))
    return hit.select("name", "priority", F.col("max_mismatches").alias("threshold"), F.inline(both)).select("seq_index", F.col("m_start").alias("start"), F.col("m_end").alias("end"), "name", "priority", "threshold")


def read_priorities(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, priority); comments are skipped, a malformed or repeated name fails."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value not rlike '^\\\\s*(#.*)?$'")
    bad = F.raise_error(F.concat(F.lit("malformed priority: "), F.col("value"))).cast("int")
    out = rows.select(F.get(p, F.lit(0)).alias("name"), F.when(F.size(p) == 2, F.get(p, F.lit(1)).try_cast("int")).alias("n"), "value").select("name", F.coalesce("n", bad).alias("priority"))
    n = F.count(F.lit(1)).over(W.partitionBy("name"))
    return out.select("name", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated name: "), F.col("name"))).cast("int")).otherwise(F.col("priority")).alias("priority"))


def read_repeatmasker(spark: SparkSession, path: str, kinds: list[str] | None = None, contigs: list[str] | None = None, strip_chr: bool = False) -> DataFrame:
    """Repeat rows as BED: rows of 11 columns or more whose score is a number; starts from 0."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 11)
    out = rows.select(F.col("p")[4].alias("contig"), (F.col("p")[5].try_cast("long") - 1).alias("start"), F.col("p")[6].try_cast("long").alias("end"), F.col("p")[10].alias("name")).where("start is not null and end is not null")
    out = out.where(F.col("name").isin(kinds)) if kinds else out
    out = out.where(F.col("contig").isin(contigs)) if contigs else out
    return out.withColumn("contig", F.regexp_replace("contig", "^chr", "")) if strip_chr else out


def read_sam(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Alignment rows of one or many files with their ordinal, tags and file; header lines are left out.

    A row of fewer than 11 fields, or whose number fields are none, fails; without `strict` it is dropped.
    """
    p = F.split("value", "\t")
    raw = _records(spark, path, "\n").where("value not like '@%' and value <> ''").select("file", "ord", "value", p.alias("p"))
    numbers = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}
    cols = [(F.get("p", F.lit(i)).try_cast(numbers[c]) if c in numbers else F.get("p", F.lit(i))).alias(c) for i, c in enumerate(SAM)]
    rows = raw.select("file", "ord", "value", *cols, F.when(F.size("p") > 11, F.slice("p", 12, 2**31 - 1)).otherwise(F.array().cast("array<string>")).alias("tags"))
    ok = F.col("qual").isNotNull() & F.coalesce(*[F.col(c) for c in ("flag",)]).isNotNull()
    for c in numbers:
        ok = ok & F.col(c).isNotNull()
    if strict:
        rows = rows.withColumn("flag", F.when(ok, F.col("flag")).otherwise(F.raise_error(F.concat(F.lit("bad alignment line: "), F.col("value"))).cast("int")))
    else:
        rows = rows.where(ok)
    return rows.drop("value")


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines as (kind, fields)."""
    rows = _records(spark, path, "\n").where("value like '@%'")
    return rows.select("ord", F.substring("value", 2, 2).alias("kind"), F.str_to_map(F.regexp_replace("value", r"^@..\t?", ""), F.lit("\t"), F.lit(":")).alias("fields"))


def mapper_results(records: DataFrame) -> DataFrame:
    """Target, mapper and kind of records by their file's name, <target>.<mapper>.<target|genome>.sam."""
    p = F.split(F.element_at(F.split("file", "/"), -1), r"\.")
    return records.where((F.size(p) == 4) & (F.element_at(p, -1) == "sam")).select("*", p[0].alias("target"), p[1].alias("mapper"), p[2].alias("kind"))


def read_kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="kmer string, count long")


def write_kmer_counts(counts: DataFrame, path: str) -> None:
    """Sorted by ascending count."""
    counts.orderBy("count", "kmer").write.csv(path, sep="\t", mode="overwrite")


def write_fasta(df: DataFrame, path: str) -> None:
    """Rows (header, seq) as FASTA in lines of 60 letters."""
    df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), S.fasta_lines(F.col("seq"))).alias("value")).write.mode("overwrite").text(path)


def sam_line(df: DataFrame) -> DataFrame:
    """Alignment rows as text, tags last."""
    parts = [F.col(c).cast("string") for c in SAM]
    line = F.concat_ws("\t", *parts)
    return df.select(F.when(F.size("tags") > 0, F.concat(line, F.lit("\t"), F.array_join("tags", "\t"))).otherwise(line).alias("value"))


def sam_header(targets: DataFrame, program: str = "strandspark") -> DataFrame:
    """@HD, one @SQ a target (LN is its genomic end) and @PG, in order."""
    spark = targets.sparkSession
    sq = targets.select((F.col("target_id") + 1).cast("long").alias("k"), F.concat(F.lit("@SQ\tSN:"), F.col("contig"), F.lit("\tLN:"), F.col("end").cast("string")).alias("value"))
    ends = spark.createDataFrame([(0, "@HD\tVN:1.6\tSO:unsorted"), ((1 << 62), f"@PG\tID:{program}\tPN:{program}")], "k long, value string")
    return ends.unionByName(sq).orderBy("k").select("value")


def extract(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Letters of [start, end) of contigs stored in chunks (contig, base, chunk), joined in order."""
    size = F.length("chunk")
    hit = chunks.join(F.broadcast(regions), "contig").where((F.col("base") < F.col("end")) & (F.col("base") + size > F.col("start")))
    lo, hi = F.greatest(F.col("start") - F.col("base"), F.lit(0)), F.least(F.col("end") - F.col("base"), size)
    part = F.substring(F.col("chunk"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    return hit.groupBy("contig", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", part.alias("s")))), lambda x: x["s"]), "").alias("seq"))


def gene_regions(gene_rows: DataFrame, fai: DataFrame, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """Genes widened on both sides, within their contig."""
    sizes = fai.select(F.regexp_replace("reference", "^chr", "").alias("contig"), "length")
    return gene_rows.join(F.broadcast(sizes), "contig").select("contig", "gene_id", "strand", F.greatest(F.col("start") - upstream, F.lit(0)).alias("start"), F.least(F.col("end") + downstream, F.col("length")).alias("end"))
