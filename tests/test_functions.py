"""Region and scalar functions: table cases, properties and format round trips."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandspark.functions import regions as R
from strandspark.functions import scalars as S
from strandspark.operators import embedding, introns, paths
from strandspark.sources import formats as X

REMOVE = [
    ([], (0, 10), []), ([(0, 10)], (0, 0), [(0, 10)]), ([(10, 15)], (0, 5), [(10, 15)]), ([(10, 15)], (20, 25), [(10, 15)]),
    ([(10, 15), (20, 25)], (15, 20), [(10, 15), (20, 25)]), ([(10, 15), (20, 25)], (5, 12), [(12, 15), (20, 25)]),
    ([(10, 15), (20, 25)], (12, 18), [(10, 12), (20, 25)]), ([(10, 15), (20, 25)], (12, 22), [(10, 12), (22, 25)]),
    ([(10, 15), (20, 25), (30, 35)], (12, 32), [(10, 12), (32, 35)]), ([(10, 15), (20, 25)], (22, 24), [(10, 15), (20, 22), (24, 25)]),
]


def vectors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {R.KIND}")


def pairs(v):
    return [(x["start"], x["end"]) for x in v]


def test_remove(spark):
    for v, (s, e), want in REMOVE:
        assert pairs(vectors(spark, [v]).select(R.remove(F.col("v"), F.lit(s), F.lit(e)).alias("v")).first()[0]) == want


def test_merge_is_idempotent_and_complements(spark):
    df = vectors(spark, [[(0, 10), (10, 20), (15, 18), (30, 40)], [], [(5, 6)], [(9, 12), (0, 3), (2, 5)]])
    for r in df.select(R.merge(F.col("v")).alias("m"), R.merge(R.merge(F.col("v"))).alias("mm"), R.uncovered(F.col("v")).alias("u"), R.length(R.merge(F.col("v"))).alias("n")).collect():
        assert r["m"] == r["mm"]
        if r["m"]:
            assert r["n"] + sum(e - s for s, e in pairs(r["u"])) == r["m"][-1]["end"] - r["m"][0]["start"]


def test_combine_consecutive(spark):
    a, b = [(0, 10), (10, 20), (20, 30)], [(0, 5), (5, 15), (16, 26)]
    df = spark.createDataFrame([(a, b)], f"a {R.KIND}, b {R.KIND}")
    got = df.select(R.combine_consecutive(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert pairs(got["a"]) == [(0, 20), (20, 30)] and pairs(got["b"]) == [(0, 15), (16, 26)]


def test_gap_index(spark):
    df = vectors(spark, [[(0, 10), (10, 15), (20, 30)]])
    assert [df.select(R.gap_index_after(F.col("v"), F.lit(p))).first()[0] for p in (5, 14, 15, 20)] == [1, 1, -1, -1]


def test_sequences_and_cigars(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("ACX",)], "s string")
    got = [r[0] for r in df.select(S.reverse_complement(F.col("s"))).collect()]
    assert got == ["NACGT", "", None]
    for c in ("3S5=2X4M1I9N6M", "*", "150=", "10M20D10M"):
        ops = S.cigar(F.lit(c))
        assert spark.range(1).select(S.cigar_string(ops)).first()[0] == c


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">7\tG1\t+\t100\t220\nACGT\nAC GT\n\n>x\nTTTT\n")
    fa = {r["header"]: r["seq"] for r in X.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert fa == {"7\tG1\t+\t100\t220": "ACGTACGT", "x": "TTTT"}
    t = X.target_header(X.read_fasta(spark, str(tmp_path / "a.fa"))).where("gene_id is not null").first()
    assert (t["contig"], t["gene_id"], t["strand"], t["start"], t["end"]) == ("7", "G1", True, 100, 220)
    X.write_fasta(X.read_fasta(spark, str(tmp_path / "a.fa")).select("header", F.repeat("seq", 20).alias("seq")), str(tmp_path / "out"))
    back = {r["header"]: r["seq"] for r in X.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back["x"] == "TTTT" * 20
    with gzip.open(tmp_path / "r1.fastq.gz", "wt") as f:
        f.write("".join(f"@r{i}/1 x\nACGT{i}\n+\nIIII\n" for i in range(5)))
    (tmp_path / "r2.fastq").write_text("".join(f"@r{i}/2\nTTTT\n+\nJJJJ\n" for i in range(4)))
    one, two = X.read_fastq(spark, str(tmp_path / "r1.fastq.gz"), 1), X.read_fastq(spark, str(tmp_path / "r2.fastq"), 2)
    got = X.pair_reads(one, two, check_names=True).orderBy("read_ord").collect()
    assert [(r["read_ord"], r["header1"], r["seq2"], r["names_agree"]) for r in got][:1] == [(0, "r0/1 x", "TTTT", True)] and len(got) == 4
    assert X.pair_reads(one, None).count() == 5
    gtf = '#c\nchr1\ts\tgene\t11\t90\t.\t+\t.\tgene_id "G1";\nchr1\ts\tCDS\t11\t20\t.\t+\t0\tgene_id "G1"; transcript_id "T1";\nchr1\ts\tCDS\t31\t40\t.\t+\t0\tgene_id "G1"; transcript_id "T1";\n'
    (tmp_path / "a.gtf").write_text(gtf)
    g = X.gene_models(X.read_gtf(spark, str(tmp_path / "a.gtf"))).first()
    assert (g["contig"], g["start"], g["end"]) == ("1", 10, 90) and [(e["start"], e["end"]) for e in g["transcripts"][0]["exons"]] == [(10, 20), (30, 40)]
    (tmp_path / "a.bed").write_text("1\t5\t9\tx\nbad\tq\t9\ty\n")
    assert X.read_bed(spark, str(tmp_path / "a.bed")).count() == 1
    (tmp_path / "p.txt").write_text("# c\nLINE 3\nSINE 1\n")
    assert {r["name"]: r["priority"] for r in X.read_priorities(spark, str(tmp_path / "p.txt")).collect()} == {"LINE": 3, "SINE": 1}
    (tmp_path / "p2.txt").write_text("LINE 3\nLINE 1\n")
    with pytest.raises(Exception, match="repeated name"):
        X.read_priorities(spark, str(tmp_path / "p2.txt")).collect()


def test_sam_round_trip(spark, tmp_path):
    line = "r1\t73\t7\t101\t254\t10=\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII"
    (tmp_path / "T.star.target.sam").write_text(f"@HD\tVN:1.6\n@SQ\tSN:7\tLN:220\n{line}\tXG:i:0\n{line}\n")
    path = str(tmp_path / "T.star.target.sam")
    rec = X.mapper_results(X.read_sam(spark, path))
    assert {(r["target"], r["mapper"], r["kind"]) for r in rec.collect()} == {("T", "star", "target")}
    assert sorted(r["value"] for r in X.sam_line(rec).collect()) == [line, line + "\tXG:i:0"]
    assert X.read_sam_header(spark, path).where("kind = 'SQ'").first()["fields"]["SN"] == "7"
    (tmp_path / "bad.sam").write_text("r1\tx\t7\n")
    with pytest.raises(Exception, match="bad alignment line"):
        X.read_sam(spark, str(tmp_path / "bad.sam")).collect()


def test_paths_and_clusters(spark):
    exons = spark.createDataFrame([(0, 0, 100), (0, 200, 300), (0, 400, 500)], "target_id int, start long, end long")
    jumps = spark.createDataFrame([(0, 100, 200), (0, 300, 400), (0, 100, 400)], "target_id int, start long, end long")
    starts = spark.createDataFrame([(1, 0, 50, 170)], "id int, target_id int, pos long, length long")
    got = {r["path"] for r in paths.paths_right(starts, exons, jumps).collect()}
    assert got == {"50-220", "50-100,200-300,400-420"}
    nodes = {(r["start"], r["end"]) for r in paths.exon_nodes(jumps, spark.createDataFrame([(0, 500)], "target_id int, length long")).collect()}
    assert nodes == {(0, 100), (200, 300), (400, 500)}
    gaps = spark.createDataFrame([(0, 100, 200, 2, 9), (0, 98, 203, 1, 2), (0, 700, 800, 0, 5)], "target_id int, start long, end long, splice int, evidence long")
    assert [(r["start"], r["end"], r["evidence"]) for r in introns.cluster_gaps(gaps, 100).collect()] == [(100, 200, 11)]
    tree = embedding.average_linkage({("a", "b"): 2.0, ("a", "c"): 6.0, ("b", "c"): 4.0})
    assert tree == [("a", "b", 1.0), ("(a,b)", "c", 2.5)]


def test_gaps_in_a_diagonal(spark):
    mapped_r, mapped_g = [(100, 110), (110, 120), (130, 140), (190, 200)], [(1000, 1010), (1010, 1020), (1030, 1040), (1090, 1100)]
    cases = [([(0, 10), (40, 50)], 900, [(10, 40)]), ([(0, 10)], 900, []), ([(0, 10), (40, 50), (80, 90), (120, 130)], 900, [(10, 40), (50, 80)])]
    for read, shift, want in cases:
        df = spark.createDataFrame([(read, [(s + shift, e + shift) for s, e in read], mapped_r, mapped_g)], f"a {R.KIND}, b {R.KIND}, c {R.KIND}, d {R.KIND}")
        got = df.select(R.diagonal_gaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).first()["g"]
        assert pairs([g["read"] for g in got]) == want and pairs([g["genome"] for g in got]) == [(s + shift, e + shift) for s, e in want]
