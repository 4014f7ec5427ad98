"""Sequences of transcripts and targets, and repaired introns, on small rows."""

from pyspark.sql import functions as F

from strandspark.operators import loading as L


def test_transcripts_cross_pieces(spark):
    text = "ACGT" * 3000
    exons = [("t", "c", 4090, 4100), ("t", "c", 0, 5), ("t", "c", 0, 5), ("u", "c", 11999, 12010), ("v", "none", 0, 5)]
    got = L.transcript_sequences(spark.createDataFrame(exons, "transcript string, contig string, start long, end long"), spark.createDataFrame([("c", text)], "contig string, sequence string"))
    assert dict(map(tuple, got.select("transcript", "sequence").collect())) == {"t": text[:5] + text[4090:4100], "u": text[11999:], "v": ""}


def test_introns_move_to_the_first_known_site(spark):
    bases = "A" * 22 + "GT" + "A" * 30 + "AG" + "A" * 20
    rows = [("c", 20, 57, 0, True), ("c", 20, 57, 1, True), ("c", 40, 48, 0, True)]
    introns = spark.createDataFrame(rows, "target string, start long, end long, splice int, forward boolean")
    got = L.repair_introns(introns, spark.createDataFrame([("c", bases)], "contig string, sequence string"))
    assert sorted(map(tuple, got.select("start", "end", "splice").collect())) == [(20, 57, 1), (22, 56, 2), (40, 48, 0)]


def test_strands_and_cigars(spark):
    got = L.both_strands(spark.createDataFrame([(3, "AACGN")], "target_id long, sequence string"))
    assert sorted(map(tuple, got.collect())) == [(6, "AACGN"), (7, "NCGTT")]
    rows = spark.createDataFrame([("2=1X3I",), ("*",), ("5Q",), ("",)], "c string").select("c", L.uniform_cigar(F.col("c")))
    assert dict(map(tuple, rows.collect())) == {"2=1X3I": "3M3I", "*": "*", "5Q": "NA", "": "NA"}
