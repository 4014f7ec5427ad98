import random

from strandspark import cli
from strandspark.streaming import curation

RNG = random.Random(3)


def test_from_genome_to_alignments(spark, tmp_path, capsys):
    seq = "".join(RNG.choice("ACGT") for _ in range(4000))
    (tmp_path / "g.fa").write_text(">chr7 x\n" + "\n".join(seq[i : i + 60] for i in range(0, 4000, 60)) + "\n")
    (tmp_path / "g.fa.fai").write_text("chr7\t4000\t8\t60\t61\n")
    (tmp_path / "a.gtf").write_text('chr7\ts\tgene\t501\t3500\t.\t+\t.\tgene_id "G1";\n')
    reads = [(seq[600 + 10 * k : 750 + 10 * k], seq[1000 + 10 * k : 1150 + 10 * k][::-1].translate(str.maketrans("ACGT", "TGCA"))) for k in range(5)]
    for m in (0, 1):
        (tmp_path / f"r{m + 1}.fastq").write_text("".join(f"@q{k}/{m + 1}\n{p[m]}\n+\n{'I' * 150}\n" for k, p in enumerate(reads)))
    p = lambda x: str(tmp_path / x)
    cli.main(["index-pre", "--gtf", p("a.gtf"), "--fasta", p("g.fa"), "--upstream", "100", "--single-file", "--output", p("targets")])
    cli.main(["kmer-occurrences", "--fasta", p("g.fa"), "--output", p("counts")])
    cli.main(["index", "--fasta", p("targets"), "--kmer-occurrences", p("counts"), "--output", p("index")])
    t = spark.read.parquet(p("index/targets")).first()
    assert (t["gene_id"], t["start"], t["end"], t["seq"]) == ("G1", 400, 3500, seq[400:3500])
    assert spark.read.parquet(p("index/target_kmer_counts")).where("count < 1").count() == 0
    for mode in ("dna", "rna"):
        cli.main(["map", "--index", p("index"), "--first", p("r1.fastq"), "--second", p("r2.fastq"), "--mode", mode, "--output", p(mode)])
        lines = [r[0] for r in spark.read.text(p(f"{mode}/aligned.sam/part=1")).collect()]
        got = {(f[0], int(f[1])): (int(f[3]), f[5]) for f in (x.split("\t") for x in lines)}
        assert len(got) == 10 and got["q0", 73] == (601, "150=") and got["q3", 153] == (1031, "150=")
    cli.main(["index-pre-region", "--fasta", p("g.fa"), "--regions", "chr7:10-30", "--output", p("region")])
    assert seq[10:30] in spark.read.text(p("region")).agg({"value": "max"}).first()[0] or seq[10:30] in "".join(r[0] for r in spark.read.text(p("region")).collect())
    cli.main(["generate-conf", "--mode", "rna"])
    assert "max_gap_count: 20" in capsys.readouterr().out
    assert cli.settings("dna", ["max_gap_count=3", "sam_use_x=false"]).max_gap_count == 3


def test_curation_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qname":"r1","mate":1,"action":"accept","record":4,"seq":1,"at":"2024-01-01T00:00:00"}\n{"qname":"r1","mate":1,"action":"accept","record":7,"seq":2,"at":"2024-01-01T00:01:00"}\n{"qname":"r2","mate":1,"action":"accept","record":5,"seq":3,"at":"2024-01-01T00:02:00"}\n{"qname":"r2","mate":1,"action":"unaccept","record":5,"seq":4,"at":"2024-01-01T00:03:00"}\n')
    q = curation.latest(curation.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["qname"]: r["accepted"] for r in spark.table("latest").collect()} == {"r1": 7, "r2": None}
