import random

from strandspark.config import RNA
from strandspark.operators import remapping as M
from strandspark.operators.mapping import Alignment, ReadMapper, cigar_of, map_reads, other_strand

RNG = random.Random(8)
GENE = "".join(RNG.choice("ACGT") for _ in range(3000))
INTRON = (1000, 1400)


def test_paths():
    router = M.Router("A" * 500, [(100, 200), (300, 400)])
    assert set(router.right(50, 170)) == {((50, 220),), ((50, 100), (200, 320)), ((50, 100), (200, 300), (400, 420))}
    assert set(router.left(420, 170)) == {((250, 420),), ((150, 300), (400, 420)), ((50, 100), (200, 300), (400, 420))}


def test_short_overhang_is_routed_over_the_intron():
    read = GENE[900:1000] + GENE[1400:1406]
    mapper = ReadMapper([GENE, other_strand(GENE)], RNA)
    a = Alignment(0, [(0, 100, 900)])
    found = M.remap(read, a, M.Router(GENE, [INTRON]), mapper)
    assert "100=400N6=" in {cigar_of(x, RNA) for x in found}


def test_gap_is_shifted_onto_the_intron():
    read = GENE[950:1000] + GENE[1400:1450]
    mapper = ReadMapper([GENE, other_strand(GENE)], RNA)
    a = Alignment(0, [(0, 48, 950), (48, 100, 1398)], complete=True)
    found = M.shifted(read, a, M.Router(GENE, [INTRON]), mapper)
    assert [cigar_of(x, RNA) for x in found] == ["50=400N50="]


def test_both_strands_through_tables(spark):
    targets = spark.createDataFrame([(0, GENE)], "target_id int, seq string")
    introns = spark.createDataFrame([(0, *INTRON)], "target_id int, start long, end long")
    fw = GENE[890:1000] + GENE[1400:1407]
    reads = spark.createDataFrame([(0, 1, "a", fw), (1, 1, "b", other_strand(fw)), (2, 1, "c", GENE[:150])], "read_ord long, mate int, qname string, seq string")
    first = map_reads(reads, targets, RNA)
    got = {}
    for r in M.remap_reads(first, reads, targets, introns, RNA).collect():
        got.setdefault(r["qname"], set()).add((r["pos"], r["cigar"]))
    assert (890, "110=400N7=") in got["a"] and (890, "110=400N7=") in got["b"] and (0, "150=") in got["c"]


def test_mask_rejects_a_rerouted_read(spark):
    targets = spark.createDataFrame([(0, GENE)], "target_id int, seq string")
    introns = spark.createDataFrame([(0, *INTRON)], "target_id int, start long, end long")
    wrong = "A" if GENE[950] != "A" else "C"
    read = GENE[890:950] + wrong + GENE[951:1000] + GENE[1400:1407]
    reads = spark.createDataFrame([(0, 1, "a", read)], "read_ord long, mate int, qname string, seq string")
    first = map_reads(reads, targets, RNA)
    mask = spark.createDataFrame([(0, 940, 960, 1)], "seq_index int, start long, end long, threshold int")
    rerouted = lambda m: [r for r in M.remap_reads(first, reads, targets, introns, RNA, m).collect() if "400N" in r["cigar"]]
    assert rerouted(None) and not rerouted(mask)
    a = Alignment(0, [(0, 108, 890), (108, 117, 1398)], complete=True)
    mapper = ReadMapper([GENE, other_strand(GENE)], RNA, [(0, 940, 960, 1)])
    assert not M.shifted(read, a, M.Router(GENE, [INTRON]), mapper)
